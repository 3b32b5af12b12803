"""Rounding and ratios with exact decimal semantics, as plain Column arithmetic.

``round`` on doubles works on the printed decimal and rounds ties up, so 3/160 becomes
0.0188 although the stored double lies just below 0.01875. The helpers here decide by the
stored value itself. The product ``x * 10**digits`` is split into a double and its exact
rounding error (Veltkamp/Dekker), and both take part in the comparison with one half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPLIT = float(2**27 + 1)


def _round_magnitude(a: Column, digits: int, ties: str = "even") -> Column:
    """Rounding of a non-negative double. Every part occurs as few times as possible, because
    Catalyst analyses each repetition."""
    scale = F.lit(float(10**digits))
    shifted = a * _SPLIT
    high = shifted - (shifted - a)
    product = a * scale
    error = (high * scale - product) + (a - high) * scale
    below = F.floor(product)
    # product - below - 0.5 has no rounding error, so its sum with error has the right sign.
    excess = F.signum((product - below - 0.5) + error)
    tie = F.lit(0.5) if ties == "away" else (below % 2) - 0.5
    return (below + F.when(excess + tie > 0, 1).otherwise(0)) / scale


def exact_round(x: Column, digits: int, ties: str = "even") -> Column:
    """Round the stored double to ``digits`` decimals; exact ties go to even or away from zero."""
    if ties not in ("even", "away"):
        raise ValueError(ties)
    x = x.cast("double")
    return _round_magnitude(F.abs(x), digits, ties) * F.signum(x)


def safe_ratio(numerator: Column, denominator: Column, digits: int = 4) -> Column:
    """numerator / denominator rounded, 0.0 when the denominator is zero or missing.

    The rounding repeats its argument; pass columns, not aggregates (see ``with_ratios``)."""
    quotient = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return F.coalesce(_round_magnitude(quotient, digits), F.lit(0.0))


def with_ratios(
    df: DataFrame, by: list[str], totals: dict[str, Column], ratios: dict[str, tuple[str, str, int]]
) -> DataFrame:
    """Aggregate ``totals`` in one pass, then divide them: name -> (numerator, denominator,
    digits). Dividing after the aggregate keeps the generated aggregate code small. Totals
    whose names start with an underscore are not returned."""
    summed = df.groupBy(*by).agg(*[c.alias(name) for name, c in totals.items()])
    return summed.select(
        *by,
        *[name for name in totals if not name.startswith("_")],
        *[safe_ratio(F.col(n), F.col(d), digits).alias(name) for name, (n, d, digits) in ratios.items()],
    )
