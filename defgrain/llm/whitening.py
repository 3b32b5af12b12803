"""Embedding whitening by the exact characteristic polynomial of the integer scatter matrix.

Vectors are rounded to integers x = floor(256 c). Over the distinct ones, their count n, sums S and
products X'X are integers, and M = n X'X - S S' is n^2 times their covariance, without any rounding.

* det(tI - M) is computed modulo many primes, each by reduction to Hessenberg form, as tasks of one
  Spark job, and put together by Chinese remaindering. M has no negative eigenvalues, so its
  coefficients alternate in sign and are bounded by the trace, which tells how many primes suffice.
* All roots are real, so the sign changes of the polynomial shifted by a are exactly the number of roots
  above a. Bisection on that number isolates the largest roots with their multiplicity, and then
  bisection on the sign of the polynomial refines them, in integers throughout.
* Components are null vectors of M - root I, by inverse iteration in decimals of ``DIGITS`` digits.

What reaches the driver has a size set by the dimension, not by the rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal, localcontext
from fractions import Fraction
from functools import reduce
from math import comb, gcd, prod, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, stage

SCALE = 256
COMPONENTS = 4
DIGITS = 120
#: Roots are refined to the trace / 2^REFINE; roots that are closer count as one of higher multiplicity.
REFINE = 240
_PRIME_BITS = 31  # products of two residues and a residue fit 64 bits
_HALF = 10**18  # sums travel as high and low part
_LONG = (1 << 63) - 1


# Integers and sums


def whole(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")))


def _rows(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, x) of the rows that take part."""
    odd = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    good = df.where(F.col(vec_col).isNotNull() & ~F.exists(vec_col, odd))
    return good.select(F.col(id_col).cast("long").alias("vec_id"), whole(F.col(vec_col)).alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column sums and products of columns, exact, as Python integers. Products of whole numbers in
    doubles are exact while they stay below 2^53; beyond that they are taken in Python integers."""
    most = max(1, int(np.abs(x.astype(np.float64)).max(initial=0)))
    if len(x) * most * most < 1 << 53:
        own = x.astype(np.float64)
        return own.sum(axis=0).astype(np.int64).astype(object), (own.T @ own).astype(np.int64).astype(object)
    own = x.astype(object)
    return own.sum(axis=0), own.T @ own


def _scatter(fit: DataFrame, dim: int) -> tuple[int, list[int], list[list[int]]]:
    """Count, sums and products of the distinct vectors, summed in Spark cell by cell."""
    pairs = [(i, j) for i in range(dim) for j in range(i, dim)]

    def run(batches):
        n, s, g = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            a, b = _sums(x)
            n, s, g = n + len(x), s + a, g + b
        values = [n, *s, *(g[i, j] for i, j in pairs)]
        number = lambda out: pa.array([Decimal(int(v)) for v in out], pa.decimal128(38, 0))
        yield pa.record_batch(
            [pa.array(range(len(values)), pa.int32()), number(v // _HALF for v in values), number(v % _HALF for v in values)],
            names=["cell", "high", "low"],
        )

    cells = fit.select("x").mapInArrow(run, "cell int, high decimal(38,0), low decimal(38,0)")
    sums = cells.groupBy("cell").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    found = {r["cell"]: int(r["high"]) * _HALF + int(r["low"]) for r in sums.collect()}
    products = [[0] * dim for _ in range(dim)]
    for at, (i, j) in enumerate(pairs):
        products[i][j] = products[j][i] = found.get(1 + dim + at, 0)
    return found.get(0, 0), [found.get(1 + i, 0) for i in range(dim)], products


# Characteristic polynomial


def _is_prime(n: int) -> bool:
    """Strong pseudoprime test to bases that decide all n below 2^32."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """The largest primes of ``_PRIME_BITS`` bits, as many as have a product above ``bound``."""
    out, product, n = [], 1, (1 << _PRIME_BITS) - 1
    while product <= bound:
        if _is_prime(n):
            out.append(n)
            product *= n
        n -= 2
    return out


def hessenberg(a: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to ``a`` modulo p with zeros below the first subdiagonal."""
    a = a % p
    for m in range(1, len(a) - 1):
        some = np.flatnonzero(a[m:, m - 1])
        if not len(some):
            continue
        i = m + int(some[0])
        a[[m, i]] = a[[i, m]]
        a[:, [m, i]] = a[:, [i, m]]
        u = a[m + 1 :, m - 1] * pow(int(a[m, m - 1]), -1, p) % p
        a[m + 1 :] = (a[m + 1 :] - u[:, None] * a[m]) % p
        a[:, m] = (a[:, m] + (a[:, m + 1 :] * u % p).sum(axis=1)) % p
    return a


def polynomial_mod(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(tI - a) modulo p, constant first, by the recurrence over leading blocks."""
    h, d = hessenberg(a, p), len(a)
    leading = np.zeros((d + 1, d + 1), np.int64)
    leading[0, 0] = 1
    for m in range(d):
        new = np.zeros(d + 1, np.int64)
        new[1:] = leading[m, :-1]
        weights, below = np.zeros(m + 1, np.int64), 1
        for i in range(m, -1, -1):
            weights[i] = h[i, m] * below % p
            below = below * int(h[i, i - 1]) % p if i else 0
        leading[m + 1] = (new - (leading[: m + 1] * weights[:, None] % p).sum(axis=0)) % p
    return leading[d]


def polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(tI - matrix), constant first, of a symmetric matrix of integers without
    negative eigenvalues. Each task takes some of the primes."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    bound = max(comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    primes = primes_beyond(bound)
    whole_matrix = np.array(matrix, dtype=object)

    def run(batch):
        ps = batch.column(0).to_pylist()
        out = [polynomial_mod((whole_matrix % p).astype(np.int64), p).tolist() for p in ps]
        return pa.record_batch([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["p", "c"])

    dealt = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), 32))
    rows = {r["p"]: r["c"] for r in map_batches(dealt, run, "p long, c array<long>").collect()}
    product, out = prod(primes), []
    shares = [(p, product // p, pow(product // p, -1, p)) for p in primes]
    for k in range(d + 1):
        # The coefficient of t^k has the sign of (-1)^(d - k).
        sign = -1 if (d - k) % 2 else 1
        out.append(sign * (sum(sign * rows[p][k] * inverse % p * rest for p, rest, inverse in shares) % product))
    return out


# Roots


def _shifted(c: list[int], a: int) -> list[int]:
    """Coefficients of c(t + a)."""
    c = list(c)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += a * c[j + 1]
    return c


def _finer(c: list[int], bits: int) -> list[int]:
    """The polynomial whose roots are 2^bits times those of c."""
    return [v << bits * (len(c) - 1 - k) for k, v in enumerate(c)]


def above(c: list[int], a: int) -> int:
    """How many roots exceed a, with multiplicity; exact, as all roots are real."""
    signs = [v > 0 for v in _shifted(c, a) if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _sign(c: list[int], a: int) -> int:
    value = reduce(lambda total, v: total * a + v, reversed(c), 0)
    return (value > 0) - (value < 0)


def largest_roots(c: list[int], count: int, trace: int) -> list[tuple[Fraction, int]]:
    """(root, multiplicity) from the largest on, until ``count`` roots are named. A root is the
    middle of an interval of the width trace / 2^REFINE."""
    if not trace:
        return [(Fraction(0), len(c) - 1)]
    bits = max(0, REFINE - trace.bit_length())
    c, out, named = _finer(c, bits), [], 0
    high = (trace << bits) + 1  # no root reaches it
    while named < min(count, len(c) - 1):
        low, top, inside = -1, high, len(c) - 1 - named
        width = max(1, (trace << bits) >> REFINE)
        while top - low > width and inside > 1:
            middle = (low + top) // 2
            over = above(c, middle) - named
            if over > 0:
                low, inside = middle, over
            else:
                top = middle
        if inside == 1:
            sign = -1 if named % 2 else 1  # just above the root
            while top - low > width:
                middle = (low + top) // 2
                low, top = (middle, top) if _sign(c, middle) == -sign else (low, middle)
        out.append((Fraction(low + top, 2 << bits), inside))
        named += inside
        high = low
    return out


# Null vectors


def _solver(matrix: list[list[int]], root: Fraction, tiny: Decimal):
    """Solve (matrix - root) x = b by elimination with row pivots; a vanishing pivot becomes tiny."""
    d = len(matrix)
    shift = Decimal(root.numerator) / Decimal(root.denominator)
    a = [[Decimal(v) for v in row] for row in matrix]
    for i in range(d):
        a[i][i] -= shift
    order, factors = [], []
    for k in range(d):
        i = max(range(k, d), key=lambda r: abs(a[r][k]))
        order.append(i)
        a[k], a[i] = a[i], a[k]
        if abs(a[k][k]) < tiny:
            a[k][k] = tiny
        own = []
        for r in range(k + 1, d):
            f = a[r][k] / a[k][k]
            own.append(f)
            if f:
                a[r][k + 1 :] = [x - f * y for x, y in zip(a[r][k + 1 :], a[k][k + 1 :])]
        factors.append(own)

    def solve(b: list[Decimal]) -> list[Decimal]:
        b = list(b)
        for k in range(d):
            b[k], b[order[k]] = b[order[k]], b[k]
            for r, f in enumerate(factors[k], k + 1):
                b[r] -= f * b[k]
        for k in range(d - 1, -1, -1):
            b[k] = (b[k] - sum((a[k][j] * b[j] for j in range(k + 1, d)), Decimal(0))) / a[k][k]
        return b

    return solve


def _orthonormal(vectors: list[list[Decimal]], known: list[list[Decimal]]) -> list[list[Decimal]]:
    out = []
    for v in vectors:
        for _ in range(2):
            for u in known + out:
                dot = sum((x * y for x, y in zip(u, v)), Decimal(0))
                v = [x - dot * y for x, y in zip(v, u)]
        norm = sum((x * x for x in v), Decimal(0)).sqrt()
        out.append([x / norm for x in v])
    return out


def null_vectors(matrix: list[list[int]], roots: list[tuple[Fraction, int]], count: int) -> list[list[float]]:
    """Unit eigenvectors to the roots, ``count`` in all; the largest entry of each is positive."""
    d, trace, rng = len(matrix), sum(matrix[i][i] for i in range(len(matrix))), np.random.default_rng(0)
    out: list[list[Decimal]] = []
    with localcontext() as context:
        context.prec = DIGITS
        tiny = Decimal(max(trace, 1)) / Decimal(10) ** (DIGITS * 3 // 4)
        for root, times in roots:
            solve = _solver(matrix, root, tiny)
            own = [[Decimal(int(v)) for v in rng.integers(-1000, 1000, d)] for _ in range(min(times, count - len(out)))]
            for _ in range(3):
                own = _orthonormal([solve(v) for v in _orthonormal(own, out)], out)
            out += own
        signed = [v if max(v, key=abs) > 0 else [-x for x in v] for v in out]
        return [[float(x) for x in v] for v in signed]


# The operator


@dataclass
class Model:
    """What whitening needs: count and sums of the distinct integer vectors, unit components (rows),
    variance along each, and the share of the trace that it explains (None without any variance)."""

    n: int
    sums: list[int]
    components: list[list[float]]
    variances: list[float]
    explained: list[float | None]


def fit_model(fit: DataFrame, dim: int, components: int = COMPONENTS) -> Model | None:
    """The model of distinct vectors ``x`` of length ``dim``; None if there are none."""
    n, sums, products = _scatter(fit, dim)
    if not n:
        return None
    matrix = [[n * products[i][j] - sums[i] * sums[j] for j in range(dim)] for i in range(dim)]
    # A common divisor only scales the roots, and smaller numbers need fewer primes.
    scale = gcd(*(v for row in matrix for v in row)) or 1
    matrix = [[v // scale for v in row] for row in matrix]
    trace, count = sum(matrix[i][i] for i in range(dim)), min(components, dim)
    roots = largest_roots(polynomial(fit.sparkSession, matrix), count, trace)
    vectors = null_vectors(matrix, roots, count)
    each = [root for root, times in roots for _ in range(times)][:count]
    # Roots of zero come out as the middle of an interval about zero.
    each = [root if root * (1 << REFINE // 2) > trace else Fraction(0) for root in each]
    variances = [float(root * scale / n**2) for root in each]
    return Model(n, sums, vectors, variances, [float(root / trace) if trace else None for root in each])


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, as 64-bit integers where squares of all can be summed in them, else as Python's."""
    most = n * int(np.abs(x.astype(np.float64)).max(initial=0)) + max(map(abs, sums), default=0)
    if len(sums) * (most + 1) ** 2 < _LONG:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _project(rows: DataFrame, model: Model) -> DataFrame:
    """(vec_id, deviation, w) with one whitened value a component, null without variance."""
    basis = np.array(model.components).T
    scales = [model.n * sqrt(v) if v else None for v in model.variances]

    def run(batch):
        off = _deviations(_matrix(batch.column(1), len(model.sums)), model.n, model.sums)
        squares = [int(v) if v <= _LONG else None for v in (off * off).sum(axis=1).tolist()]
        at = off.astype(np.float64) @ basis
        w = [[v / s if s else None for v, s in zip(row, scales)] for row in at.tolist()]
        return pa.record_batch(
            [batch.column(0), pa.array(squares, pa.int64()), pa.array(w, pa.list_(pa.float64()))], names=["vec_id", "deviation", "w"]
        )

    return map_batches(rows.select("vec_id", "x"), run, "vec_id long, deviation long, w array<double>")


def _identity_error(fit: DataFrame, model: Model) -> float | None:
    """The largest entry of the whitened fit list's covariance minus the identity."""
    used = [k for k, v in enumerate(model.variances) if v]
    pairs = [(i, j) for i in used for j in used if i <= j]
    if not pairs:
        return None
    w = _project(fit.select(F.lit(0).cast("long").alias("vec_id"), "x"), model)
    gaps = w.select([F.abs(F.covar_pop(F.col("w")[i], F.col("w")[j]) - float(i == j)) for i, j in pairs]).first()
    return max(gaps)


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per remaining row and component: vec_id, component (from 1), n, deviation (null beyond
    a long), whitened, explained and identity_error.

    Rows whose vector is null or holds null, NaN or infinite entries are dropped. The dimension is the
    most frequent length, the greater on ties; vectors of another length are dropped too. Components
    without variance have a null ``whitened`` and explain 0, or null where the trace is 0, and take no
    part in identity_error. Equal eigenvalues have some orthonormal basis of their space. Entries beyond
    the range of a long are held at its ends. Rows that repeat an id or a vector, or have a null id, each
    come out. Other columns are ignored; an empty table gives an empty result."""
    rows = _rows(df, id_col, vec_col)
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    dim = (sizes.agg(F.max(F.struct("n", "d"))["d"].alias("d")).first() or [0])[0] or 0
    rows = rows.where(F.size("x") == dim)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = stage(rows.select("x").distinct(), "fit") if dim else None
    model = fit_model(fit, dim, components) if dim else None
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    error = _identity_error(fit, model)
    return _project(rows, model).select(
        "vec_id",
        "deviation",
        F.posexplode(F.arrays_zip("w", F.array(*[F.lit(v).cast("double") for v in model.explained]).alias("e"))).alias("at", "own"),
    ).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        F.col("own.w").alias("whitened"),
        F.col("own.e").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
