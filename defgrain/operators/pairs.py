"""Instruction pairs: up to three per function row, made in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ColumnRoles, as_list, key_columns
from ..functions.text import is_blank, is_present, strip

DOC_TO_CODE = "docstring_to_code"
SIGNATURE_TO_BODY = "signature_to_body"
CODE_TO_DOC = "code_to_docstring"
PAIR_TYPES = [DOC_TO_CODE, SIGNATURE_TO_BODY, CODE_TO_DOC]

# Instruction text per pair type.
INSTRUCTIONS = {
    DOC_TO_CODE: "Generate Python function implementation from the given docstring.",
    SIGNATURE_TO_BODY: "Complete the Python function body according to the signature.",
    CODE_TO_DOC: "Generate a concise docstring for the given Python function.",
}


def _usable() -> Column:
    return F.col("parse_ok").eqNullSafe(True) & is_present("function_name")


def _doc_text(roles: ColumnRoles) -> Column:
    """An empty docstring falls through to the one in the code, a blank one does not."""
    doc = F.when(is_present(roles.docstring), F.col(roles.docstring)).otherwise(F.col("docstring_in_code"))
    return F.when(~is_blank(doc), strip(doc))


def _pair(pair_type: str, source: Column, target: Column) -> Column:
    return F.struct(
        F.lit(pair_type).alias("pair_type"),
        F.lit(INSTRUCTIONS[pair_type]).alias("instruction"),
        source.alias("input"),
        target.alias("output"),
        F.col("function_name").alias("source_function_name"),
    )


def pair_conditions(df: DataFrame, roles: ColumnRoles) -> dict[str, Column]:
    """When a row yields a pair of each type, in output order; none without extraction."""
    if "signature" not in df.columns:
        return {}
    usable = _usable() & is_present(roles.code)
    body = usable & ~is_blank("body_without_docstring") & is_present("signature")
    if not roles.docstring:
        return {SIGNATURE_TO_BODY: body}
    documented = usable & _doc_text(roles).isNotNull()
    return {DOC_TO_CODE: documented, SIGNATURE_TO_BODY: body, CODE_TO_DOC: documented}


def _candidates(df: DataFrame, roles: ColumnRoles) -> dict[str, Column]:
    """Pair struct or NULL, per type, in output order."""
    code = F.col(roles.code)
    ends = {SIGNATURE_TO_BODY: (F.col("signature"), strip("body_without_docstring"))}
    if roles.docstring:
        ends[DOC_TO_CODE] = (_doc_text(roles), code)
        ends[CODE_TO_DOC] = (code, _doc_text(roles))
    return {t: F.when(condition, _pair(t, *ends[t])) for t, condition in pair_conditions(df, roles).items()}


def build_pairs(df: DataFrame, roles: ColumnRoles, types: list[str] | None = None) -> DataFrame:
    """All pairs of the rows, keyed by row and ``pair_ord``. Without a docstring role only
    signature pairs are made."""
    found = [c for t, c in _candidates(df, roles).items() if types is None or t in types]
    if not found:
        raise ValueError(f"no pair type of {types} can be built without a docstring column")
    pairs = F.array_compact(F.array(*found))
    exploded = df.select(*key_columns(df), F.posexplode(pairs).alias("pair_ord", "_pair"))
    return exploded.select(*key_columns(df), "pair_ord", "_pair.*")


def pair_doc_to_code(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    return build_pairs(df, roles, [DOC_TO_CODE])


def pair_signature_to_body(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    return build_pairs(df, roles, [SIGNATURE_TO_BODY])


def pair_code_to_doc(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    return build_pairs(df, roles, [CODE_TO_DOC])


def pair_counts(df: DataFrame, roles: ColumnRoles, by: list[str] | str = ()) -> DataFrame:
    """Pairs per type, all pairs, and rows without any; no pair text is built to count them."""
    conditions = pair_conditions(df, roles)
    made = {t: F.coalesce(conditions.get(t, F.lit(False)), F.lit(False)) for t in PAIR_TYPES}
    counts = df.groupBy(*as_list(by)).agg(
        *[F.count_if(flag).alias(f"{t}_count") for t, flag in made.items()],
        F.count_if(~made[DOC_TO_CODE] & ~made[SIGNATURE_TO_BODY] & ~made[CODE_TO_DOC]).alias(
            "skipped_instruction_pair_count"
        ),
    )
    total = F.expr(" + ".join(f"{t}_count" for t in PAIR_TYPES))
    return counts.withColumn("instruction_pair_count", total)
