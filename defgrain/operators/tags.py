"""Filters as tags: each row gets the first rule that rejects it instead of vanishing.

Tagging keeps every stage in one narrow pass; counts, survivors and bad cases are views.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import (
    DROP_REASON,
    DROP_STAGE,
    VERDICT,
    ColumnRoles,
    PrepOptions,
    as_list,
    engine,
    is_engine,
    key_columns,
    set_aside,
)
from ..functions.text import char_length, is_blank, is_present, strip

# Reasons in rule order, placeholder words, suffixes that add nothing to a name, the
# lengths of border docstrings. The verdicts an outside judge may give are high_quality,
# low_quality and uncertain. Length limits are in PrepOptions.
INVALID_REASONS = [
    "empty_code",
    "ast_parse_failed",
    "missing_function_name",
    "code_too_short",
    "code_too_long",
    "docstring_too_long",
]
LOW_QUALITY_REASONS = ["empty_docstring", "short_docstring", "placeholder_docstring", "repetitive_docstring"]
PLACEHOLDERS = ["todo", "fixme", "test", "temp", "none", "n/a", "tbd", "placeholder"]
BORDER_MIN_LEN = 10
BORDER_MAX_LEN = 60
NAME_SUFFIXES = [" function", " method", "function", "method"]
DOCSTRING_MIN_LEN = PrepOptions.docstring_min_len

INVALID_STAGE = "filter_invalid"
LOW_QUALITY_STAGE = "filter_low_quality"
JUDGED_LOW = "judged_low_quality"


def alive() -> Column:
    return F.col(DROP_REASON).isNull()


def add_tag(df: DataFrame, stage: str, reason: Column) -> DataFrame:
    """Tag rows not tagged by an earlier stage. Only tags of this library count as such: a user's
    columns of the same names are kept under ``user_`` names."""
    if not is_engine(df, DROP_REASON):
        df = set_aside(df, [DROP_STAGE, DROP_REASON])
        none = F.lit(None).cast("string")
        df = df.withColumns({DROP_STAGE: none, DROP_REASON: none})
    return df.withColumn("_reason", F.when(alive(), reason)).select(
        *[F.col(f"`{c}`") for c in df.columns if c not in (DROP_STAGE, DROP_REASON)],
        engine(F.when(F.col("_reason").isNotNull(), F.lit(stage)).otherwise(F.col(DROP_STAGE)), DROP_STAGE),
        engine(F.coalesce("_reason", DROP_REASON), DROP_REASON),
    )


def invalid_reason(df: DataFrame, roles: ColumnRoles, opts: PrepOptions = PrepOptions()) -> Column:
    code = F.col(roles.code).cast("string")
    length = char_length(code)
    reason = F.when(is_blank(code), "empty_code")
    if "parse_ok" in df.columns:
        reason = reason.when(F.col("parse_ok").eqNullSafe(False), "ast_parse_failed")
        reason = reason.when(
            F.col("parse_ok").eqNullSafe(True) & is_blank("function_name"), "missing_function_name"
        )
    reason = reason.when(length < opts.code_min_len, "code_too_short")
    reason = reason.when(length > opts.code_max_len, "code_too_long")
    if roles.docstring:
        reason = reason.when(char_length(roles.docstring) > opts.docstring_max_len, "docstring_too_long")
    return reason


def tag_invalid(df: DataFrame, roles: ColumnRoles, opts: PrepOptions = PrepOptions()) -> DataFrame:
    """Blank, unparsable, unnamed, too short or too long rows."""
    roles.check(df)
    return add_tag(df, INVALID_STAGE, invalid_reason(df, roles, opts))


def is_placeholder(doc: str | Column) -> Column:
    return F.coalesce(F.lower(strip(doc)).isin(PLACEHOLDERS), F.lit(False))


def is_repetitive(doc: str | Column, function_name: str | Column) -> Column:
    """The docstring says no more than the function's name."""
    text, name = F.lower(strip(doc)), F.lower(strip(function_name))
    added = F.substr(text, F.char_length(name) + 1)
    same = (F.startswith(text, name) & added.isin("", *NAME_SUFFIXES)) | (
        F.replace(text, F.lit("_"), F.lit("")) == F.replace(name, F.lit("_"), F.lit(""))
    )
    return is_present(function_name) & F.coalesce(same, F.lit(False))


def low_quality_reason(df: DataFrame, roles: ColumnRoles, min_len: int = DOCSTRING_MIN_LEN) -> Column:
    doc = roles.docstring
    reason = F.when(is_blank(doc), "empty_docstring")
    reason = reason.when(char_length(strip(doc)) < min_len, "short_docstring")
    reason = reason.when(is_placeholder(doc), "placeholder_docstring")
    if "function_name" in df.columns:
        reason = reason.when(is_repetitive(doc, "function_name"), "repetitive_docstring")
    return reason


def tag_low_quality(df: DataFrame, roles: ColumnRoles, min_len: int = DOCSTRING_MIN_LEN) -> DataFrame:
    """Empty, short, placeholder or name-repeating docstrings; no docstring role, no tags."""
    roles.check(df)
    if not roles.docstring:
        return add_tag(df, LOW_QUALITY_STAGE, F.lit(None).cast("string"))
    return add_tag(df, LOW_QUALITY_STAGE, low_quality_reason(df, roles, min_len))


def survivors(tagged: DataFrame) -> DataFrame:
    return tagged.where(alive()).drop(DROP_STAGE, DROP_REASON)


def filter_invalid(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    return survivors(tag_invalid(df, roles))


def filter_low_quality(df: DataFrame, roles: ColumnRoles, min_len: int = DOCSTRING_MIN_LEN) -> DataFrame:
    return survivors(tag_low_quality(df, roles, min_len))


def badcases(tagged: DataFrame) -> DataFrame:
    """Rejected rows with the stage and rule that rejected them."""
    return tagged.where(F.col(DROP_REASON).isNotNull())


def reason_counts(tagged: DataFrame, reasons: list[str], by: list[str] | str = ()) -> DataFrame:
    """One row per listed reason, zeros included, from a single aggregate row per group."""
    by = as_list(by)
    wide = tagged.groupBy(*by).agg(*[F.count_if(F.col(DROP_REASON) == r).alias(r) for r in reasons])
    return wide.unpivot(by, reasons, DROP_REASON, "n")


def invalid_reason_counts(tagged: DataFrame, by: list[str] | str = ()) -> DataFrame:
    return reason_counts(tagged, INVALID_REASONS, by)


def low_quality_reason_counts(tagged: DataFrame, by: list[str] | str = ()) -> DataFrame:
    return reason_counts(tagged, LOW_QUALITY_REASONS, by)


def border_candidates(
    stage_input: DataFrame,
    roles: ColumnRoles,
    min_len: int = DOCSTRING_MIN_LEN,
    by: list[str] | str = (),
    limit: int | None = None,
) -> DataFrame:
    """Rows worth an outside opinion: the survivors with a 10-60 character docstring, with the
    columns of ``by`` that name their data set. ``stage_input`` is what enters the docstring filter.
    ``limit`` asks for the first so many of each data set; without it all are offered."""
    by, keys = as_list(by), key_columns(stage_input)
    text = strip(roles.docstring)
    names = ["function_name"] if "function_name" in stage_input.columns else []
    rows = (
        filter_low_quality(stage_input, roles, min_len)
        .where(char_length(text).between(BORDER_MIN_LEN, BORDER_MAX_LEN))
        .select(*by, *keys, text.alias("docstring"), *names)
    )
    if limit is None:
        return rows
    if not by:
        return rows.orderBy(*keys).limit(limit)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*keys))
    return rows.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")


def apply_verdicts(df: DataFrame, verdicts: DataFrame, key: list[str] | str | None = None) -> DataFrame:
    """Attach outside verdicts and tag the rows judged low quality. The key defaults to the
    key columns both tables have: functions if the verdicts name them, else whole rows.

    Rows without a verdict and unknown labels count as ``uncertain`` and stay. Several
    verdicts on one key are reduced to the mildest, so the join never multiplies rows. A user's
    column ``verdict`` stays as ``user_verdict``."""
    key = as_list(key) if key else [c for c in key_columns(df) if c in verdicts.columns]
    # The mildest verdict has the lowest number; numbers aggregate by hash, names would be sorted.
    label = F.col(VERDICT)
    severity = F.when(label == "high_quality", 0).when(label == "low_quality", 2).otherwise(1)
    single = verdicts.groupBy(*key).agg(F.min(severity).alias("_severity"))
    name = F.when(F.col("_severity") == 0, "high_quality").when(F.col("_severity") == 2, "low_quality")
    df = set_aside(df, [VERDICT])
    judged = df.join(single, key, "left").select(
        *[F.col(f"`{c}`") for c in df.columns], engine(name.otherwise("uncertain"), VERDICT)
    )
    return add_tag(judged, LOW_QUALITY_STAGE, F.when(F.col(VERDICT) == "low_quality", JUDGED_LOW))
