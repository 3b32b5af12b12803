"""Profile, quality rates, run record and stage log, all from one pass over tagged rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (
    DROP_REASON,
    DROP_STAGE,
    FACTS,
    FN_ORD,
    IS_AUGMENTED,
    VERDICT,
    ColumnRoles,
    PrepOptions,
    as_list,
    is_engine,
)
from ..functions.numbers import safe_ratio, with_ratios
from ..functions.text import char_length, is_blank, is_present, strip
from .augment import AUGMENT_DUPLICATE
from .dedup import AST, DEDUP_STAGE, EXACT
from .pairs import PAIR_TYPES, pair_conditions
from .tags import (
    BORDER_MAX_LEN,
    BORDER_MIN_LEN,
    INVALID_REASONS,
    INVALID_STAGE,
    JUDGED_LOW,
    LOW_QUALITY_REASONS,
    LOW_QUALITY_STAGE,
)

# Columns looked at for documentation after the role column and the code's own.
FALLBACK_DOC_COLUMNS = ["docstring", "comment"]

# The fields of the final run record, in order.
RUN_METRICS = [
    "raw_sample_count",
    "final_sample_count",
    "retain_rate",
    "ast_parse_success_count",
    "ast_parse_failed_count",
    "empty_code_count",
    "low_quality_docstring_count",
    "dedup_removed_count",
    "exact_dedup_removed_count",
    "ast_dedup_removed_count",
    "augmentation_success_count",
    "augmentation_failed_count",
    "syntax_pass_rate",
    "docstring_coverage",
    "function_name_match_rate",
    "return_annotation_rate",
    "instruction_pair_count",
]

# The steps of a run, in order.
STAGES = [
    "load",
    "normalize",
    "extract_functions",
    INVALID_STAGE,
    LOW_QUALITY_STAGE,
    DEDUP_STAGE,
    "augment_rename",
    "build_pairs",
    "profile",
    "quality",
    "charts",
]


def has_documentation(df: DataFrame, roles: ColumnRoles) -> Column:
    """The first non-empty of the documentation columns is more than whitespace."""
    order = [roles.docstring, "docstring_in_code", *FALLBACK_DOC_COLUMNS]
    present = [c for c in dict.fromkeys(order) if c and c in df.columns]
    if not present:
        return F.lit(False)
    return ~is_blank(F.coalesce(*[F.when(is_present(c), F.col(c)) for c in present]))


def parsed(df: DataFrame) -> Column:
    return F.col("parse_ok").eqNullSafe(True) if "parse_ok" in df.columns else F.lit(False)


def named(df: DataFrame) -> Column:
    return is_present("function_name") if "function_name" in df.columns else F.lit(False)


def annotated(df: DataFrame) -> Column:
    if "return_annotation" not in df.columns:
        return F.lit(False)
    return is_present("return_annotation") & (F.col("return_annotation") != "None")


def _share(df: DataFrame, name: str, condition: Column, by: list[str] | str) -> DataFrame:
    totals = {"_hit": F.count_if(condition), "_n": F.count(F.lit(1))}
    return with_ratios(df, as_list(by), totals, {name: ("_hit", "_n", 4)})


def avg_text_length(df: DataFrame, column: str, by: list[str] | str = ()) -> DataFrame:
    """Mean length of the non-empty texts, two decimals, 0.0 if there are none."""
    length = F.when(is_present(column), char_length(column))
    totals = {"_sum": F.sum(length), "_n": F.count(length)}
    return with_ratios(df, as_list(by), totals, {"avg_text_length": ("_sum", "_n", 2)})


def docstring_coverage(df: DataFrame, roles: ColumnRoles, by: list[str] | str = ()) -> DataFrame:
    return _share(df, "docstring_coverage", has_documentation(df, roles), by)


def syntax_pass_rate(df: DataFrame, by: list[str] | str = ()) -> DataFrame:
    return _share(df, "syntax_pass_rate", parsed(df), by)


def function_name_rate(df: DataFrame, by: list[str] | str = ()) -> DataFrame:
    return _share(df, "function_name_match_rate", named(df), by)


def return_annotation_rate(df: DataFrame, by: list[str] | str = ()) -> DataFrame:
    return _share(df, "return_annotation_rate", annotated(df), by)


def row_facts(df: DataFrame, roles: ColumnRoles) -> Column:
    """What the metrics need to know of a row's texts, as one narrow struct. Stored with the
    tagged rows it lets every later metrics pass skip the text columns."""
    doc = F.col(roles.docstring) if roles.docstring else F.lit(None).cast("string")
    pairs = pair_conditions(df, roles)
    return F.struct(
        F.when(is_present(roles.code), char_length(roles.code)).alias("code_chars"),
        F.when(is_present(doc), char_length(doc)).alias("doc_chars"),
        F.coalesce(char_length(strip(doc)).between(BORDER_MIN_LEN, BORDER_MAX_LEN), F.lit(False)).alias("border"),
        has_documentation(df, roles).alias("documented"),
        named(df).alias("named"),
        annotated(df).alias("annotated"),
        *[F.coalesce(pairs.get(t, F.lit(False)), F.lit(False)).alias(t) for t in PAIR_TYPES],
    )


# name -> (numerator, denominator, digits)
_RATIOS = {
    "retain_rate": ("final_sample_count", "raw_sample_count", 4),
    "avg_code_length": ("_code_chars", "_code_n", 2),
    "avg_docstring_length": ("_doc_chars", "_doc_n", 2),
    "docstring_coverage": ("_documented", "final_sample_count", 4),
    "syntax_pass_rate": ("_parsed", "final_sample_count", 4),
    "function_name_match_rate": ("_named", "final_sample_count", 4),
    "return_annotation_rate": ("_annotated", "final_sample_count", 4),
}
_SUMS = {
    "augmentation_failed_count": "augmentation_attempt_count - augmentation_success_count "
    "- augmentation_duplicate_dropped_count",
    "instruction_pair_count": " + ".join(f"{t}_count" for t in PAIR_TYPES),
}


def _counted(
    tagged: DataFrame, roles: ColumnRoles, opts: PrepOptions, by: list[str]
) -> tuple[DataFrame, dict[str, Column]]:
    """The narrow rows that the metrics read, and the aggregates over them; all can be added up."""
    columns = [*by, DROP_STAGE, DROP_REASON]
    narrow = tagged.select(
        *columns,
        (F.col(FACTS) if FACTS in tagged.columns else row_facts(tagged, roles)).alias(FACTS),
        (F.col("parse_ok") if "parse_ok" in tagged.columns else F.lit(None).cast("boolean")).alias("parse_ok"),
        (F.col(IS_AUGMENTED) if is_engine(tagged, IS_AUGMENTED) else F.lit(False)).alias("new"),
        (F.col(VERDICT) if is_engine(tagged, VERDICT) else F.lit(None).cast("string")).alias("judged"),
        (F.col(FN_ORD) == 0 if FN_ORD in tagged.columns else F.lit(True)).alias("first"),
    )

    def count(condition: str) -> Column:
        return F.expr(f"count_if({condition})")

    def reason(name: str) -> Column:
        return count(f"{DROP_REASON} = '{name}'")

    def stage(name: str) -> Column:
        return count(f"{DROP_STAGE} = '{name}'")

    kept = f"{DROP_REASON} IS NULL"
    passed = f"({kept} OR {DROP_REASON} = '{JUDGED_LOW}' OR {DROP_STAGE} NOT IN ('{INVALID_STAGE}', '{LOW_QUALITY_STAGE}'))"
    paired = kept if opts.enable_instruction_pairs else "false"
    made = [f"{FACTS}.{t}" for t in PAIR_TYPES]
    return narrow, {
        "raw_sample_count": count("NOT new AND first"),
        "expanded_sample_count": count("NOT new"),
        "final_sample_count": count(kept),
        "ast_parse_success_count": count("NOT new AND parse_ok"),
        "ast_parse_failed_count": reason("ast_parse_failed"),
        "parse_failed_rows": count("NOT new AND NOT parse_ok"),
        **{f"{r}_count": reason(r) for r in INVALID_REASONS if r != "ast_parse_failed"},
        "invalid_removed_count": stage(INVALID_STAGE),
        **{f"{r}_count": reason(r) for r in LOW_QUALITY_REASONS},
        # Border rows passed every docstring rule, whatever later steps did with them.
        "border_count": count(f"NOT new AND {FACTS}.border AND {passed}"),
        "judged_count": count(f"NOT new AND judged IN ('high_quality', 'low_quality') AND {passed}"),
        "uncertain_count": count(f"NOT new AND {FACTS}.border AND judged = 'uncertain' AND {passed}"),
        "judged_removed_count": reason(JUDGED_LOW),
        "low_quality_docstring_count": stage(LOW_QUALITY_STAGE),
        "dedup_removed_count": stage(DEDUP_STAGE),
        "exact_dedup_removed_count": reason(EXACT),
        "ast_dedup_removed_count": reason(AST),
        "augmentation_attempt_count": count(f"NOT new AND {kept} AND {str(opts.enable_augmentation).lower()}"),
        "augmentation_success_count": count(f"new AND {kept}"),
        "augmentation_duplicate_dropped_count": reason(AUGMENT_DUPLICATE),
        **{f"{t}_count": count(f"{paired} AND {m}") for t, m in zip(PAIR_TYPES, made)},
        "skipped_instruction_pair_count": count(" AND ".join([paired, *[f"NOT {m}" for m in made]])),
        "_code_chars": F.expr(f"sum({FACTS}.code_chars) FILTER (WHERE {kept})"),
        "_code_n": count(f"{kept} AND {FACTS}.code_chars IS NOT NULL"),
        "_doc_chars": F.expr(f"sum({FACTS}.doc_chars) FILTER (WHERE {kept})"),
        "_doc_n": count(f"{kept} AND {FACTS}.doc_chars IS NOT NULL"),
        "_documented": count(f"{kept} AND {FACTS}.documented"),
        "_parsed": count(f"{kept} AND parse_ok"),
        "_named": count(f"{kept} AND {FACTS}.named"),
        "_annotated": count(f"{kept} AND {FACTS}.annotated"),
    }


def tag_metrics(
    tagged: DataFrame, roles: ColumnRoles, opts: PrepOptions = PrepOptions(), by: list[str] | str = ()
) -> DataFrame:
    """Every count and rate a run reports: one map-side combined aggregate over the tagged
    rows, grouped by data set if ``by`` is given."""
    by = as_list(by)
    narrow, totals = _counted(tagged, roles, opts, by)
    return with_ratios(narrow, by, totals, _RATIOS).withColumns({n: F.expr(e) for n, e in _SUMS.items()})


def metric_counts(
    tagged: DataFrame, roles: ColumnRoles, opts: PrepOptions = PrepOptions(), by: list[str] | str = ()
) -> DataFrame:
    """What ``tag_metrics`` counts, before it divides: counts of parts of a data set may be stored and
    added up later."""
    by = as_list(by)
    narrow, totals = _counted(tagged, roles, opts, by)
    return narrow.groupBy(*by).agg(*[c.alias(n) for n, c in totals.items()])


def metrics_of_counts(counts: DataFrame, by: list[str] | str = ()) -> DataFrame:
    """``tag_metrics`` of the whole from the ``metric_counts`` of its parts."""
    by = as_list(by)
    totals = {n: F.coalesce(F.sum(n), F.lit(0)) for n in counts.columns if n not in by}
    return with_ratios(counts, by, totals, _RATIOS).withColumns({n: F.expr(e) for n, e in _SUMS.items()})


def dataset_profile(metrics: DataFrame, by: list[str] | str = ()) -> DataFrame:
    return metrics.select(
        *as_list(by),
        "raw_sample_count",
        "final_sample_count",
        "avg_code_length",
        "avg_docstring_length",
        "docstring_coverage",
    )


def retain_rate(metrics: DataFrame, by: list[str] | str = ()) -> DataFrame:
    """final / raw; above 1 when rows were expanded or augmented."""
    ratio = safe_ratio(F.col("final_sample_count"), F.col("raw_sample_count"))
    return metrics.select(*as_list(by), ratio.alias("retain_rate"))


def quality_metrics(metrics: DataFrame, by: list[str] | str = ()) -> DataFrame:
    return metrics.select(
        *as_list(by),
        "retain_rate",
        "ast_parse_success_count",
        "ast_parse_failed_count",
        "empty_code_count",
        "low_quality_docstring_count",
        "dedup_removed_count",
        "exact_dedup_removed_count",
        "ast_dedup_removed_count",
        "syntax_pass_rate",
        "docstring_coverage",
        "function_name_match_rate",
        "return_annotation_rate",
    )


def run_metrics(metrics: DataFrame, by: list[str] | str = ()) -> DataFrame:
    return metrics.select(*as_list(by), *RUN_METRICS)


def metrics_long(wide: DataFrame, by: list[str] | str = ()) -> DataFrame:
    """(metric, value) rows; values as doubles."""
    by = as_list(by)
    names = [f.name for f in wide.schema if f.name not in by and f.dataType.typeName() in ("long", "integer", "double")]
    doubles = wide.select(*by, *[F.col(n).cast("double").alias(n) for n in names])
    return doubles.unpivot(by, names, "metric", "value")


def stage_log(
    metrics: DataFrame,
    by: list[str] | str = (),
    durations_ms: dict[str, int] | None = None,
    opts: PrepOptions | None = None,
) -> DataFrame:
    """Rows in, out and removed per step from the counts of ``tag_metrics``. ``durations_ms``
    holds driver-clock times of the steps that ended in an action; others stay NULL because
    Spark runs them fused. Steps that ``opts`` switched off have the status ``skipped``."""
    switches = {} if opts is None else {
        "extract_functions": opts.enable_ast_extract,
        DEDUP_STAGE: opts.enable_dedup,
        "augment_rename": opts.enable_augmentation,
        "build_pairs": opts.enable_instruction_pairs and opts.enable_ast_extract,
    }
    by = as_list(by)
    raw, expanded, final = (F.col(f"{n}_sample_count") for n in ("raw", "expanded", "final"))
    valid = expanded - F.col("invalid_removed_count")
    documented = valid - F.col("low_quality_docstring_count")
    unique = documented - F.col("dedup_removed_count")
    zero = F.lit(0).cast("long")
    flow = [
        (zero, raw, zero),
        (raw, raw, zero),
        (raw, expanded, zero),
        (expanded, valid, F.col("invalid_removed_count")),
        (valid, documented, F.col("low_quality_docstring_count")),
        (documented, unique, F.col("dedup_removed_count")),
        (unique, unique + F.col("augmentation_success_count"), zero),
        (final, final, zero),
        (final, final, zero),
        (final, final, zero),
        (zero, zero, zero),
    ]
    times = durations_ms or {}
    entries = [
        F.struct(
            F.lit(i).alias("ord"),
            F.lit(name).alias("stage"),
            F.lit("success" if switches.get(name, True) else "skipped").alias("status"),
            n_in.alias("input_n"),
            n_out.alias("output_n"),
            removed.alias("removed_n"),
            F.lit(times.get(name)).cast("long").alias("duration_ms"),
            F.concat(n_out.cast("string"), F.lit(" of "), n_in.cast("string")).alias("message"),
        )
        for i, (name, (n_in, n_out, removed)) in enumerate(zip(STAGES, flow))
    ]
    return metrics.select(*by, F.inline(F.array(*entries)))
