"""Charts, alerts, tiers and comparisons over metric tables.

Every operator takes a table with one row per run (or data set) and works on the whole run
history at once; ``by`` names the columns that identify a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import as_list
from ..functions.numbers import exact_round
from ..sources.staging import stage

Names = list[str] | str

# Metrics per chart.
CHARTS = {
    "sample_count_compare": ("samples", ["raw_sample_count", "final_sample_count"]),
    "filter_reasons": ("removed", ["empty_code_count", "ast_parse_failed_count", "low_quality_docstring_count"]),
    "dedup_results": ("removed", ["exact_dedup_removed_count", "ast_dedup_removed_count"]),
    "quality_metrics": (
        "rate",
        ["syntax_pass_rate", "docstring_coverage", "function_name_match_rate", "return_annotation_rate"],
    ),
}

# Alert thresholds.
RETAIN_WARN = 0.5
SYNTAX_WARN = 0.7
COVERAGE_WARN = 0.3
DEDUP_WARN = 0.4
AUGMENT_WARN = 0.5
PAIRS_WARN = 0.5

# Removal counts in reporting order.
REMOVAL_COUNTS = [
    "ast_parse_failed_count",
    "low_quality_docstring_count",
    "dedup_removed_count",
    "empty_code_count",
    "missing_function_name_count",
    "code_too_short_count",
    "code_too_long_count",
    "docstring_too_long_count",
]

# Metrics per question topic and the ones used when no topic applies.
TOPIC_METRICS = {
    "filter": REMOVAL_COUNTS,
    "ast": ["ast_parse_success_count", "ast_parse_failed_count", "syntax_pass_rate"],
    "dedup": ["dedup_removed_count", "exact_dedup_removed_count", "ast_dedup_removed_count"],
    "retain": ["raw_sample_count", "final_sample_count", "retain_rate"],
    "quality": [
        "retain_rate",
        "syntax_pass_rate",
        "docstring_coverage",
        "function_name_match_rate",
        "return_annotation_rate",
    ],
}
BASE_METRICS = ["raw_sample_count", "final_sample_count", "retain_rate"]

# Metrics of the comparison panel, and those shown as percentages.
PANEL_METRICS = [
    "raw_sample_count",
    "final_sample_count",
    "retain_rate",
    "ast_parse_success_count",
    "ast_parse_failed_count",
    "empty_code_count",
    "low_quality_docstring_count",
    "dedup_removed_count",
    "augmentation_success_count",
    "syntax_pass_rate",
    "docstring_coverage",
]
PANEL_RATES = ["retain_rate", "syntax_pass_rate", "docstring_coverage"]


def _metric(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _chart(metrics: DataFrame, chart: str, by: Names) -> DataFrame:
    series, names = CHARTS[chart]
    points = F.array(
        *[
            F.struct(
                F.lit(chart).alias("chart_id"),
                F.lit(i).alias("ord"),
                F.lit(n).alias("category"),
                F.lit(series).alias("series"),
                _metric(n).cast("double").alias("value"),
            )
            for i, n in enumerate(names)
        ]
    )
    return metrics.select(*as_list(by), F.inline(points))


def _any_positive(names: list[str]) -> Column:
    return F.greatest(*[_metric(n) for n in names]) > 0


def chart_sample_counts(metrics: DataFrame, by: Names = ()) -> DataFrame:
    return _chart(metrics, "sample_count_compare", by)


def chart_filter_reasons(metrics: DataFrame, by: Names = ()) -> DataFrame:
    """Only for runs in which one of the three counts is positive."""
    return _chart(metrics.where(_any_positive(CHARTS["filter_reasons"][1])), "filter_reasons", by)


def chart_dedup(metrics: DataFrame, by: Names = ()) -> DataFrame:
    return _chart(metrics.where(_any_positive(CHARTS["dedup_results"][1])), "dedup_results", by)


def chart_quality(metrics: DataFrame, by: Names = ()) -> DataFrame:
    return _chart(metrics, "quality_metrics", by)


def nest_charts(points: DataFrame, by: Names = ()) -> DataFrame:
    """Long chart rows to one row per chart with ``x_axis`` and ``series`` arrays."""
    by = as_list(by)
    ordered = F.sort_array(F.collect_list(F.struct("ord", "category", "value")))
    lines = points.groupBy(*by, "chart_id", "series").agg(ordered.alias("p"))
    return lines.groupBy(*by, "chart_id").agg(
        F.first(F.transform("p", lambda e: e["category"])).alias("x_axis"),
        F.collect_list(F.struct(F.col("series").alias("name"), F.transform("p", lambda e: e["value"]).alias("data"))).alias(
            "series"
        ),
    )


# Where to look first when an alert is raised: views and counts of this library.
SUGGESTIONS = {
    "low_retain_rate": "see badcases grouped by drop_reason for the rule that takes most rows",
    "low_syntax_pass_rate": "group error_message of rows that did not parse; fragments have no function",
    "low_docstring_coverage": "compare documented rows before and after the docstring filter, or lower docstring_min_len",
    "high_dedup_share": "list the largest dup_groups and the sources they come from",
    "low_augmentation_success": "count aug_status; rows without local names cannot be renamed",
    "no_instruction_pairs": "check that the docstring role names a filled column",
    "few_instruction_pairs": "look at rows with code but neither docstring nor docstring_in_code",
}


def _alerts(pairs_enabled: bool) -> Column:
    """array<struct> of the broken rules of one metrics row."""
    raw, final = _metric("raw_sample_count"), _metric("final_sample_count")
    success, fail = _metric("augmentation_success_count"), _metric("augmentation_failed_count")
    pairs = _metric("instruction_pair_count")
    dedup_share = F.try_divide(_metric("dedup_removed_count").cast("double"), raw.cast("double"))
    aug_rate = F.try_divide(success.cast("double"), (success + fail).cast("double"))
    pairs_per_row = F.try_divide(pairs.cast("double"), final.cast("double"))
    asked = F.lit(pairs_enabled) & (final > 0)
    has_rows = raw > 0
    rules = [
        ("low_retain_rate", has_rows & (_metric("retain_rate") < RETAIN_WARN), _metric("retain_rate"), RETAIN_WARN),
        ("low_syntax_pass_rate", has_rows & (_metric("syntax_pass_rate") < SYNTAX_WARN), _metric("syntax_pass_rate"), SYNTAX_WARN),
        ("low_docstring_coverage", has_rows & (_metric("docstring_coverage") < COVERAGE_WARN), _metric("docstring_coverage"), COVERAGE_WARN),
        ("high_dedup_share", dedup_share > DEDUP_WARN, dedup_share, DEDUP_WARN),
        ("low_augmentation_success", aug_rate < AUGMENT_WARN, aug_rate, AUGMENT_WARN),
        ("no_instruction_pairs", asked & (pairs == 0), pairs_per_row, PAIRS_WARN),
        ("few_instruction_pairs", asked & (pairs > 0) & (pairs_per_row < PAIRS_WARN), pairs_per_row, PAIRS_WARN),
    ]
    raised = [
        F.when(
            condition,
            F.struct(
                F.lit(name).alias("alert"),
                value.cast("double").alias("value"),
                F.lit(limit).alias("threshold"),
                F.lit(SUGGESTIONS[name]).alias("suggestion"),
            ),
        )
        for name, condition, value, limit in rules
    ]
    return F.array_compact(F.array(*raised))


def quality_alerts(metrics: DataFrame, pairs_enabled: bool = True, by: Names = ()) -> DataFrame:
    """One row per broken rule with the measured value, its threshold and advice."""
    return metrics.select(*as_list(by), F.inline(_alerts(pairs_enabled)))


def alert_summary(metrics: DataFrame, pairs_enabled: bool = True, by: Names = ()) -> DataFrame:
    """Number of alerts per run: none is good, one needs attention, more are problems."""
    counted = metrics.withColumn("alerts", F.size(_alerts(pairs_enabled)).cast("long"))
    level = F.when(F.col("alerts") == 0, "good").when(F.col("alerts") == 1, "attention").otherwise("problems")
    return counted.select(
        *as_list(by), "raw_sample_count", "final_sample_count", "retain_rate", "alerts", level.alias("level")
    )


def removal_reasons(metrics: DataFrame, by: Names = ()) -> DataFrame:
    """The causes that removed rows, most telling first."""
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("ord"), F.lit(n).alias("metric"), _metric(n).alias("value"))
            for i, n in enumerate(REMOVAL_COUNTS)
        ]
    )
    return metrics.select(*as_list(by), F.inline(F.filter(rows, lambda e: e["value"] > 0)))


def parse_summary(metrics: DataFrame, by: Names = ()) -> DataFrame:
    """Success, failure and pass rate of runs that parsed anything."""
    seen = metrics.where(_metric("ast_parse_success_count") + _metric("ast_parse_failed_count") > 0)
    return seen.select(*as_list(by), *TOPIC_METRICS["ast"])


def dedup_summary(metrics: DataFrame, by: Names = ()) -> DataFrame:
    """Totals of runs that removed copies."""
    return metrics.where(_metric("dedup_removed_count") > 0).select(*as_list(by), *TOPIC_METRICS["dedup"])


def general_summary(metrics: DataFrame, by: Names = ()) -> DataFrame:
    return metrics.select(*as_list(by), *BASE_METRICS)


# Borders of tiers and bands, and the span of the progress shown.
RETAIN_TIERS = {"high": 0.8, "medium": 0.6}
QUALITY_TIERS = {"excellent": (0.8, 0.9, 0.7), "good": (0.6, 0.8, 0.0), "medium": (0.4, 0.0, 0.0)}
RATE_BANDS = {"good": 0.8, "warn": 0.5}
PROGRESS_START, PROGRESS_SPAN = 10, 85


def _first_reached(borders: dict[str, Column], last: Column | None) -> Column:
    """The first name whose condition holds."""
    names = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in borders.items()]))
    return F.coalesce(F.get(names, F.lit(0)), last)


def retain_tier(rate: Column) -> Column:
    return _first_reached({name: rate >= border for name, border in RETAIN_TIERS.items()}, F.lit("low"))


def quality_tier(retain: Column, syntax: Column, coverage: Column) -> Column:
    reached = {
        name: (retain >= r) & ((syntax >= s) if s else F.lit(True)) & ((coverage >= c) if c else F.lit(True))
        for name, (r, s, c) in QUALITY_TIERS.items()
    }
    return _first_reached(reached, F.lit("low"))


def rate_band(rate: Column) -> Column:
    reached = {name: rate >= border for name, border in RATE_BANDS.items()}
    return _first_reached(reached, F.when(rate.isNotNull(), F.lit("danger")))


def refer_metrics(long: DataFrame, topics: DataFrame, by: Names) -> DataFrame:
    """The metrics that answer each question: those of its topics (removal counts only when
    positive), or the three base metrics if no topic has any.

    ``topics`` has the run columns and an array ``topics``; each metric row looks its own
    topics up, so there is one equi-join and no row per (question, topic) pair."""
    by = as_list(by)
    own = F.array_compact(
        F.array(*[F.when(F.col("metric").isin(names), F.lit(topic)) for topic, names in TOPIC_METRICS.items()])
    )
    asked = long.join(topics, by)
    other = F.array_remove(own, "filter")
    wanted = F.arrays_overlap(other, F.col("topics")) | (
        F.array_contains(own, "filter") & F.array_contains("topics", "filter") & (F.col("value") > 0)
    )
    per_question = Window.partitionBy(*by)  # a run's metrics: a fixed, small number of rows
    marked = asked.withColumn("_wanted", F.coalesce(wanted, F.lit(False)))
    marked = marked.withColumn("_any", F.max("_wanted").over(per_question))
    chosen = F.col("_wanted") | (~F.col("_any") & F.col("metric").isin(BASE_METRICS))
    return marked.where(chosen).select(*by, "metric", "value")


def compare_rounds(before: DataFrame, after: DataFrame, by: Names = ()) -> DataFrame:
    """Metrics present in both rounds: change (4 decimals) and change in percent of the first
    value (2 decimals, 0 if it was 0)."""
    keys = [*as_list(by), "metric"]
    both = before.withColumnRenamed("value", "before").join(after.withColumnRenamed("value", "after"), keys)
    both = both.where(F.col("before").isNotNull() & F.col("after").isNotNull())
    change = F.col("after") - F.col("before")

    def nearest(x: Column, scale: float) -> Column:
        return F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)

    share = F.when(F.col("before") != 0, F.floor(change / F.col("before") * 10000.0 + 0.5).cast("double") / 100.0)
    return both.select(
        *keys, "before", "after", nearest(change, 10000.0).alias("delta"), F.coalesce(share, F.lit(0.0)).alias("delta_percent")
    )


def compare_panel(before: DataFrame, after: DataFrame, by: Names = ()) -> DataFrame:
    """The eleven panel metrics of two rounds; a metric missing on one side stays, with NULL
    change. Rates are shown and compared as percentages; the relative change refers to the
    absolute first value (1 decimal) and is NULL if that is 0."""
    keys = [*as_list(by), "metric"]
    wanted = F.col("metric").isin(PANEL_METRICS)
    b = before.where(wanted).select(*keys, F.col("value").alias("b"))
    a = after.where(wanted).select(*keys, F.col("value").alias("a"))
    both = b.join(a, keys, "full_outer").where(F.col("a").isNotNull() | F.col("b").isNotNull())
    is_rate = F.col("metric").isin(PANEL_RATES)

    def shown(x: Column) -> Column:
        return F.when(is_rate, exact_round(x * 100, 1, "away")).otherwise(x)

    change = F.col("a") - F.col("b")
    relative = F.when(F.col("b") != 0, F.try_divide(change, F.abs("b")) * 100)
    order = F.array_position(F.array(*[F.lit(m) for m in PANEL_METRICS]), F.col("metric"))
    return both.select(
        *keys,
        order.cast("int").alias("ord"),
        shown(F.col("b")).alias("before"),
        shown(F.col("a")).alias("after"),
        exact_round(F.when(is_rate, change * 100).otherwise(change), 2, "away").alias("delta"),
        exact_round(relative, 1, "away").alias("delta_percent"),
    )


def round_lineage(runs: DataFrame) -> DataFrame:
    """run_id, parent_run_id, root_run_id, round and cyclic of each run. A run without parent is a root
    and round 0; a child's round is its parent's plus one, the parent's being its recorded ``round`` or,
    where that is NULL, derived in turn, so chains of new runs of any depth come out right. A parent
    that is not in the table counts as a root. Runs on a cycle, or below one, are flagged and have
    neither root nor round, unless a recorded round stands between.

    ``runs`` has run_id (unique), parent_run_id and round. Pointer doubling: in step k a run knows its
    ancestor 2^k above and the nearest recorded round up to there, and asks that ancestor for the same,
    so a chain of a million runs takes twenty narrow joins. Every step is a written table. Joins are
    shuffled: small tables that Spark would broadcast add up on the driver, step by step."""
    parents = runs.select(F.col("run_id").alias("at"), F.col("round").alias("known"), F.col("parent_run_id").alias("above"))
    first = runs.where(F.col("parent_run_id").isNotNull()).select("run_id", "parent_run_id").join(
        parents.hint("shuffle_merge"), F.col("parent_run_id") == F.col("at"), "left"
    )
    # up: the ancestor reached; hops: steps to it; base, off: nearest recorded round and steps to it;
    # more: whether the ancestor has a parent.
    state = stage(
        first.select(
            "run_id",
            "parent_run_id",
            F.col("parent_run_id").alias("up"),
            F.lit(1).cast("long").alias("hops"),
            F.col("known").cast("long").alias("base"),
            F.when(F.col("known").isNotNull(), F.lit(1)).cast("long").alias("off"),
            F.col("above").isNotNull().alias("more"),
        ),
        "lineage",
    )
    total, reach = state.count(), 1
    while reach <= total and not state.where("more").isEmpty():
        next_hop = state.select(
            F.col("run_id").alias("n_id"), *[F.col(c).alias(f"n_{c}") for c in ("up", "hops", "base", "off", "more")]
        )
        met = state.where("more").join(next_hop.hint("shuffle_merge"), F.col("up") == F.col("n_id"))
        moved = met.select(
            "run_id",
            "parent_run_id",
            F.col("n_up").alias("up"),
            (F.col("hops") + F.col("n_hops")).alias("hops"),
            F.coalesce("base", "n_base").alias("base"),
            F.coalesce("off", F.col("hops") + F.col("n_off")).alias("off"),
            F.col("n_more").alias("more"),
        )
        # Finished runs stay, as others may point to them.
        state = stage(moved.unionByName(state.where("not more")), "lineage")
        reach *= 2
    cyclic = F.col("more")
    known = F.when(F.col("base").isNotNull(), F.col("base") + F.col("off")).when(~cyclic, F.col("hops"))
    below = state.select("run_id", "parent_run_id", F.when(~cyclic, F.col("up")).alias("root_run_id"), known.cast("int").alias("round"), cyclic.alias("cyclic"))
    roots = runs.where(F.col("parent_run_id").isNull()).select(
        "run_id", "parent_run_id", F.col("run_id").alias("root_run_id"), F.lit(0).alias("round"), F.lit(False).alias("cyclic")
    )
    return below.unionByName(roots)


def round_trend(runs: DataFrame, metric: str, root: str = "root_run_id") -> DataFrame:
    """A metric over the rounds of each lineage with the change since the previous round."""
    previous = F.lag(metric).over(Window.partitionBy(root).orderBy("round"))
    return runs.select(root, "run_id", "round", metric, (F.col(metric) - previous).alias("change"))


def latest_progress(events: DataFrame, key: str, order: list[str], payload: list[str]) -> DataFrame:
    """The last event per key: a map-side combined ``max``, no window over a key's events."""
    last = F.max(F.struct(*order, *payload)).alias("_last")
    rows = events.groupBy(key).agg(last)
    return rows.select(key, *[F.col(f"_last.{c}").alias(c) for c in (*order, *payload)])


def stage_progress(index: Column, total: Column) -> Column:
    """Percent shown when ``index`` of ``total`` steps are done: 10 to 95."""
    done = F.try_divide(index.cast("double"), F.greatest(total, F.lit(1)).cast("double"))
    return (F.floor(done * PROGRESS_SPAN) + PROGRESS_START).cast("int")


