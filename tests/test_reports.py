"""Metrics, thresholds on both sides, and comparisons."""

import pytest
from pyspark.sql import functions as F

from defgrain.config import ColumnRoles
from defgrain.operators import metrics as met
from defgrain.operators import report as rp
from defgrain.operators.extract import extract_functions

BOTH = ColumnRoles("code", "doc")


def metrics_row(spark, **values):
    base = {
        "run": "r",
        "raw_sample_count": 100,
        "final_sample_count": 90,
        "retain_rate": 0.9,
        "ast_parse_success_count": 95,
        "ast_parse_failed_count": 0,
        "empty_code_count": 0,
        "low_quality_docstring_count": 0,
        "dedup_removed_count": 0,
        "exact_dedup_removed_count": 0,
        "ast_dedup_removed_count": 0,
        "missing_function_name_count": 0,
        "code_too_short_count": 0,
        "code_too_long_count": 0,
        "docstring_too_long_count": 0,
        "augmentation_success_count": 0,
        "augmentation_failed_count": 0,
        "syntax_pass_rate": 0.95,
        "docstring_coverage": 0.8,
        "function_name_match_rate": 1.0,
        "return_annotation_rate": 0.0,
        "instruction_pair_count": 200,
    }
    assert set(values) <= set(base)
    return spark.createDataFrame([{**base, **values}])


def alerts(spark, **values):
    enabled = values.pop("pairs_enabled", True)
    return {r.alert for r in rp.quality_alerts(metrics_row(spark, **values), enabled).collect()}


@pytest.mark.parametrize(
    "values, expected",
    [
        ({}, set()),
        ({"retain_rate": 0.5, "syntax_pass_rate": 0.7, "docstring_coverage": 0.3, "dedup_removed_count": 40}, set()),
        ({"retain_rate": 0.4999}, {"low_retain_rate"}),
        ({"syntax_pass_rate": 0.6999}, {"low_syntax_pass_rate"}),
        ({"docstring_coverage": 0.2999}, {"low_docstring_coverage"}),
        ({"dedup_removed_count": 41}, {"high_dedup_share"}),
        ({"augmentation_success_count": 1, "augmentation_failed_count": 1}, set()),
        ({"augmentation_success_count": 1, "augmentation_failed_count": 2}, {"low_augmentation_success"}),
        ({"instruction_pair_count": 0}, {"no_instruction_pairs"}),
        ({"instruction_pair_count": 45}, set()),
        ({"instruction_pair_count": 44}, {"few_instruction_pairs"}),
        ({"instruction_pair_count": 0, "pairs_enabled": False}, set()),
        ({"raw_sample_count": 0, "final_sample_count": 0, "retain_rate": 0.0, "syntax_pass_rate": 0.0}, set()),
    ],
)
def test_alerts(spark, values, expected):
    assert alerts(spark, **values) == expected


def test_alert_summary(spark):
    levels = [
        rp.alert_summary(metrics_row(spark, **v)).first().level
        for v in ({}, {"retain_rate": 0.1}, {"retain_rate": 0.1, "syntax_pass_rate": 0.1})
    ]
    assert levels == ["good", "attention", "problems"]


def test_charts_are_guarded(spark):
    clean = metrics_row(spark)
    assert rp.chart_filter_reasons(clean).isEmpty() and rp.chart_dedup(clean).isEmpty()
    assert rp.chart_sample_counts(clean).count() == 2 and rp.chart_quality(clean).count() == 4
    dirty = metrics_row(spark, empty_code_count=1, ast_dedup_removed_count=2)
    assert [r.value for r in rp.chart_filter_reasons(dirty).orderBy("ord").collect()] == [1.0, 0.0, 0.0]
    assert [r.value for r in rp.chart_dedup(dirty).orderBy("ord").collect()] == [0.0, 2.0]


def test_nested_charts(spark):
    chart = rp.nest_charts(rp.chart_sample_counts(metrics_row(spark))).first()
    assert chart.x_axis == ["raw_sample_count", "final_sample_count"]
    assert [(s.name, s.data) for s in chart.series] == [("samples", [100.0, 90.0])]


@pytest.mark.parametrize("rate, tier, band", [(0.8, "high", "good"), (0.7999, "medium", "warn"), (0.6, "medium", "warn"), (0.5999, "low", "warn"), (0.4999, "low", "danger")])
def test_tiers(spark, rate, tier, band):
    row = spark.range(1).select(rp.retain_tier(F.lit(rate)).alias("t"), rp.rate_band(F.lit(rate)).alias("b")).first()
    assert (row.t, row.b) == (tier, band)


@pytest.mark.parametrize("rates, tier", [((0.8, 0.9, 0.7), "excellent"), ((0.8, 0.9, 0.69), "good"), ((0.6, 0.8, 0.0), "good"), ((0.4, 0.0, 0.0), "medium"), ((0.39, 1.0, 1.0), "low")])
def test_quality_tier(spark, rates, tier):
    assert spark.range(1).select(rp.quality_tier(*map(F.lit, rates))).first()[0] == tier


def test_removal_reasons_in_order(spark):
    row = metrics_row(spark, docstring_too_long_count=1, dedup_removed_count=2, empty_code_count=3)
    got = [(r.metric, r.value) for r in rp.removal_reasons(row).orderBy("ord").collect()]
    assert got == [("dedup_removed_count", 2), ("empty_code_count", 3), ("docstring_too_long_count", 1)]


def test_summaries_need_something_to_tell(spark):
    assert rp.parse_summary(metrics_row(spark, ast_parse_success_count=0)).isEmpty()
    assert rp.dedup_summary(metrics_row(spark)).isEmpty()
    assert rp.general_summary(metrics_row(spark)).first().retain_rate == 0.9


def long(spark, values):
    return spark.createDataFrame(list(values.items()), "metric string, value double")


def test_compare_rounds(spark):
    before = long(spark, {"a": 3.0, "zero": 0.0, "gone": 1.0, "rate": 0.12345, "nul": None})
    after = long(spark, {"a": 4.0, "zero": 5.0, "new": 1.0, "rate": 0.1, "nul": 1.0})
    got = {r.metric: (r.delta, r.delta_percent) for r in rp.compare_rounds(before, after).collect()}
    assert got == {"a": (1.0, 33.33), "zero": (5.0, 0.0), "rate": (-0.0234, -19.0)}


def test_compare_panel(spark):
    before = long(spark, {"retain_rate": 0.5, "raw_sample_count": 0.0, "empty_code_count": 8.0, "other": 1.0})
    after = long(spark, {"retain_rate": 0.8333, "raw_sample_count": 10.0, "dedup_removed_count": 2.0})
    got = {r.metric: r for r in rp.compare_panel(before, after).collect()}
    assert set(got) == {"retain_rate", "raw_sample_count", "empty_code_count", "dedup_removed_count"}
    rate = got["retain_rate"]
    assert (rate.before, rate.after, rate.delta, rate.delta_percent) == (50.0, 83.3, 33.33, 66.7)
    assert (got["raw_sample_count"].delta, got["raw_sample_count"].delta_percent) == (10.0, None)
    assert (got["empty_code_count"].after, got["empty_code_count"].delta) == (None, None)
    assert got["dedup_removed_count"].before is None


def test_refer_metrics(spark):
    values = {m: 0.0 for m in {*met.RUN_METRICS, *rp.REMOVAL_COUNTS}} | {"empty_code_count": 2.0, "retain_rate": 0.5}
    runs = ["filter", "ast", "none", "both", "clean"]
    rows = [(r, m, v if r != "clean" else 0.0) for r in runs for m, v in values.items()]
    metrics = spark.createDataFrame(rows, "run string, metric string, value double")
    topics = spark.createDataFrame(
        [("filter", ["filter"]), ("ast", ["ast"]), ("none", []), ("both", ["filter", "dedup"]), ("clean", ["filter"])],
        "run string, topics array<string>",
    )
    got = {}
    for r in rp.refer_metrics(metrics, topics, "run").collect():
        got.setdefault(r.run, set()).add(r.metric)
    assert got["filter"] == {"empty_code_count"}
    assert got["ast"] == set(rp.TOPIC_METRICS["ast"])
    assert got["none"] == got["clean"] == set(rp.BASE_METRICS)
    assert got["both"] == {"empty_code_count", *rp.TOPIC_METRICS["dedup"]}


def test_lineage_and_trend(spark):
    runs = spark.createDataFrame(
        [("a", None, 0, "a", 0.5), ("b", "a", 1, "a", 0.75), ("c", "b", None, "a", 0.25), ("d", None, None, "d", 1.0)],
        "run_id string, parent_run_id string, round int, root_run_id string, retain_rate double",
    )
    rounds = rp.round_lineage(runs)
    assert {r.run_id: r["round"] for r in rounds.collect()} == {"a": 0, "b": 1, "c": 2, "d": 0}
    trend = rp.round_trend(runs.select("run_id", "retain_rate").join(rounds, "run_id"), "retain_rate")
    assert {r.run_id: r.change for r in trend.collect()} == {"a": None, "b": 0.25, "c": -0.5, "d": None}


def slow_lineage(rows):
    parent, recorded = {r: p for r, p, _ in rows}, {r: n for r, _, n in rows}
    out = {}
    for run in parent:
        at, hops, base, seen = run, 0, None, set()
        while parent.get(at) is not None and at not in seen:
            seen.add(at)
            at, hops = parent[at], hops + 1
            if base is None and recorded.get(at) is not None:
                base = recorded[at] + hops
        loop = parent.get(at) is not None
        depth = None if loop else hops
        out[run] = (None if loop else at, 0 if hops == 0 else depth if base is None else base, loop)
    return out


def test_lineage_of_any_shape(spark):
    """A long chain, a star, recorded rounds in between, unknown parents, loops and what hangs below."""
    rows = [(i, i - 1 if i else None, None) for i in range(300)]
    rows += [(1000 + i, 0 if i % 2 else 299, 7 if i % 5 == 0 else None) for i in range(40)]
    rows += [(2000 + i, 1000 + i, None) for i in range(40)]
    rows += [(3000, 9999, None), (3001, 3000, None)]
    rows += [(4000, 4002, None), (4001, 4000, 5), (4002, 4001, None), (4003, 4002, None), (4010, 4010, None), (4011, 4010, None)]
    got = {}
    for r in rp.round_lineage(spark.createDataFrame(rows, "run_id long, parent_run_id long, round int")).collect():
        assert r["run_id"] not in got
        got[r["run_id"]] = (r["root_run_id"], r["round"], r["cyclic"])
    assert got == slow_lineage(rows)
    assert rp.round_lineage(spark.createDataFrame([], "run_id long, parent_run_id long, round int")).count() == 0


def test_progress(spark):
    steps = spark.range(12).select(rp.stage_progress(F.col("id"), F.lit(11)).alias("p"))
    assert [r.p for r in steps.collect()] == [10 + int(i / 11 * 85) for i in range(12)]
    events = spark.createDataFrame([(1, 5, "x"), (1, 9, "y"), (2, 1, "z"), (1, 7, "w")], "k int, seq int, what string")
    last = rp.latest_progress(events, "k", ["seq"], ["what"])
    assert {(r.k, r.what) for r in last.collect()} == {(1, "y"), (2, "z")}


def test_profile_rules(samples):
    rows = [(1, "x = 1", "abc"), (2, "", None), (3, "def f(): 'in code'", ""), (4, "def f() -> None: 'in'", "  ")]
    df = extract_functions(samples(rows), BOTH)
    assert met.avg_text_length(df, "doc").first()[0] == 2.5
    # A blank docstring column wins over the one in the code, so row 4 is not covered.
    assert met.docstring_coverage(df, BOTH).first()[0] == 0.5
    assert met.syntax_pass_rate(df).first()[0] == 0.5
    assert met.function_name_rate(df).first()[0] == 0.5
    assert met.return_annotation_rate(df).first()[0] == 0.0
    assert met.avg_text_length(df.where("false"), "doc").first()[0] == 0.0


def test_lineage_broadcasts_no_runs(spark, monkeypatch):
    """Tables under the broadcast limit would go through the driver at every step."""
    plans, stage = [], rp.stage

    def watched(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, name)

    monkeypatch.setattr(rp, "stage", watched)
    runs = spark.range(40).selectExpr("id AS run_id", "IF(id % 20 = 0, NULL, id - 1) AS parent_run_id", "CAST(NULL AS INT) AS round")
    assert {(r["run_id"], r["root_run_id"], r["round"]) for r in rp.round_lineage(runs).collect()} == {(i, i - i % 20, i % 20) for i in range(40)}
    assert len(plans) > 4 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)
