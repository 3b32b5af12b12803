"""Rules at their boundaries, in their order."""

import pytest
from pyspark.sql import functions as F

from defgrain.config import ColumnRoles
from defgrain.operators import tags

CODE = ColumnRoles("code")
BOTH = ColumnRoles("code", "doc")


def reasons(df):
    return {r._row_id: r.drop_reason for r in df.select("_row_id", "drop_reason").collect()}


def test_code_lengths(samples):
    lengths = {1: 9, 2: 10, 3: 8000, 4: 8001}
    df = samples([(i, "x" * n) for i, n in lengths.items()])
    assert reasons(tags.tag_invalid(df, CODE)) == {1: "code_too_short", 2: None, 3: None, 4: "code_too_long"}


def test_docstring_length_counts_blanks(samples):
    df = samples([(1, "x" * 10, "d" * 2000), (2, "x" * 10, "d" * 2000 + " "), (3, "x" * 10, None)])
    assert reasons(tags.tag_invalid(df, BOTH)) == {1: None, 2: "docstring_too_long", 3: None}


def test_first_rule_wins(spark):
    rows = [
        (1, " ", False, None),
        (2, "x", False, None),
        (3, "x", True, " "),
        (4, "x", True, "f"),
        (5, "x", None, None),
        (6, "x" * 20, None, None),
        (7, None, True, "f"),
    ]
    df = spark.createDataFrame(rows, "_row_id long, code string, parse_ok boolean, function_name string")
    assert reasons(tags.tag_invalid(df, CODE)) == {
        1: "empty_code",
        2: "ast_parse_failed",
        3: "missing_function_name",
        4: "code_too_short",
        5: "code_too_short",
        6: None,
        7: "empty_code",
    }


@pytest.mark.parametrize(
    "min_len, expected",
    [
        (5, {1: "short_docstring", 2: None, 3: "short_docstring", 4: "placeholder_docstring", 5: "empty_docstring", 6: "repetitive_docstring"}),
        (3, {1: None, 2: None, 3: "placeholder_docstring", 4: "placeholder_docstring", 5: "empty_docstring", 6: "repetitive_docstring"}),
    ],
)
def test_docstring_rules(spark, min_len, expected):
    docs = {1: "abcd", 2: "abcde", 3: "todo", 4: " fixme ", 5: " \t", 6: "load_it function"}
    df = spark.createDataFrame([(i, "x", d, "load_it") for i, d in docs.items()], "_row_id long, code string, doc string, function_name string")
    assert reasons(tags.tag_low_quality(df, BOTH, min_len)) == expected


def test_no_docstring_role_passes_through(samples):
    assert reasons(tags.tag_low_quality(samples([(1, "x")]), CODE)) == {1: None}


def test_earlier_tag_stays(samples):
    df = tags.tag_low_quality(tags.tag_invalid(samples([(1, " ", "")]), BOTH), BOTH)
    row = df.first()
    assert (row.drop_stage, row.drop_reason) == ("filter_invalid", "empty_code")


def test_counts_add_up(samples):
    df = samples([(i, "x" * (i % 13)) for i in range(100)])
    tagged = tags.tag_invalid(df, CODE)
    removed = sum(r.n for r in tags.invalid_reason_counts(tagged).collect())
    assert removed == tags.badcases(tagged).count() == 100 - tags.filter_invalid(df, CODE).count()
    assert tags.invalid_reason_counts(tagged).count() == len(tags.INVALID_REASONS)


@pytest.mark.parametrize("n", [1, 19, 301, 600])
def test_all_border_rows_are_offered(samples, n):
    rows = samples([(i, "x", "d" * 30) for i in range(n)])
    assert sorted(r._row_id for r in tags.border_candidates(rows, BOTH).collect()) == list(range(n))
    assert sorted(r._row_id for r in tags.border_candidates(rows, BOTH, limit=7).collect()) == list(range(min(n, 7)))


def test_border_rows_of_each_data_set(samples):
    rows = samples([(i, "x", "d" * 30) for i in range(1200)]).withColumn("ds", F.col("_row_id") % 2)
    assert tags.border_candidates(rows, BOTH, by="ds").groupBy("ds").count().select("count").distinct().collect() == [(600,)]
    limited = tags.border_candidates(rows, BOTH, by="ds", limit=3)
    assert {(r.ds, r._row_id) for r in limited.collect()} == {(0, 0), (1, 1), (0, 2), (1, 3), (0, 4), (1, 5)}


def test_user_columns_are_no_tags(spark):
    df = spark.createDataFrame(
        [(1, "x" * 20, "mine", "old", "gold"), (2, "x", None, None, None)],
        "_row_id long, code string, drop_reason string, drop_stage string, verdict string",
    )
    tagged = tags.tag_invalid(df, CODE)
    assert reasons(tagged) == {1: None, 2: "code_too_short"}
    kept = tags.filter_invalid(df, CODE).collect()
    assert [(r._row_id, r.user_drop_reason, r.user_drop_stage) for r in kept] == [(1, "mine", "old")]
    assert tags.filter_invalid(df.drop("drop_stage"), CODE).count() == 1
    verdicts = spark.createDataFrame([(1, "low_quality")], "_row_id long, verdict string")
    judged = {r._row_id: (r.verdict, r.user_verdict, r.drop_reason) for r in tags.apply_verdicts(df, verdicts).collect()}
    assert judged == {1: ("low_quality", "gold", "judged_low_quality"), 2: ("uncertain", None, None)}


def test_limits_are_options(samples):
    from defgrain.config import PrepOptions

    df = samples([(1, "x" * 5, "d" * 30), (2, "x" * 50, "d"), (3, "x" * 20, "d" * 9)])
    opts = PrepOptions(code_min_len=4, code_max_len=40, docstring_max_len=20)
    assert reasons(tags.tag_invalid(df, BOTH, opts)) == {1: "docstring_too_long", 2: "code_too_long", 3: None}


def test_border_lengths(samples):
    lengths = [9, 10, 60, 61]
    df = samples([(i, "x", "d" * n) for i, n in enumerate(lengths)] + [(i + 10, "x", "") for i in range(20)])
    assert {r._row_id for r in tags.border_candidates(df, BOTH).collect()} == {1, 2}


def test_verdicts(spark, samples):
    df = samples([(i, "x", "d" * 30) for i in range(5)])
    verdicts = spark.createDataFrame(
        [(0, "low_quality"), (1, "high_quality"), (2, "nonsense"), (3, "low_quality"), (3, "high_quality"), (9, "low_quality")],
        "_row_id long, verdict string",
    )
    judged = tags.apply_verdicts(df, verdicts)
    assert {r._row_id: (r.verdict, r.drop_reason) for r in judged.collect()} == {
        0: ("low_quality", "judged_low_quality"),
        1: ("high_quality", None),
        2: ("uncertain", None),
        3: ("high_quality", None),
        4: ("uncertain", None),
    }


def test_streams_and_batches_share_expressions(samples):
    df = tags.tag_invalid(samples([(1, "x" * 20)]), CODE)
    assert "Exchange" not in df.select(F.col("drop_reason"))._jdf.queryExecution().optimizedPlan().toString()
