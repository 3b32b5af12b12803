"""First wins, whatever the partitioning and however hot a text is."""

import random

import pytest
from pyspark.sql import functions as F

from defgrain.config import ColumnRoles
from defgrain.operators import dedup as dd
from defgrain.operators.extract import extract_functions
from defgrain.operators.tags import add_tag

CODE = ColumnRoles("code")


def tags_of(df):
    return {r._row_id: r.drop_reason for r in df.select("_row_id", "drop_reason").collect()}


def brute_force(rows, by=None):
    seen_text, seen_tree, out = set(), set(), {}
    for row in sorted(rows):
        key, code, ok, tree, group = row
        out[key] = None
        if code:
            if (group, code) in seen_text:
                out[key] = dd.EXACT
                continue
            seen_text.add((group, code))
        if ok and tree is not None:
            if (group, tree) in seen_tree:
                out[key] = dd.AST
            seen_tree.add((group, tree))
    return out


SCHEMA = "_row_id long, code string, parse_ok boolean, ast_hash string, grp string"


def corpus(n=3000):
    """A third of all rows share one text; another third share a tree under many texts."""
    rng = random.Random(3)
    rows = []
    for i in range(n):
        kind = i % 3
        if kind == 0:
            rows.append((i, "hot text", True, "aa", "g1"))
        elif kind == 1:
            rows.append((i, f"text {rng.randrange(200)}", True, "bb", rng.choice(["g1", "g2"])))
        else:
            code = rng.choice([None, "", "  ", f"u{rng.randrange(300)}"])
            rows.append((i, code, rng.choice([True, False, None]) if code else False, None, rng.choice(["g1", None])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("partitions", [1, 13])
def test_matches_brute_force(spark, partitions):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    assert tags_of(dd.tag_duplicates(df, CODE)) == brute_force([(*r[:4], None) for r in rows])


def test_within_groups(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    assert tags_of(dd.tag_duplicates(df, CODE, by="grp")) == brute_force(rows)


def test_no_partition_is_hot(spark):
    """The hot text must be reduced before the shuffle and nothing windowed over its rows."""
    df = spark.createDataFrame(corpus(), SCHEMA)
    plan = dd.tag_duplicates(df, CODE)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_min" in plan


def test_empty_code_is_kept_and_blank_code_is_hashed(samples):
    df = samples([(1, None), (2, None), (3, ""), (4, ""), (5, " "), (6, " ")])
    assert tags_of(dd.tag_duplicates(df, CODE)) == {1: None, 2: None, 3: None, 4: None, 5: None, 6: dd.EXACT}


def test_dropped_rows_do_not_win(samples):
    df = samples([(1, "same"), (2, "same"), (3, "same")])
    tagged = add_tag(df, "x", F.when(F.col("_row_id") == 1, "x"))
    assert tags_of(dd.tag_duplicates(tagged, CODE)) == {1: "x", 2: None, 3: dd.EXACT}


def test_switches(samples):
    df = extract_functions(samples([(1, "def f(): return 1"), (2, "def f():\n  return 1"), (3, "def f(): return 1")]), CODE)
    assert dd.dedup_samples(df, CODE).count() == 1
    assert dd.dedup_samples(df, CODE, ast=False).count() == 2
    assert dd.dedup_samples(df, CODE, enabled=False).count() == 3
    assert dd.dedup_ast(df, CODE).count() == 1


def test_tree_rule_needs_extraction(samples):
    df = samples([(1, "def f(): return 1"), (2, "def f():  return 1")])
    assert dd.dedup_ast(df, CODE).count() == 2


def test_second_pass_removes_nothing(spark):
    once = dd.dedup_samples(spark.createDataFrame(corpus(), SCHEMA), CODE)
    assert dd.dedup_counts(dd.tag_duplicates(once, CODE)).first().dedup_removed_count == 0


def test_imports_do_not_tell_trees_apart(samples):
    df = extract_functions(samples([(1, "import a\ndef f(): return a"), (2, "import b as a\ndef f(): return a")]), CODE)
    assert tags_of(dd.tag_duplicates(df, CODE)) == {1: None, 2: dd.AST}


def test_functions_of_one_row(samples):
    df = extract_functions(samples([(1, "def f(): return 1\ndef f(): return 1")]), CODE)
    rows = dd.tag_duplicates(df, CODE).orderBy("_fn_ord").collect()
    assert [r.drop_reason for r in rows] == [None, dd.EXACT]


def test_groups_and_counts(samples):
    df = samples([(5, "a"), (2, "a"), (3, "b"), (4, None)])
    (group,) = dd.dup_groups(df, CODE).collect()
    assert (group.n, group.first_key) == (2, 2)
    counts = dd.dedup_counts(dd.tag_duplicates(df, CODE)).first()
    assert (counts.dedup_removed_count, counts.exact_dedup_removed_count, counts.ast_dedup_removed_count) == (1, 1, 0)


def test_struct_keys(spark, tmp_path):
    """Ids made from file positions order by file, then row."""
    from defgrain import read_parquet

    for name in ("b", "a"):
        spark.createDataFrame([(name, "x")], "src string, code string").coalesce(1).write.parquet(str(tmp_path / name))
    df = read_parquet(spark, [str(tmp_path / "b"), str(tmp_path / "a")])
    kept = dd.dedup_exact(df, CODE).collect()
    assert [r.src for r in kept] == ["a"]


def test_plan_aggregates_by_hash_and_leaves_wide_rows_in_place(spark, samples, tmp_path):
    """Without broadcasts: hashes are read as stored, minima need no sort, and the only wide shuffle
    would be that of the join with the later copies, which a broadcast of the written table avoids."""
    df = extract_functions(samples([(i, f"def f{i % 50}(): pass") for i in range(500)]), CODE)
    dd.with_hashes(df, "code").write.parquet(str(tmp_path / "parsed"))
    parsed = spark.read.schema(dd.with_hashes(df, "code").schema).parquet(str(tmp_path / "parsed"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        narrow = dd.later_copies(parsed, "code", True, True, [])._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in narrow and "HashAggregate" in narrow and "sha2" not in narrow
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    def save(frame, name):
        frame.write.parquet(str(tmp_path / name))
        return spark.read.schema(frame.schema).parquet(str(tmp_path / name))

    wide = dd.tag_duplicates(parsed, CODE, save=save)
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert tags_of(wide) == tags_of(dd.tag_duplicates(parsed, CODE))


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_first_keys(spark, kind):
    rows = [(2**62, 0, "a"), (-5, 3, "a"), (-5, 2, "a"), (7, 2**31 - 1, "b"), (7, 0, None), (-(2**62), 9, "c")]
    if kind == "int":
        rows = [(max(-(2**31), min(i, 2**31 - 1)), o, g) for i, o, g in rows]
    df = spark.createDataFrame(rows, "_row_id long, _fn_ord int, g string").withColumn("_row_id", F.col("_row_id").cast(kind))
    got = {r.g: (r._row_id, r._fn_ord) for r in dd.first_key(df, ["g"], ["_row_id", "_fn_ord"]).collect()}
    want = {}
    for r in df.collect():
        want[r.g] = min(want.get(r.g, (r._row_id, r._fn_ord)), (r._row_id, r._fn_ord))
    assert got == want
