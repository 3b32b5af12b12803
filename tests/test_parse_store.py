import pytest
from pyspark.sql import functions as F

from defgrain import ColumnRoles
from defgrain.operators import parse_store as ps
from defgrain.operators.extract import extract_functions
from defgrain.sources import commits
from defgrain.sources.staging import new_folder, stage

ROLES = ColumnRoles("code")


@pytest.fixture(scope="module")
def rows(spark):
    """Copies, texts with several functions, blank, missing and broken ones, one text in a third of the
    rows, and user columns whose names are those of the store and of derived columns."""
    code = [f"def f{i}(a):\n    return a" for i in range(60)] + [f"def g{i}(): pass\ndef h{i}(): pass" for i in range(20)]
    code += ["", "  ", None, "def broken(:", "def broken(:", "x = 1"] * 2 + ["def hot():\n    return 1"] * 50
    data = [(i, c, f"h{i}", i, "own") for i, c in enumerate(code)]
    df = spark.createDataFrame(data, "_row_id long, code string, hash string, functions int, signature string")
    return stage(df.repartition(4), "rows")


def values(df):
    names = sorted(df.columns)
    return sorted(df.select(names).collect(), key=lambda r: (r["_row_id"], r["_fn_ord"])), names


def stored(spark, root, commit):
    return {bytes(r["hash"]) for r in spark.read.parquet(commits.folder(ps.store_path(root), commit)).collect()}


def texts(df):
    return df.where("code <> ''").select("code").distinct().count()


def test_equals_plain_extraction_and_parses_only_new_texts(spark, rows):
    root, want = new_folder(spark, "parsed"), values(extract_functions(rows, ROLES))
    old = rows.where("_row_id < 70 or _row_id >= 100")
    assert values(ps.extract_stored(old, ROLES, root, "a")) == values(extract_functions(old, ROLES))
    assert values(ps.extract_stored(rows, ROLES, root, "b")) == want
    first, second = stored(spark, root, "a"), stored(spark, root, "b")
    assert len(first) == texts(old) and not first & second and len(first | second) == texts(rows)
    assert values(ps.extract_stored(rows, ROLES, root, "c")) == want and not stored(spark, root, "c")


def test_a_repeated_load_changes_nothing(spark, rows):
    root, want = new_folder(spark, "parsed"), values(extract_functions(rows, ROLES))
    for _ in range(2):
        assert values(ps.extract_stored(rows, ROLES, root, "a")) == want
        assert len(stored(spark, root, "a")) == texts(rows)
        assert ps.read_store(spark, root).count() == texts(rows) and ps.read_store(spark, root, "a") is None


def test_texts_stored_twice_and_compaction_change_no_row(spark, rows):
    root, want = new_folder(spark, "parsed"), values(extract_functions(rows, ROLES))
    ps.extract_stored(rows, ROLES, root, "a")
    commits.write_commit(ps.read_store(spark, root), ps.store_path(root), "b")  # as two loads at the same time would
    assert values(ps.extract_stored(rows, ROLES, root, "c")) == want and not stored(spark, root, "c")
    assert ps.compact(spark, root) == 3
    assert values(ps.extract_stored(rows, ROLES, root, "d")) == want and not stored(spark, root, "d")
    assert values(ps.extract_stored(rows, ROLES, root, "a")) == want  # a retry after it was merged
    assert values(ps.extract_stored(rows, ROLES, root, "e")) == want


def test_empty_load_and_lookup_by_hash_alone(spark, rows):
    root = new_folder(spark, "parsed")
    assert ps.extract_stored(rows.where("false"), ROLES, root, "a").count() == 0
    assert values(ps.extract_stored(rows, ROLES, root, "b")) == values(extract_functions(rows, ROLES))
    known = ps._known(ps.read_store(spark, root), rows.select(F.col("code").cast("binary").alias("_code_hash")))
    assert "ReadSchema: struct<hash:binary>" in known._jdf.queryExecution().executedPlan().toString()
