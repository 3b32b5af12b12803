import pytest
from pyspark.sql import functions as F

from defgrain import ColumnRoles
from defgrain.operators import kept_index
from defgrain.operators.dedup import AST, EXACT, tag_duplicates
from defgrain.operators.extract import extract_functions
from defgrain.sources.staging import new_folder, stage

ROLES = ColumnRoles("code")


@pytest.fixture(scope="module")
def rows(spark):
    """Copies within and across loads: of texts, of trees, rows without code, rows that do not parse."""
    code = [f"def f{i % 11}(a):\n    return a{'  # note' if i % 3 == 0 else ''}" for i in range(60)]
    code += ["", "  ", "def broken(:", "def broken(:", "def g():\n    return 1", "def g():\n\n    return 1"] * 2
    df = spark.createDataFrame([(i, c, f"r{i % 2}") for i, c in enumerate(code)], "_row_id long, code string, run string")
    return stage(extract_functions(df, ROLES), "rows")


def outcome(df):
    return {r["_row_id"]: r["drop_reason"] for r in df.select("_row_id", "drop_reason").collect()}


def by_loads(spark, rows, cuts, root, **more):
    out = {}
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = rows.where(F.col("_row_id").between(a, b - 1))
        out |= outcome(kept_index.tag_load(part, ROLES, root, f"l{k}", stage, **more))
    return out


@pytest.mark.parametrize("ast, by", [(True, ()), (False, ()), (True, "run")])
def test_loads_equal_one_load(spark, rows, ast, by):
    want = outcome(tag_duplicates(rows, ROLES, ast=ast, by=by))
    assert EXACT in want.values() and (AST in want.values()) == ast
    assert by_loads(spark, rows, [0, 25, 40, 100], new_folder(spark, "index"), ast=ast, by=by) == want
    assert by_loads(spark, rows, [0, 100], new_folder(spark, "index"), ast=ast, by=by) == want


def test_a_repeated_load_changes_nothing(spark, rows):
    root = new_folder(spark, "index")
    first = by_loads(spark, rows, [0, 30, 100], root)
    size = spark.read.parquet(f"{root}/texts").count()
    again = kept_index.tag_load(rows.where("_row_id >= 30"), ROLES, root, "l1", stage)
    assert outcome(again) == {k: v for k, v in first.items() if k >= 30}
    assert spark.read.parquet(f"{root}/texts").count() == size


def test_compaction_changes_no_answer(spark, rows):
    root = new_folder(spark, "index")
    want = outcome(tag_duplicates(rows, ROLES))
    got = by_loads(spark, rows, [0, 20, 40], root)
    kept_index.compact(spark, root, ["l0", "l1"], "merged")
    assert {r["load"] for r in spark.read.parquet(f"{root}/texts").select("load").collect()} == {"merged"}
    got |= outcome(kept_index.tag_load(rows.where("_row_id >= 40"), ROLES, root, "l2", stage))
    assert got == want


def test_later_loads_read_hashes_alone(spark, rows):
    root = new_folder(spark, "index")
    by_loads(spark, rows, [0, 50], root)
    index = kept_index._read(spark, root, kept_index.TEXTS, "l9")
    assert set(index.columns) == {"hash", "_row_id", "_fn_ord", "load", "prefix"}
    firsts = index.select("hash", "_row_id", "_fn_ord")
    plan = kept_index._known(firsts, index, [])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<hash:binary>" in plan


def test_empty_load(spark, rows):
    root = new_folder(spark, "index")
    assert kept_index.tag_load(rows.where("false"), ROLES, root, "l0", stage).count() == 0
    assert outcome(kept_index.tag_load(rows, ROLES, root, "l1", stage)) == outcome(tag_duplicates(rows, ROLES))
