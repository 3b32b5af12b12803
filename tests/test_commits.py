"""Tables of commits, run history on them, and metrics from stored counts."""

import random

import pytest
from pyspark.sql import functions as F

from defgrain import ColumnRoles, PrepOptions, tag_rows
from defgrain.operators import partial_metrics as parts
from defgrain.operators.dedup import tag_duplicates
from defgrain.operators.metrics import tag_metrics
from defgrain.sources import commits, runs
from defgrain.sources.staging import new_folder, stage
from defgrain.streaming import stages as st

ROLES = ColumnRoles("code", "doc")


def ids(spark, root, **more):
    return sorted(r["id"] for r in commits.read_commits(spark, root, **more).collect())


def test_a_repeated_commit_counts_once(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        commits.read_commits(spark, root)
    for name, n in (("a", 3), ("b", 2), ("a", 3)):
        commits.write_commit(spark.range(n), root, name)
    assert ids(spark, root) == [0, 0, 1, 1, 2]
    for name in ("", "../x", "merged-1", "a/b"):
        with pytest.raises(ValueError):
            commits.write_commit(spark.range(1), root, name)


def test_unfinished_folders_are_not_read(spark, tmp_path):
    root = tmp_path / "t"
    commits.write_commit(spark.range(2), str(root), "a")
    commits.write_commit(spark.range(2), str(root), "b")
    (root / "_commit=b" / "_SUCCESS").unlink()  # as if the writer had died
    assert ids(spark, str(root)) == [0, 1]
    spark.range(2).write.parquet(str(root / "_commit=merged-x"))  # whole, but never recorded
    assert ids(spark, str(root)) == [0, 1]


def test_compaction_keeps_rows_files_few_and_retries_harmless(spark, tmp_path):
    root = str(tmp_path / "t")
    for i in range(12):
        commits.write_commit(spark.range(1).select(F.lit(f"{i:03}").alias("run"), F.lit(i).alias("id")), root, f"c{i}", "run")
    assert commits.compact(spark, root, "run") == 12 and commits.compact(spark, root, "run") == 0
    assert len(list((tmp_path / "t").rglob("*.parquet"))) <= 2
    assert ids(spark, root, partition_by="run") == list(range(12))
    late = spark.range(1).select(F.lit("003").alias("run"), F.lit(3).alias("id"))
    commits.write_commit(late, root, "c3", "run")  # a retry after the merge
    commits.write_commit(late.withColumn("id", F.lit(99)), root, "new", "run")
    assert ids(spark, root, partition_by="run") == [*range(12), 99]
    one = commits.read_commits(spark, root, "run").where("run = '003'")
    assert sorted(r["id"] for r in one.collect()) == [3, 99]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(run,003)" in plan and "PartitionFilters: [isnotnull(run" in plan
    assert commits.compact(spark, root, "run") == 2 and ids(spark, root, partition_by="run") == [*range(12), 99]


def test_run_appended_twice_is_there_once(spark, tmp_path):
    root = str(tmp_path / "history")
    log = spark.createDataFrame([("7", 0, "a"), ("7", 1, "b")], "run_id string, ord int, stage string")
    report = spark.createDataFrame([("7", 5)], "run_id string, final_sample_count long")
    for _ in range(2):
        runs.append_run(root, log, report, commit="load-7")
    runs.append_run(root, log.withColumn("run_id", F.lit("08")), report.withColumn("run_id", F.lit("08")))
    for _ in range(2):
        assert [r.stage for r in runs.read_log(spark, root, "7").collect()] == ["a", "b"]
        assert sorted(r.run_id for r in runs.read_reports(spark, root).collect()) == ["08", "7"]
        runs.compact_runs(spark, root)


def corpus(spark):
    rows = [(i, f"def f{i % 9}(a):\n    return a + {i % 4}{'  # x' if i % 5 == 0 else ''}", f"Adds numbers {i % 9}.", f"r{i % 2}") for i in range(90)]
    rows += [(90 + i, "def broken(:", None, "r0") for i in range(5)] + [(95 + i, " ", "", "r1") for i in range(5)]
    return spark.createDataFrame(rows, "_row_id long, code string, doc string, run string")


@pytest.mark.parametrize("by", [(), "run"])
def test_counts_of_parts_in_any_order_make_the_whole(spark, tmp_path, by):
    tagged = stage(tag_duplicates(tag_rows(corpus(spark), ROLES), ROLES, by=by), "tagged")
    want = sorted(map(str, tag_metrics(tagged, ROLES, by=by).collect()))
    root, order = str(tmp_path / "counts"), [0, 1, 2, 3, 1]
    random.Random(1).shuffle(order)
    for k in order:
        parts.add_part(tagged.where(F.col("_row_id") % 4 == k), ROLES, root, f"p{k}", by=by)
    assert sorted(map(str, parts.merged_metrics(spark, root, by).collect())) == want
    parts.compact_parts(spark, root)
    assert sorted(map(str, parts.merged_metrics(spark, root, by).collect())) == want


def test_streamed_batches_count_as_one_run(spark, tmp_path):
    df = corpus(spark)
    for k in range(3):  # files are taken by their time, in the order of their rows
        df.where(F.col("_row_id").between(k * 40, k * 40 + 39)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts = str(tmp_path / "counts")
    sink = parts.counting_sink(ROLES, counts, str(tmp_path / "index"), stage)
    st.run_available(st.stream_tags(stream, ROLES), sink, "append", new_folder(spark, "state"))
    got = parts.merged_metrics(spark, counts).first().asDict()
    want = tag_metrics(tag_duplicates(tag_rows(df, ROLES), ROLES), ROLES).first().asDict()
    exact = [k for k in want if k.endswith("_count")]
    assert {k: got[k] for k in exact} == {k: want[k] for k in exact}
