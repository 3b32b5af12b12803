"""Readers, ids, sinks, manifest and run history."""

import json

import pytest
from pyspark.sql import functions as F

from defgrain import read_csv, read_head, read_jsonl, read_parquet
from defgrain.config import ROW_ID, ColumnRoles
from defgrain.operators.dedup import dedup_exact
from defgrain.operators.tags import tag_invalid
from defgrain.sources import runs, sinks
from defgrain.sources.readers import spread
from defgrain.sources.staging import stage, staging_root


def write(path, text):
    path.write_text(text, encoding="utf-8", newline="")
    return str(path)


def test_jsonl(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", '{"code": "a\\n", "n": {"k": [1]}}\n\n  \n{"code": null, "n": null}\n')
    rows = read_jsonl(spark, path).orderBy(ROW_ID).collect()
    assert [r.code for r in rows] == ["a\n", None] and rows[0].n.k == [1]


def test_bad_lines_are_kept_or_fatal(spark, tmp_path):
    path = write(tmp_path / "b.jsonl", '{"code": "a"}\n{"code": \n{"code": "c"}\n')
    df = read_jsonl(spark, path, schema="code string")
    assert [r._corrupt_record for r in df.orderBy(ROW_ID).collect()] == [None, '{"code": ', None]
    bad = tag_invalid(df, ColumnRoles("code")).where("_corrupt_record is not null").first()
    assert bad.drop_reason == "empty_code"
    with pytest.raises(Exception):
        read_jsonl(spark, path, schema="code string", strict=True).collect()


def test_whole_json_file(spark, tmp_path):
    path = write(tmp_path / "c.json", json.dumps([{"code": "a"}, {"code": "b"}], indent=2))
    assert {r.code for r in read_jsonl(spark, path, multi_line=True).collect()} == {"a", "b"}


def test_missing_file_is_an_error(spark, tmp_path):
    with pytest.raises(Exception):
        read_parquet(spark, str(tmp_path / "nothing")).collect()


def test_csv_cells(spark, tmp_path):
    text = 'code,doc,n\r\n"def f():\r\n    return ""x""",plain,1\r\n,"",007\r\nonly\r\n'
    rows = read_csv(spark, write(tmp_path / "d.csv", text)).orderBy(ROW_ID).collect()
    # The parser unifies line ends inside cells of a CRLF file; code is normalised so anyway.
    assert rows[0].code == 'def f():\n    return "x"' and rows[0].doc == "plain"
    assert rows[1].code is None and rows[1].n == "007"
    assert (rows[2].code, rows[2].doc, rows[2].n) == ("only", None, None)


def test_row_ids_follow_file_order(spark, tmp_path):
    lines = [json.dumps({"v": i, "pad": "x" * 200}) for i in range(5000)]
    path = write(tmp_path / "e.jsonl", "\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = read_jsonl(spark, path, schema="v int, pad string")
        assert df.rdd.getNumPartitions() > 4
        assert [r.v for r in df.repartition(7).orderBy(ROW_ID).collect()] == list(range(5000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_parquet_ids_and_first_copy_across_files(spark, tmp_path):
    for name, value in (("b", 2), ("a", 1)):
        spark.range(3).select(F.lit("same").alias("code"), F.lit(value).alias("v")).coalesce(1).write.parquet(str(tmp_path / name))
    df = read_parquet(spark, [str(tmp_path / "b"), str(tmp_path / "a")])
    assert df.select(ROW_ID).distinct().count() == 6
    assert dedup_exact(df, ColumnRoles("code")).first().v == 1


def test_head_opens_few_files(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(0, 100, 1, 10).write.parquet(path)
    head = read_head(spark, path, 15)
    assert head.count() == 15 and len(head.inputFiles()) == 2
    assert [r.id for r in head.orderBy(ROW_ID).collect()] == list(range(15))
    assert [r.id for r in read_head(spark, path, 3, key="id").collect()] == [0, 1, 2]
    assert read_head(spark, path, 1000).count() == 100 and read_head(spark, path, 0).count() == 0
    assert "LessThan(_metadata.row_index" in head._jdf.queryExecution().toString() or "row_index" in head._jdf.queryExecution().toString()


def test_spread_only_when_needed(spark):
    one = spark.range(0, 10, 1, 1).withColumn(ROW_ID, F.col("id"))
    many = spark.range(0, 10, 1, 64).withColumn(ROW_ID, F.col("id"))
    assert spread(one).rdd.getNumPartitions() == 8
    assert "Exchange" not in spread(many)._jdf.queryExecution().executedPlan().toString()


def test_stage_writes_to_the_shared_folder(spark):
    df = stage(spark.range(5).withColumn("s", F.struct("id")), "t")
    assert df.count() == 5 and f"{staging_root(spark)}/defgrain/" in df.inputFiles()[0]
    assert staging_root(spark) == spark.conf.get("spark.checkpoint.dir")


def test_cleaned_output(spark, samples, tmp_path):
    tagged = tag_invalid(samples([(1, "x" * 10, None), (2, " ", "d")]), ColumnRoles("code", "doc"))
    out = sinks.write_cleaned(tagged, str(tmp_path / "cleaned"))
    assert out.row_count == 1
    (row,) = spark.read.json(out.path).collect()
    assert row.asDict() == {"code": "x" * 10, "doc": None}


def test_manifest_counts_what_is_written(spark, tmp_path):
    pairs = spark.createDataFrame([("t", "i", "a\nb", "o", "f")] * 7, "pair_type string, instruction string, input string, output string, source_function_name string")
    written = sinks.write_pairs(pairs, str(tmp_path / "pairs.jsonl"))
    nothing = sinks.write_pairs(pairs.where("false"), str(tmp_path / "none.jsonl"), count=0)
    assert nothing is None and not (tmp_path / "none.jsonl").exists()
    rows = sinks.output_manifest(spark, [written, nothing]).collect()
    assert [(r.file_role, r.file_name, r.row_count) for r in rows] == [("instruction_pairs", "pairs.jsonl", 7)]
    assert sinks.output_manifest(spark, [None]).isEmpty()


def test_run_history(spark, tmp_path):
    root = str(tmp_path / "history")

    def run(name, value):
        log = spark.createDataFrame([(name, 1, "b"), (name, 0, "a")], "run_id string, ord int, stage string")
        report = spark.createDataFrame([(name, value)], "run_id string, final_sample_count long")
        files = spark.createDataFrame([(name, "raw", "in"), (name, "cleaned", "out")], "run_id string, file_role string, file_name string")
        runs.append_run(root, log, report, files)

    run("r1", 10)
    run("r2", 20)
    assert [r.stage for r in runs.read_log(spark, root, "r1").collect()] == ["a", "b"]
    assert [r.file_name for r in runs.read_files(spark, root, "r2").collect()] == ["out"]
    runs.append_run(root, spark.createDataFrame([("r3", 0, "x")], "run_id string, ord int, stage string"),
                    spark.createDataFrame([("r1", 11)], "run_id string, final_sample_count long"))
    assert runs.read_report(spark, root, "r1").first().final_sample_count == 11
    plan = runs.read_log(spark, root, "r1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan
