"""End to end: invariants, independence of order and partitioning, streaming."""

import pytest
from pyspark.sql import functions as F

from defgrain import ColumnRoles, PrepOptions, prepare, refine
from defgrain.config import key_columns
from defgrain.operators import metrics as met
from defgrain.operators.dedup import dedup_counts, tag_duplicates
from defgrain.sources.staging import new_folder
from defgrain.streaming import stages as st

ROLES = ColumnRoles("code", "doc")
ALL_ON = PrepOptions(enable_augmentation=True)

CODES = [
    "def f{k}(a):\n\ttotal = a\n\treturn total",
    "def g(a):\r\n    # {k}\r\n    return a",
    "def a{k}(x): return x\ndef b(y): return y",
    "def broken{k}(:",
    "value = {k}",
    "  \t ",
    "async def k(a: int) -> int:\n    '''Doc {k}.'''\n    return a",
]
DOCS = ["A long enough text.", "", "todo", None, '"""Quoted   text."""', "g", "fixme"]


def rows(n):
    # A third of all rows is one and the same text.
    return [(i, "def hot(a):\n    x = a\n    return x" if i % 3 == 0 else CODES[i % 7].format(k=i % 40), DOCS[i % 5 if i % 3 == 0 else i % 7]) for i in range(n)]


@pytest.fixture(scope="module")
def done(samples):
    return prepare(samples(rows(600)), ROLES, ALL_ON)


def test_rows_add_up(done):
    m = done.metrics.first()
    assert m.raw_sample_count == 600
    removed = m.invalid_removed_count + m.low_quality_docstring_count + m.dedup_removed_count
    assert m.expanded_sample_count - removed + m.augmentation_success_count == m.final_sample_count
    assert done.cleaned.count() == m.final_sample_count
    assert done.badcases.count() == removed + m.augmentation_duplicate_dropped_count
    assert done.pairs.count() == m.instruction_pair_count
    assert m.augmentation_success_count > 0 and m.dedup_removed_count > 0


def test_keys_are_unique(done):
    keys = key_columns(done.tagged)
    assert done.tagged.select(*keys).distinct().count() == done.tagged.count()


def test_log_follows_the_metrics(done):
    log = {r.stage: r for r in done.log.collect()}
    assert list(log) == met.STAGES
    for stage in ("filter_invalid", "filter_low_quality", "deduplicate"):
        assert log[stage].input_n - log[stage].output_n == log[stage].removed_n
    assert log["augment_rename"].output_n == log["build_pairs"].output_n == done.metrics.first().final_sample_count
    assert log["extract_functions"].duration_ms > 0 and log["normalize"].duration_ms is None


def test_order_and_partitions_do_not_matter(done, samples):
    shuffled = prepare(samples(list(reversed(rows(600))), partitions=11), ROLES, ALL_ON)
    columns = done.cleaned.columns
    assert done.cleaned.exceptAll(shuffled.cleaned.select(columns)).isEmpty()
    assert shuffled.cleaned.select(columns).exceptAll(done.cleaned).isEmpty()


def test_result_has_no_copies_left(done):
    again = dedup_counts(tag_duplicates(done.cleaned.where("not is_augmented"), ROLES)).first()
    assert again.dedup_removed_count == 0
    assert done.cleaned.count() == done.cleaned.select("code").distinct().count()


def test_many_data_sets_equal_one_by_one(samples):
    both = samples(rows(200)).withColumn("run", (F.col("_row_id") % 2).cast("string"))
    together = {r.run: r.asDict() for r in prepare(both, ROLES, ALL_ON, by="run").metrics.collect()}
    for run in ("0", "1"):
        alone = prepare(both.where(F.col("run") == run), ROLES, ALL_ON).metrics.first().asDict()
        assert {k: v for k, v in together[run].items() if k != "run"} == alone


def test_options(samples):
    df = samples(rows(100))
    off = prepare(df, ROLES, PrepOptions(enable_ast_extract=False, enable_dedup=False))
    assert off.pairs is None and off.metrics.first().ast_parse_success_count == 0
    assert off.metrics.first().dedup_removed_count == 0
    strict = prepare(df, ROLES, PrepOptions(docstring_min_len=10)).metrics.first()
    assert strict.short_docstring_count > prepare(df, ROLES).metrics.first().short_docstring_count


def test_verdicts_count_as_low_quality(spark, samples):
    df = samples([(1, "def f(): return 1", "A long enough text."), (2, "def g(): return 2", "Another text.")])
    verdicts = spark.createDataFrame([(1, "low_quality")], "_row_id long, verdict string")
    m = prepare(df, ROLES, verdicts=verdicts).metrics.first()
    assert (m.judged_removed_count, m.low_quality_docstring_count, m.final_sample_count) == (1, 1, 1)


def test_metrics_long_covers_the_record(done):
    long = met.metrics_long(met.run_metrics(done.metrics))
    assert {r.metric for r in long.collect()} == set(met.RUN_METRICS)


def test_missing_columns_are_an_error(samples):
    with pytest.raises(ValueError):
        prepare(samples([(1, "x")]), ColumnRoles("other"))


def stream_of(spark, df):
    path = new_folder(spark, "input")
    df.repartition(3).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(spark, stream, mode):
    out = new_folder(spark, "output")
    st.run_available(stream, lambda batch, _: batch.write.mode("append").parquet(out), mode, new_folder(spark, "state"))
    return spark.read.schema(stream.schema).parquet(out)


def test_streamed_tags_equal_batch(spark, samples):
    from defgrain import tag_rows

    df = samples(rows(120))
    streamed = drain(spark, st.stream_tags(stream_of(spark, df), ROLES), "append")
    batch = tag_rows(df, ROLES)
    assert streamed.exceptAll(batch).isEmpty() and batch.exceptAll(streamed).isEmpty()


def test_streamed_dedup_keeps_one_per_text(spark, samples):
    df = samples(rows(120)).withColumn("at", F.timestamp_seconds(F.col("_row_id")))
    unique = drain(spark, st.stream_dedup(stream_of(spark, df), ROLES, "at", "1 hour"), "append")
    assert unique.count() == unique.select("code").distinct().count() == df.select("code").distinct().count()


def test_streamed_progress_ends_at_the_last_event(spark):
    events = spark.range(500).select((F.col("id") % 7).alias("k"), F.col("id").alias("seq"), F.hash("id").alias("v"))
    updates = drain(spark, st.stream_latest_progress(stream_of(spark, events), "k", ["seq"], ["v"]), "update")
    final = updates.groupBy("k").agg(F.max("seq").alias("seq")).collect()
    assert {r.k: r.seq for r in final} == {k: max(i for i in range(500) if i % 7 == k) for k in range(7)}


def test_refinement_equals_a_run_from_scratch(done, samples):
    opts = PrepOptions(enable_dedup=False, docstring_min_len=3)
    again = refine(done, opts)
    scratch = prepare(samples(rows(600)), ROLES, opts)
    assert again.metrics.first() == scratch.metrics.first() != done.metrics.first()
    assert again.cleaned.exceptAll(scratch.cleaned.select(again.cleaned.columns)).isEmpty()
    assert "ArrowEvalPython" not in again.tagged._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        refine(done, PrepOptions(enable_ast_extract=False))


def test_border_rows_are_judged_in_the_next_round(spark, done):
    border = done.border
    assert border.count() > 0
    verdicts = border.select("_row_id", "_fn_ord", F.lit("low_quality").alias("verdict"))
    judged = refine(done, ALL_ON, verdicts).metrics.first()
    assert judged.judged_removed_count == verdicts.count()
    assert judged.low_quality_docstring_count == done.metrics.first().low_quality_docstring_count + judged.judged_removed_count


def test_language_ranking_is_cut_before_the_shuffle(spark):
    from defgrain.operators.roles import observe

    df = spark.createDataFrame([(1, "x", "d", "go", "a")], "_row_id long, code string, doc string, lang string, run string")
    plan = observe(df, ColumnRoles("code", "doc", "lang"), "run")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_user_columns_keep_their_values(spark, samples, tmp_path):
    from defgrain.sources import sinks

    names = ["_id", "drop_reason", "drop_stage", "verdict", "is_augmented", "signature", "function_name"]
    df = samples(rows(400)).withColumns({n: F.concat(F.lit(n), F.col("_row_id")) for n in names})
    done = prepare(df, ROLES, ALL_ON)
    plain = prepare(samples(rows(400)), ROLES, ALL_ON)
    assert done.metrics.first() == plain.metrics.first()
    verdicts = done.border.where("_row_id % 2 = 0").select("_row_id", F.lit("low_quality").alias("verdict"))
    for one in (done, refine(done, ALL_ON), refine(done, ALL_ON, verdicts)):
        for out in (one.cleaned, one.badcases):
            kept = [n if n == "_id" else f"user_{n}" for n in names]
            found = out.select("_row_id", *kept).collect()
            assert found and all(r[k] == f"{n}{r._row_id}" for r in found for n, k in zip(names, kept))
    written = sinks.write_cleaned(done.cleaned, str(tmp_path / "cleaned.jsonl"))
    back = spark.read.json(written.path)
    assert {"_id", "user_verdict", "signature"} <= set(back.columns) and "_row_id" not in back.columns


def test_release_deletes_what_was_written(samples):
    done = prepare(samples(rows(20)), ROLES)
    assert done.metrics.count() == 1
    done.release()
    with pytest.raises(Exception):
        done.cleaned.count()


def test_a_replayed_batch_is_written_once(spark, tmp_path):
    write = st.batch_writer(str(tmp_path / "out"))
    for batch_id in (0, 1, 1, 0):
        write(spark.range(10 * batch_id, 10 * batch_id + 10), batch_id)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(20))


def test_rows_without_position_need_a_key(spark):
    with pytest.raises(ValueError, match="with_row_id"):
        prepare(spark.createDataFrame([("def f(): pass", "d")], "code string, doc string"), ROLES)


def test_skipped_steps_are_logged_as_such(samples):
    off = PrepOptions(enable_dedup=False, enable_instruction_pairs=False)
    status = {r.stage: r.status for r in prepare(samples(rows(20)), ROLES, off).log.collect()}
    skipped = {s for s, x in status.items() if x == "skipped"}
    assert skipped == {"deduplicate", "augment_rename", "build_pairs"}
