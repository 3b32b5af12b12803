"""Profile, quality, run records, reports over metrics, and the streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from defgrain.config import ColumnRoles, PrepOptions
from defgrain.operators import kept_index
from defgrain.operators import metrics as met
from defgrain.operators import partial_metrics as parts
from defgrain.operators import report as rp
from defgrain.operators.extract import extract_functions
from defgrain.operators.normalize import normalize_samples
from defgrain.plans.prepare import prepare, refine, tag_rows
from defgrain.sources import runs
from defgrain.sources.staging import new_folder, stage
from defgrain.streaming import stages as st
from defgrain.streaming import stateful

from .common import (
    CODE_DOC,
    CORPUS_CODE,
    CORPUS_FX,
    augmented_metrics_sql,
    blank_sql,
    corpus_metrics_sql,
    corpus_rows,
    corpus_tags,
    invalid_sql,
    low_quality_sql,
    metrics_cte,
    norm_doc_sql,
    ratio_sql,
    round_sql,
    strip_sql,
    table,
)
from .sources import LOG_COLUMNS, stage_log_sql

TEXT = ColumnRoles("text")
RUN = "run_id"


def _metrics(spark, sf_dir):
    return prepare(corpus_rows(spark, sf_dir), CODE_DOC, PrepOptions(), by=RUN).metrics


def _parsed(spark, sf_dir):
    return extract_functions(normalize_samples(corpus_rows(spark, sf_dir), CODE_DOC), CODE_DOC)


# --- 2.9 ----------------------------------------------------------------------------------


def avg_text_length(spark, sf_dir):
    return met.avg_text_length(table(spark, sf_dir, "documents"), "text", ["source", "lang"])


def docstring_coverage(spark, sf_dir):
    return met.docstring_coverage(_parsed(spark, sf_dir), CODE_DOC, RUN)


def syntax_pass_rate(spark, sf_dir):
    return met.syntax_pass_rate(_parsed(spark, sf_dir), RUN)


def function_name_rate(spark, sf_dir):
    return met.function_name_rate(_parsed(spark, sf_dir), RUN)


def return_annotation_rate(spark, sf_dir):
    return met.return_annotation_rate(_parsed(spark, sf_dir), RUN)


def _rate_sql(name: str, condition: str) -> str:
    return f"""WITH {CORPUS_FX}, c AS (SELECT run_id, count(*) FILTER (WHERE {condition}) AS a, count(*) AS b
      FROM fx GROUP BY run_id) SELECT run_id, {ratio_sql('a', 'b')} AS {name} FROM c"""


def dataset_profile(spark, sf_dir):
    return met.dataset_profile(_metrics(spark, sf_dir), RUN)


def retain_rate(spark, sf_dir):
    return met.retain_rate(_metrics(spark, sf_dir), RUN)


QUALITY = [
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
]


def quality_metrics(spark, sf_dir):
    return met.quality_metrics(_metrics(spark, sf_dir), RUN)


def run_metrics(spark, sf_dir):
    return met.run_metrics(_metrics(spark, sf_dir), RUN)


def stage_log(spark, sf_dir):
    return met.stage_log(_metrics(spark, sf_dir), RUN, opts=PrepOptions()).select(RUN, *LOG_COLUMNS)


def _long(metrics):
    return met.metrics_long(met.run_metrics(metrics, RUN), RUN)


def metrics_long(spark, sf_dir):
    return _long(_metrics(spark, sf_dir))


def long_sql(source: str = "m") -> str:
    return " UNION ALL ".join(
        f"SELECT run_id, '{n}' AS metric, CAST({n} AS DOUBLE) AS value FROM {source}" for n in met.RUN_METRICS
    )


# --- 2.10 ---------------------------------------------------------------------------------


def chart_sample_counts(spark, sf_dir):
    return rp.chart_sample_counts(_metrics(spark, sf_dir), RUN)


def chart_filter_reasons(spark, sf_dir):
    return rp.chart_filter_reasons(_metrics(spark, sf_dir), RUN)


def chart_dedup(spark, sf_dir):
    return rp.chart_dedup(_metrics(spark, sf_dir), RUN)


def chart_quality(spark, sf_dir):
    return rp.chart_quality(_metrics(spark, sf_dir), RUN)


def chart_sql(chart: str, guard: bool) -> str:
    series, names = rp.CHARTS[chart]
    where = f"WHERE greatest({', '.join(names)}) > 0" if guard else ""
    return corpus_metrics_sql(
        " UNION ALL ".join(
            f"SELECT run_id, '{chart}' AS chart_id, {i} AS ord, '{n}' AS category, '{series}' AS series, "
            f"CAST({n} AS DOUBLE) AS value FROM m {where}"
            for i, n in enumerate(names)
        )
    )


def _augmented(spark, sf_dir):
    return prepare(corpus_rows(spark, sf_dir), CODE_DOC, PrepOptions(enable_augmentation=True), by=RUN).metrics


def run_metrics_augmented(spark, sf_dir):
    return met.run_metrics(_augmented(spark, sf_dir), RUN)


def quality_alerts(spark, sf_dir):
    return rp.quality_alerts(_augmented(spark, sf_dir), by=RUN)


AUG_RATE = "augmentation_success_count / nullif(augmentation_success_count + augmentation_failed_count, 0)"
ALERTS = [
    ("low_retain_rate", "retain_rate < 0.5", "retain_rate", 0.5),
    ("low_syntax_pass_rate", "syntax_pass_rate < 0.7", "syntax_pass_rate", 0.7),
    ("low_docstring_coverage", "docstring_coverage < 0.3", "docstring_coverage", 0.3),
    ("high_dedup_share", "dedup_removed_count / raw_sample_count > 0.4", "dedup_removed_count / raw_sample_count", 0.4),
    ("low_augmentation_success", f"{AUG_RATE} < {rp.AUGMENT_WARN}", AUG_RATE, rp.AUGMENT_WARN),
    ("no_instruction_pairs", "final_sample_count > 0 AND instruction_pair_count = 0",
     "instruction_pair_count / final_sample_count", 0.5),
    ("few_instruction_pairs", "instruction_pair_count > 0 AND instruction_pair_count / final_sample_count < 0.5",
     "instruction_pair_count / final_sample_count", 0.5),
]


def alerts_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT run_id, '{a}' AS alert, CAST({v} AS DOUBLE) AS value, {t}::DOUBLE AS threshold, "
        f"'{rp.SUGGESTIONS[a]}' AS suggestion FROM m "
        f"WHERE raw_sample_count > 0 AND {c}"
        for a, c, v, t in ALERTS
    )


def alert_summary(spark, sf_dir):
    return rp.alert_summary(_metrics(spark, sf_dir), by=RUN)


def removal_reasons(spark, sf_dir):
    return rp.removal_reasons(_metrics(spark, sf_dir), RUN)


def parse_summary(spark, sf_dir):
    return rp.parse_summary(_metrics(spark, sf_dir), RUN)


def dedup_summary(spark, sf_dir):
    return rp.dedup_summary(_metrics(spark, sf_dir), RUN)


def general_summary(spark, sf_dir):
    return rp.general_summary(_metrics(spark, sf_dir), RUN)


def retain_tier(spark, sf_dir):
    return _metrics(spark, sf_dir).select(RUN, rp.retain_tier(F.col("retain_rate")).alias("tier"))


def quality_tier(spark, sf_dir):
    tier = rp.quality_tier(F.col("retain_rate"), F.col("syntax_pass_rate"), F.col("docstring_coverage"))
    return _metrics(spark, sf_dir).select(RUN, tier.alias("tier"))


def rate_band(spark, sf_dir):
    long = met.metrics_long(_metrics(spark, sf_dir).select(RUN, *rp.CHARTS["quality_metrics"][1], "retain_rate"), RUN)
    return long.select(RUN, "metric", rp.rate_band(F.col("value")).alias("band"))


# Every run asks about another topic; the last kind asks about nothing known.
TOPICS = ["filter", "ast", "dedup", "retain", "quality", "other"]
TOPIC_INDEX = "CAST(substr(run_id, 4) AS INT) % 6"


def refer_metrics(spark, sf_dir):
    wide = _metrics(spark, sf_dir)
    names = sorted({*met.RUN_METRICS, *rp.REMOVAL_COUNTS})
    long = met.metrics_long(wide.select(RUN, *names), RUN)
    kinds = F.array(*[F.lit(t) for t in TOPICS])
    asked = table(spark, sf_dir, "documents").select(F.col("source").alias(RUN)).distinct()
    topics = asked.select(RUN, F.array(F.element_at(kinds, F.expr(TOPIC_INDEX) + 1)).alias("topics"))
    return rp.refer_metrics(long, topics, RUN)


def refer_sql() -> str:
    names = sorted({*met.RUN_METRICS, *rp.REMOVAL_COUNTS})
    long = " UNION ALL ".join(f"SELECT run_id, '{n}' AS metric, CAST({n} AS DOUBLE) AS value FROM m" for n in names)
    table_rows = ", ".join(f"('{t}', '{n}')" for t, ns in rp.TOPIC_METRICS.items() for n in ns)
    base = ", ".join(f"'{n}'" for n in rp.BASE_METRICS)
    kinds = ", ".join(f"'{t}'" for t in TOPICS)
    return corpus_metrics_sql(
        f""", lg AS (SELECT *, list_extract([{kinds}], {TOPIC_INDEX} + 1) AS topic FROM ({long})),
        tm AS (SELECT * FROM (VALUES {table_rows}) AS v(topic, metric)),
        hit AS (SELECT run_id, metric, value FROM lg JOIN tm USING (topic, metric) WHERE topic <> 'filter' OR value > 0)
        SELECT * FROM hit UNION ALL SELECT run_id, metric, value FROM lg
        WHERE metric IN ({base}) AND run_id NOT IN (SELECT run_id FROM hit)"""
    )


ROUND2 = {"enable_dedup": False, "docstring_min_len": 200}


def _rounds(spark, sf_dir):
    """Metrics of a first round and of a refinement that shares its parsed rows."""
    first = prepare(corpus_rows(spark, sf_dir), CODE_DOC, PrepOptions(), by=RUN)
    return _long(first.metrics), _long(refine(first, PrepOptions(**ROUND2)).metrics)


def rounds_sql(select: str) -> str:
    """Metrics of two rounds: ``b`` with default options, ``a`` with ROUND2."""
    first = f"WITH {corpus_tags()}, {metrics_cte()} {long_sql()}"
    second = f"WITH {corpus_tags(200, False)}, {metrics_cte()} {long_sql()}"
    return f"WITH b AS ({first}), a AS ({second}) {select}"


def compare_rounds(spark, sf_dir):
    return rp.compare_rounds(*_rounds(spark, sf_dir), by=RUN)


COMPARE = """SELECT run_id, metric, b.value AS before, a.value AS after,
  floor((a.value - b.value) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS delta,
  CASE WHEN b.value = 0 THEN 0.0::DOUBLE
    ELSE floor((a.value - b.value) / b.value * 10000.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE END AS delta_percent
  FROM b JOIN a USING (run_id, metric)"""


def compare_panel(spark, sf_dir):
    return rp.compare_panel(*_rounds(spark, sf_dir), by=RUN)


def panel_sql() -> str:
    names = ", ".join(f"('{n}', {i + 1}, {str(n in rp.PANEL_RATES).upper()})" for i, n in enumerate(rp.PANEL_METRICS))
    shown = lambda x: f"CASE WHEN r THEN {round_sql(f'({x} * 100)', 1, 'away')} ELSE {x} END"
    change = "(CASE WHEN r THEN (a - b) * 100 ELSE a - b END)"
    return rounds_sql(
        f""", p AS (SELECT * FROM (VALUES {names}) AS v(metric, ord, r)),
        x AS (SELECT run_id, metric, CAST(ord AS INTEGER) AS ord, r, b.value AS b, a.value AS a FROM b
          FULL JOIN a USING (run_id, metric) JOIN p USING (metric))
        SELECT run_id, metric, ord, {shown('b')} AS before, {shown('a')} AS after,
          {round_sql(change, 2, 'away')} AS delta,
          CASE WHEN b <> 0 THEN {round_sql('((a - b) / abs(b) * 100)', 1, 'away')} END AS delta_percent FROM x"""
    )


# Runs as a lineage: of every four sources the later ones refine the one before.
LINEAGE = "CAST(substr(run_id, 4) AS INT)"


def _runs(spark, sf_dir):
    wide = _metrics(spark, sf_dir)
    n = F.expr(LINEAGE)
    return wide.select(
        RUN,
        F.when(n % 4 != 0, F.concat(F.lit("src"), (n - 1).cast("string"))).alias("parent_run_id"),
        F.concat(F.lit("src"), (n - n % 4).cast("string")).alias("root_run_id"),
        (n % 4).alias("round"),
        "retain_rate",
    )


def round_lineage(spark, sf_dir):
    return rp.round_lineage(_runs(spark, sf_dir).drop("root_run_id")).drop("cyclic")


# Customers as runs: chains of up to a hundred, every ninth with a recorded round; a loop of three of
# which others hang.
CHAINS = [
    "c_custkey AS run_id",
    "CASE WHEN c_custkey % 1000 = 500 THEN c_custkey + 2 WHEN c_custkey % 100 <> 0 THEN c_custkey - 1 END AS parent_run_id",
    "CASE WHEN c_custkey % 9 = 4 AND c_custkey % 1000 < 500 THEN c_custkey % 7 END AS round",
]


def lineage_of_new_runs(spark, sf_dir):
    return rp.round_lineage(table(spark, sf_dir, "customer").selectExpr(*CHAINS))


CHAINS_SQL = f"""WITH RECURSIVE r AS (SELECT {", ".join(CHAINS)} FROM customer),
  up AS (SELECT run_id, parent_run_id, parent_run_id AS up, 1 AS hops FROM r WHERE parent_run_id IS NOT NULL
         UNION ALL
         SELECT up.run_id, up.parent_run_id, r.parent_run_id, hops + 1 FROM up JOIN r ON r.run_id = up.up
         WHERE r.parent_run_id IS NOT NULL AND hops < 200),
  tops AS (SELECT run_id, max(hops) AS hops, arg_max(up, hops) AS top FROM up GROUP BY run_id),
  near AS (SELECT up.run_id, min(hops) AS off, arg_min(r.round, hops) AS base FROM up JOIN r ON r.run_id = up.up
           WHERE r.round IS NOT NULL GROUP BY up.run_id)
  SELECT r.run_id, r.parent_run_id, CASE WHEN hops IS NULL THEN r.run_id WHEN hops < 200 THEN top END AS root_run_id,
    CAST(CASE WHEN hops IS NULL THEN 0 WHEN base IS NOT NULL THEN base + off WHEN hops < 200 THEN hops END AS INTEGER) AS round,
    coalesce(hops >= 200, FALSE) AS cyclic
  FROM r LEFT JOIN tops USING (run_id) LEFT JOIN near USING (run_id)"""


def round_trend(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    lineage = rp.round_lineage(runs.drop("root_run_id")).select(RUN, "root_run_id", "round")
    return rp.round_trend(runs.select(RUN, "retain_rate").join(lineage, RUN), "retain_rate")


def latest_progress(spark, sf_dir):
    last = rp.latest_progress(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type", "value"])
    return last.select("user_id", "event_id", "event_type", "value")


LATEST = """SELECT user_id, event_id, event_type, value FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""


def stage_progress(spark, sf_dir):
    log = met.stage_log(_metrics(spark, sf_dir), RUN)
    return log.select(RUN, "ord", rp.stage_progress(F.col("ord"), F.lit(len(met.STAGES))).alias("progress"))


# --- streaming forms ----------------------------------------------------------------------


def _stream(spark, sf_dir, name):
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}*.parquet")


def _drain(spark, stream, mode):
    """Run the stream over what is there; each batch gets a folder of its own."""
    out = new_folder(spark, "stream")
    st.run_available(stream, st.batch_writer(out), mode, f"{out}-checkpoint")
    return spark.read.schema(stream.schema).parquet(out)


def stream_latest_progress(spark, sf_dir):
    live = st.stream_latest_progress(_stream(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type", "value"])
    updates = _drain(spark, live, "update")
    last = rp.latest_progress(updates, "user_id", ["ts", "event_id"], ["event_type", "value"])
    return last.select("user_id", "event_id", "event_type", "value")


def stream_dedup(spark, sf_dir):
    events = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    text = F.concat_ws("|", "user_id", "event_type", "props")
    unique = st.stream_dedup(events.withColumn("code", text), ColumnRoles("code"), "ts", "3650 days")
    return _drain(spark, unique, "append").select("code")


def stream_live_progress(spark, sf_dir):
    """As above with state that expires; all events are within the delay."""
    events = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    live = stateful.stream_live_progress(events, "user_id", "ts", "event_id", ["event_type", "value"], "3650 days", "3650 days")
    last = rp.latest_progress(_drain(spark, live, "update"), "user_id", ["ts", "event_id"], ["event_type", "value"])
    return last.select("user_id", "event_id", "event_type", "value")


def stream_first_copies(spark, sf_dir):
    """The event that comes first by id for each text, whatever order they arrive in."""
    events = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    text = F.concat_ws("|", "user_id", "event_type", "props")
    updates = stateful.stream_first_copies(events.withColumn("code", text), "code", "event_id", "ts", "3650 days")
    return stateful.last_updates(_drain(spark, updates, "update"), "first_key")


def metrics_in_parts(spark, sf_dir):
    """Run metrics of the corpus loaded in three parts, the last of them twice, from stored counts."""
    rows = corpus_rows(spark, sf_dir)
    third = (rows.agg(F.max("_row_id")).first()[0] or 0) // 3 + 1
    counts, index = new_folder(spark, "counts"), new_folder(spark, "index")
    for k in (0, 1, 2, 2):
        part = stage(tag_rows(rows.where(F.col("_row_id").between(third * k, third * (k + 1) - 1)), CODE_DOC, PrepOptions()), "part")
        tagged = kept_index.tag_load(part, CODE_DOC, index, f"part{k}", stage, by=RUN)
        parts.add_part(tagged, CODE_DOC, counts, f"part{k}", PrepOptions(), RUN)
    return met.run_metrics(parts.merged_metrics(spark, counts, RUN), RUN)


def stream_tags(spark, sf_dir):
    docs = _stream(spark, sf_dir, "documents")
    rows = docs.select(
        F.col("doc_id").alias("_row_id"), F.expr(CORPUS_CODE).alias("code"), F.expr(STREAM_DOC).alias("doc")
    )
    tagged = _drain(spark, st.stream_tags(rows, CODE_DOC, PrepOptions()), "append")
    return tagged.select(F.col("_row_id").alias("doc_id"), F.col("_fn_ord").alias("fn_ord"), "drop_stage", "drop_reason")


# Docstrings that meet every rule in turn, and the documents' own.
STREAM_DOC = (
    "CASE doc_id % 7 WHEN 0 THEN ' ' WHEN 1 THEN 'abc' WHEN 2 THEN ' Fixme' WHEN 3 THEN 'o_' || CAST(doc_id % 50 AS STRING) "
    "|| ' function' WHEN 4 THEN 'Adds two numbers up.' ELSE text END"
)


def stream_tags_sql() -> str:
    fx = CORPUS_FX.replace(norm_doc_sql("text"), norm_doc_sql(STREAM_DOC))
    return f"""WITH {fx},
      t1 AS (SELECT *, {invalid_sql('code', 'doc', parsed=True)} AS r1 FROM fx),
      t2 AS (SELECT *, CASE WHEN r1 IS NULL THEN {low_quality_sql('doc', 'function_name')} END AS r2 FROM t1)
      SELECT doc_id, fn_ord, CASE WHEN r1 IS NOT NULL THEN 'filter_invalid' WHEN r2 IS NOT NULL THEN 'filter_low_quality' END
        AS drop_stage, coalesce(r1, r2) AS drop_reason FROM t2"""


# --- verdicts, border rows and the run history ---------------------------------------------


def _verdicts(spark, sf_dir):
    label = F.when(F.col("toxic") == 1, "low_quality").when(F.col("quality") == 1, "high_quality").otherwise("unsure")
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_row_id"), label.alias("verdict"))


def border_by_run(spark, sf_dir):
    done = prepare(corpus_rows(spark, sf_dir), CODE_DOC, PrepOptions(), by=RUN)
    return done.border.select(RUN, F.col("_row_id").alias("doc_id"), F.col("_fn_ord").alias("fn_ord"), "docstring", "function_name")


BORDER = f"length({strip_sql('doc')}) BETWEEN 10 AND 60"


def refine_verdicts(spark, sf_dir):
    """A second round with outside verdicts: what the judge removes goes before copies are looked for."""
    first = prepare(corpus_rows(spark, sf_dir), CODE_DOC, PrepOptions(), by=RUN)
    again = refine(first, PrepOptions(), _verdicts(spark, sf_dir))
    return again.tagged.select(RUN, F.col("_row_id").alias("doc_id"), F.col("_fn_ord").alias("fn_ord"), "verdict", "drop_stage", "drop_reason")


def verdict_counts(spark, sf_dir):
    first = prepare(corpus_rows(spark, sf_dir), CODE_DOC, PrepOptions(), by=RUN)
    counts = refine(first, PrepOptions(), _verdicts(spark, sf_dir)).metrics
    return counts.select(RUN, "border_count", "judged_count", "uncertain_count", "judged_removed_count")


JUDGED_FX = """SELECT t2.*, coalesce(CASE WHEN toxic = 1 THEN 'low_quality' WHEN quality = 1 THEN 'high_quality' END,
  'uncertain') AS verdict, r1 IS NULL AND r2 IS NULL AS passed FROM t2 LEFT JOIN labels USING (doc_id)"""


def verdict_counts_sql() -> str:
    return f"""WITH {corpus_tags()}, v AS ({JUDGED_FX})
      SELECT run_id, count(*) FILTER (WHERE passed AND {BORDER}) AS border_count,
        count(*) FILTER (WHERE passed AND verdict <> 'uncertain') AS judged_count,
        count(*) FILTER (WHERE passed AND {BORDER} AND verdict = 'uncertain') AS uncertain_count,
        count(*) FILTER (WHERE passed AND verdict = 'low_quality') AS judged_removed_count
      FROM v GROUP BY run_id"""


def refine_verdicts_sql() -> str:
    live = "passed AND verdict <> 'low_quality'"
    return f"""WITH {corpus_tags()}, v AS ({JUDGED_FX}),
      x AS (SELECT doc_id, fn_ord, row_number() OVER (PARTITION BY run_id, code ORDER BY doc_id, fn_ord) AS t FROM v WHERE {live}),
      y AS (SELECT doc_id, fn_ord, row_number() OVER (PARTITION BY run_id, function_name ORDER BY doc_id, fn_ord) AS a
            FROM v JOIN x USING (doc_id, fn_ord) WHERE t = 1)
      SELECT run_id, doc_id, fn_ord, verdict,
        CASE WHEN r1 IS NOT NULL THEN 'filter_invalid' WHEN r2 IS NOT NULL OR verdict = 'low_quality' THEN 'filter_low_quality'
             WHEN t > 1 OR a > 1 THEN 'deduplicate' END AS drop_stage,
        coalesce(r1, r2, CASE WHEN verdict = 'low_quality' THEN 'judged_low_quality' WHEN t > 1 THEN 'exact_duplicate'
             WHEN a > 1 THEN 'ast_duplicate' END) AS drop_reason
      FROM v LEFT JOIN x USING (doc_id, fn_ord) LEFT JOIN y USING (doc_id, fn_ord)"""


def history_compare(spark, sf_dir):
    """Two rounds of every run in the stored history; the latest report of each is compared with the
    first round's metrics."""
    first = prepare(corpus_rows(spark, sf_dir), CODE_DOC, PrepOptions(), by=RUN)
    second = refine(first, PrepOptions(**ROUND2))
    root = new_folder(spark, "history")
    for done in (first, second):
        runs.append_run(root, done.log, met.run_metrics(done.metrics, RUN))
    latest = runs.read_reports(spark, root).drop("written_at")
    return rp.compare_rounds(met.metrics_long(met.run_metrics(first.metrics, RUN), RUN), met.metrics_long(latest, RUN), by=RUN)


def history_compare_sql() -> str:
    names = ", ".join(f"'{n}'" for n in met.RUN_METRICS)
    return rounds_sql(f"{COMPARE} WHERE metric IN ({names})")


CATALOG = {
    "avg_text_length": (
        avg_text_length,
        f"""SELECT source, lang, {ratio_sql('s', 'n', 2)} AS avg_text_length FROM (SELECT source, lang,
          sum(length(text)) FILTER (WHERE text <> '') AS s, count(*) FILTER (WHERE text <> '') AS n
          FROM documents GROUP BY source, lang)""",
    ),
    "docstring_coverage": (
        docstring_coverage,
        _rate_sql("docstring_coverage", f"NOT {blank_sql(chr(40) + 'CASE WHEN doc <> ' + chr(39) * 2 + ' THEN doc ELSE in_doc END)')}"),
    ),
    "dataset_profile": (
        dataset_profile,
        corpus_metrics_sql(
            "SELECT run_id, raw_sample_count, final_sample_count, avg_code_length, avg_docstring_length, "
            "docstring_coverage FROM m"
        ),
    ),
    "retain_rate": (retain_rate, corpus_metrics_sql("SELECT run_id, retain_rate FROM m")),
    "syntax_pass_rate": (syntax_pass_rate, _rate_sql("syntax_pass_rate", "parse_ok")),
    "function_name_rate": (function_name_rate, _rate_sql("function_name_match_rate", "function_name <> ''")),
    "return_annotation_rate": (
        return_annotation_rate,
        _rate_sql("return_annotation_rate", "return_annotation <> '' AND return_annotation <> 'None'"),
    ),
    "quality_metrics": (quality_metrics, corpus_metrics_sql(f"SELECT run_id, {', '.join(QUALITY)} FROM m")),
    "run_metrics": (run_metrics, corpus_metrics_sql(f"SELECT run_id, {', '.join(met.RUN_METRICS)} FROM m")),
    "stage_log": (stage_log, stage_log_sql("run_id, ord, stage, status, input_n, output_n, removed_n")),
    "metrics_long": (metrics_long, corpus_metrics_sql(long_sql())),
    "chart_sample_counts": (chart_sample_counts, chart_sql("sample_count_compare", False)),
    "chart_filter_reasons": (chart_filter_reasons, chart_sql("filter_reasons", True)),
    "chart_dedup": (chart_dedup, chart_sql("dedup_results", True)),
    "chart_quality": (chart_quality, chart_sql("quality_metrics", False)),
    "quality_alerts": (quality_alerts, augmented_metrics_sql(alerts_sql())),
    "run_metrics_augmented": (run_metrics_augmented, augmented_metrics_sql(f"SELECT run_id, {', '.join(met.RUN_METRICS)} FROM m")),
    "alert_summary": (
        alert_summary,
        corpus_metrics_sql(
            f""", al AS (SELECT run_id, count(*) AS k FROM ({alerts_sql()}) GROUP BY run_id)
            SELECT run_id, raw_sample_count, final_sample_count, retain_rate, coalesce(k, 0) AS alerts,
              CASE coalesce(k, 0) WHEN 0 THEN 'good' WHEN 1 THEN 'attention' ELSE 'problems' END AS level
            FROM m LEFT JOIN al USING (run_id)"""
        ),
    ),
    "removal_reasons": (
        removal_reasons,
        corpus_metrics_sql(
            " UNION ALL ".join(
                f"SELECT run_id, {i} AS ord, '{n}' AS metric, {n} AS value FROM m WHERE {n} > 0"
                for i, n in enumerate(rp.REMOVAL_COUNTS)
            )
        ),
    ),
    "parse_summary": (
        parse_summary,
        corpus_metrics_sql(
            "SELECT run_id, ast_parse_success_count, ast_parse_failed_count, syntax_pass_rate FROM m "
            "WHERE ast_parse_success_count + ast_parse_failed_count > 0"
        ),
    ),
    "dedup_summary": (
        dedup_summary,
        corpus_metrics_sql(
            "SELECT run_id, dedup_removed_count, exact_dedup_removed_count, ast_dedup_removed_count FROM m "
            "WHERE dedup_removed_count > 0"
        ),
    ),
    "retain_tier": (
        retain_tier,
        corpus_metrics_sql(
            "SELECT run_id, CASE WHEN retain_rate >= 0.8 THEN 'high' WHEN retain_rate >= 0.6 THEN 'medium' ELSE 'low' END "
            "AS tier FROM m"
        ),
    ),
    "quality_tier": (
        quality_tier,
        corpus_metrics_sql(
            "SELECT run_id, CASE WHEN retain_rate >= 0.8 AND syntax_pass_rate >= 0.9 AND docstring_coverage >= 0.7 "
            "THEN 'excellent' WHEN retain_rate >= 0.6 AND syntax_pass_rate >= 0.8 THEN 'good' "
            "WHEN retain_rate >= 0.4 THEN 'medium' ELSE 'low' END AS tier FROM m"
        ),
    ),
    "general_summary": (
        general_summary,
        corpus_metrics_sql("SELECT run_id, raw_sample_count, final_sample_count, retain_rate FROM m"),
    ),
    "rate_band": (
        rate_band,
        corpus_metrics_sql(
            " UNION ALL ".join(
                f"SELECT run_id, '{n}' AS metric, CASE WHEN {n} >= 0.8 THEN 'good' WHEN {n} >= 0.5 THEN 'warn' "
                f"ELSE 'danger' END AS band FROM m"
                for n in [*rp.CHARTS["quality_metrics"][1], "retain_rate"]
            )
        ),
    ),
    "refer_metrics": (refer_metrics, refer_sql()),
    "compare_rounds": (compare_rounds, rounds_sql(COMPARE)),
    "compare_panel": (compare_panel, panel_sql()),
    "round_lineage": (
        round_lineage,
        f"""SELECT DISTINCT source AS run_id, CASE WHEN n % 4 <> 0 THEN 'src' || (n - 1) END AS parent_run_id,
          'src' || (n - n % 4) AS root_run_id, CAST(n % 4 AS INTEGER) AS round FROM (SELECT source, CAST(substr(source, 4) AS INT) AS n FROM documents)""",
    ),
    "lineage_of_new_runs": (lineage_of_new_runs, CHAINS_SQL),
    "round_trend": (
        round_trend,
        corpus_metrics_sql(
            """, r AS (SELECT run_id, CAST(substr(run_id, 4) AS INT) AS n, retain_rate FROM m)
            SELECT 'src' || (n - n % 4) AS root_run_id, run_id, CAST(n % 4 AS INTEGER) AS round, retain_rate,
              retain_rate - lag(retain_rate) OVER (PARTITION BY n - n % 4 ORDER BY n % 4) AS change FROM r"""
        ),
    ),
    "latest_progress": (latest_progress, LATEST),
    "stage_progress": (
        stage_progress,
        "SELECT run_id, ord, CAST(10 + floor(ord / 11 * 85) AS INTEGER) AS progress FROM "
        "(SELECT DISTINCT source AS run_id FROM documents), (SELECT unnest(range(11))::INTEGER AS ord)",
    ),
    "stream_latest_progress": (stream_latest_progress, LATEST),
    "stream_dedup": (
        stream_dedup,
        "SELECT DISTINCT user_id || '|' || event_type || '|' || props AS code FROM events",
    ),
    "stream_live_progress": (stream_live_progress, LATEST),
    "stream_first_copies": (
        stream_first_copies,
        "SELECT sha256(user_id || '|' || event_type || '|' || props) AS text_hash, min(event_id) AS first_key FROM events GROUP BY 1",
    ),
    "metrics_in_parts": (metrics_in_parts, corpus_metrics_sql(f"SELECT run_id, {', '.join(met.RUN_METRICS)} FROM m")),
    "stream_tags": (stream_tags, stream_tags_sql()),
    "border_by_run": (
        border_by_run,
        f"""WITH {corpus_tags()} SELECT run_id, doc_id, fn_ord, {strip_sql('doc')} AS docstring, function_name
          FROM t2 WHERE r1 IS NULL AND r2 IS NULL AND {BORDER}""",
    ),
    "refine_verdicts": (refine_verdicts, refine_verdicts_sql()),
    "verdict_counts": (verdict_counts, verdict_counts_sql()),
    "history_compare": (history_compare, history_compare_sql()),
}
