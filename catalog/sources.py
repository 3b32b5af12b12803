"""Sources, sampling, sinks and run history; role detection and observation."""

from __future__ import annotations

from pyspark.sql import functions as F

from defgrain.config import ColumnRoles, PrepOptions
from defgrain.operators import metrics as met
from defgrain.operators import roles as rl
from defgrain.operators.tags import badcases, tag_invalid
from defgrain.plans.prepare import prepare
from defgrain.sources import readers, runs, sinks
from defgrain.sources.staging import new_folder

from .common import (
    CODE_DOC,
    blank_sql,
    corpus_metrics_sql,
    corpus_rows,
    corpus_tags,
    invalid_sql,
    keyed,
    ratio_sql,
    strip_sql,
    table,
)

DOCS = ColumnRoles("text", None, "lang")
DOC_COLUMNS = "doc_id, text, lang, source, n_chars"


# --- 2.1 ----------------------------------------------------------------------------------


def src_jsonl(spark, sf_dir):
    path = new_folder(spark, "documents.jsonl")
    table(spark, sf_dir, "documents").write.json(path)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    return readers.read_jsonl(spark, path, schema=schema, strict=True).select(*DOC_COLUMNS.split(", "))


def src_csv(spark, sf_dir):
    path = new_folder(spark, "documents.csv")
    writer = table(spark, sf_dir, "documents").write.option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.read_csv(spark, path).select(*DOC_COLUMNS.split(", "))


def src_parquet(spark, sf_dir):
    return readers.read_parquet(spark, f"{sf_dir}/documents.parquet").select(*DOC_COLUMNS.split(", "))


def sample_head(spark, sf_dir):
    return rl.sample_head(keyed(spark, sf_dir, "documents", "doc_id"), 50).select("doc_id", "text", "lang")


def sink_cleaned(spark, sf_dir):
    tagged = tag_invalid(keyed(spark, sf_dir, "documents", "doc_id").select("_row_id", "doc_id", "text"), DOCS_TEXT)
    out = sinks.write_cleaned(tagged, new_folder(spark, "processed_dataset.jsonl"))
    return readers.read_jsonl(spark, out.path, schema="doc_id bigint, text string", strict=True).select("doc_id", "text")


DOCS_TEXT = ColumnRoles("text")


def _corpus(spark, sf_dir, **opts):
    return prepare(corpus_rows(spark, sf_dir), CODE_DOC, PrepOptions(**opts), by="run_id")


PAIR_SCHEMA = "pair_type string, instruction string, input string, output string, source_function_name string"


def sink_pairs(spark, sf_dir):
    out = sinks.write_pairs(_corpus(spark, sf_dir).pairs, new_folder(spark, "instruction_pairs.jsonl"))
    rows = readers.read_jsonl(spark, out.path, schema=PAIR_SCHEMA, strict=True)
    return rows.select("pair_type", "input", "output", "source_function_name")


def corpus_pairs_sql() -> str:
    doc = "CASE WHEN doc <> '' THEN doc ELSE in_doc END"
    return f"""WITH {corpus_tags()},
    kept AS (SELECT *, {strip_sql(doc)} AS d FROM tagged WHERE drop_reason IS NULL AND parse_ok)
    SELECT 'docstring_to_code' AS pair_type, d AS input, code AS output, function_name AS source_function_name
    FROM kept WHERE d <> ''
    UNION ALL SELECT 'signature_to_body', signature, body, function_name FROM kept
    UNION ALL SELECT 'code_to_docstring', code, d, function_name FROM kept WHERE d <> ''"""


def output_manifest(spark, sf_dir):
    done = _corpus(spark, sf_dir)
    cleaned = sinks.write_cleaned(done.tagged, new_folder(spark, "processed_dataset.jsonl"))
    pairs = sinks.write_pairs(done.pairs, new_folder(spark, "instruction_pairs.jsonl"))
    found = sinks.output_manifest(spark, [cleaned, pairs])
    return found.select("file_role", "file_name", "row_count")


def badcase_split(spark, sf_dir):
    tagged = tag_invalid(keyed(spark, sf_dir, "documents", "doc_id"), DOCS_TEXT)
    return badcases(tagged).select("doc_id", "text", "drop_stage", "drop_reason")


def preview(spark, sf_dir):
    tagged = tag_invalid(keyed(spark, sf_dir, "documents", "doc_id"), DOCS_TEXT)
    return rl.preview(tagged.where("drop_reason is null"), 20).select("doc_id", "text")


def _history(spark, sf_dir):
    metrics = _corpus(spark, sf_dir).metrics
    root = new_folder(spark, "history")
    log = met.stage_log(metrics, "run_id", opts=PrepOptions())
    files = metrics.select(
        "run_id",
        F.explode(F.array(F.lit("raw"), F.lit("cleaned"))).alias("file_role"),
        F.concat(F.col("run_id"), F.lit(".jsonl")).alias("file_name"),
    )
    runs.append_run(root, log, met.run_metrics(metrics, "run_id"), files)
    return root


LOG_COLUMNS = ["ord", "stage", "status", "input_n", "output_n", "removed_n"]


def run_log_append(spark, sf_dir):
    root = _history(spark, sf_dir)
    return runs.read_all(spark, root, runs.STAGE_LOG).select("run_id", *LOG_COLUMNS)


def run_log_read(spark, sf_dir):
    root = _history(spark, sf_dir)
    log = runs.read_log(spark, root, "src3").select(*LOG_COLUMNS)
    facts = runs.read_report(spark, root, "src3").select(F.col("final_sample_count").alias("final_n"), F.lit(0).alias("ord"))
    files = runs.read_files(spark, root, "src3").select(F.col("file_name"), F.lit(0).alias("ord"))
    return log.join(facts, "ord", "left").join(files, "ord", "left").orderBy("ord")


def stage_log_sql(columns: str, where: str = "TRUE", extra: str = "") -> str:
    flow = [
        ("load", "0", "raw_sample_count", "0"),
        ("normalize", "raw_sample_count", "raw_sample_count", "0"),
        ("extract_functions", "raw_sample_count", "expanded_sample_count", "0"),
        ("filter_invalid", "expanded_sample_count", "valid", "invalid_removed_count"),
        ("filter_low_quality", "valid", "documented", "low_quality_docstring_count"),
        ("deduplicate", "documented", "final_sample_count", "dedup_removed_count"),
        *[(s, "final_sample_count", "final_sample_count", "0") for s in ("augment_rename", "build_pairs", "profile", "quality")],
        ("charts", "0", "0", "0"),
    ]
    rows = " UNION ALL ".join(
        f"SELECT run_id, {i} AS ord, '{s}' AS stage, '{'skipped' if s == 'augment_rename' else 'success'}' AS status, CAST({a} AS BIGINT) AS input_n, "
        f"CAST({b} AS BIGINT) AS output_n, CAST({r} AS BIGINT) AS removed_n, final_sample_count FROM w"
        for i, (s, a, b, r) in enumerate(flow)
    )
    return corpus_metrics_sql(
        f", w AS (SELECT *, expanded_sample_count - invalid_removed_count AS valid, "
        f"expanded_sample_count - invalid_removed_count - low_quality_docstring_count AS documented FROM m), "
        f"lg AS ({rows}) SELECT {columns}{extra} FROM lg WHERE {where}"
    )


# --- 2.2 ----------------------------------------------------------------------------------


def _named(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("content"), "source", "lang", F.col("n_chars").cast("string").alias("note")
    )


PROFILE_COLUMNS = [
    ("doc_id", "CAST(doc_id AS STRING)", None, None),
    ("content", "text", "code", 3),
    ("source", "source", "code", 4),
    ("lang", "lang", "language", 2),
    ("note", "CAST(n_chars AS STRING)", None, None),
]


def profile_sql() -> str:
    def one(column, x, role, rank):
        role_sql = f"'{role}'" if role else "CAST(NULL AS STRING)"
        rank_sql = str(rank) if rank else "CAST(NULL AS INTEGER)"
        return f"""SELECT '{column}' AS "column", {role_sql} AS role, {rank_sql} AS name_rank,
          count(*) AS n, count(*) FILTER (WHERE NOT {blank_sql(x)}) AS f, sum(length({x})) AS s, count({x}) AS c,
          count(*) FILTER (WHERE contains({x}, 'def ') OR contains({x}, 'class ')) AS fn FROM documents"""

    parts = " UNION ALL ".join(one(*c) for c in PROFILE_COLUMNS)
    return f"""WITH p AS ({parts}) SELECT "column", role, name_rank, {ratio_sql('f', 'n')} AS fill,
      {ratio_sql('s', 'c', 2)} AS mean_len, {ratio_sql('fn', 'n')} AS fn_share FROM p"""


def column_role_profile(spark, sf_dir):
    return rl.column_role_profile(_named(spark, sf_dir))


def role_candidates(spark, sf_dir):
    return rl.role_candidates(rl.column_role_profile(_named(spark, sf_dir)))


# Columns come from the table's schema, as a catalog query would list them.
CANDIDATES_SQL = """
WITH cols AS (SELECT CASE column_name WHEN 'text' THEN 'content' WHEN 'n_chars' THEN 'note' ELSE column_name END AS c
              FROM (DESCRIBE documents)),
names AS (
  SELECT * FROM (VALUES ('code', 'content', 3), ('code', 'source', 4), ('language', 'lang', 2)) AS v(role, c, r)
),
roles AS (SELECT unnest(['code', 'docstring', 'language']) AS role),
known AS (SELECT role, c, r FROM names JOIN cols USING (c)),
offered AS (
  SELECT role, c AS "column", r, TRUE AS standard FROM known
  UNION ALL
  SELECT roles.role, cols.c, NULL, FALSE FROM roles CROSS JOIN cols
  WHERE roles.role NOT IN (SELECT role FROM known)
),
candidates AS (
  SELECT role, CAST(row_number() OVER (PARTITION BY role ORDER BY r, "column") AS INTEGER) AS ord, "column", standard
  FROM offered
)
"""


def role_decision(spark, sf_dir):
    return rl.role_decision(rl.role_candidates(rl.column_role_profile(_named(spark, sf_dir))))


DECISION_SQL = (
    CANDIDATES_SQL
    + """, d AS (SELECT role, count(*) AS n, min_by("column", ord) AS recommended, bool_and(standard) AS known
           FROM candidates GROUP BY role),
    e AS (SELECT *, (SELECT n = 1 AND known FROM d WHERE role = 'code') AS certain FROM d)
    SELECT role, CASE WHEN known AND (n = 1 OR (role <> 'code' AND certain)) THEN recommended END AS chosen,
      recommended, CASE WHEN NOT known THEN 'low' WHEN n = 1 THEN 'high' ELSE 'medium' END AS confidence FROM e"""
)

OBSERVED = ColumnRoles("code", "doc", "lang")


def observe_sample(spark, sf_dir):
    obs = rl.observe_sample(corpus_rows(spark, sf_dir), OBSERVED, 50)
    return obs.select(
        "sample_count",
        "docstring_coverage_estimate",
        "avg_code_length",
        "code_looks_like_functions",
        "non_standard_fields",
        "detected_languages",
    )


def _obs_select(prefix: str = "", source: str = "f") -> str:
    return f"""SELECT {prefix} n AS sample_count, {ratio_sql('nd', 'n', 2)} AS docstring_coverage_estimate,
      CAST(floor(s / n) AS BIGINT) AS avg_code_length, fnl AS code_looks_like_functions,
      FALSE AS non_standard_fields FROM {source}"""


def observe_sample_sql() -> str:
    from .common import CORPUS_CODE

    return f"""WITH h AS (SELECT doc_id, {CORPUS_CODE} AS code, text AS doc, lang,
        row_number() OVER (ORDER BY doc_id) AS rn FROM documents QUALIFY rn <= 50),
      f AS (SELECT count(*) AS n, count(*) FILTER (WHERE NOT {blank_sql('doc')}) AS nd,
        CAST(sum(length(code)) AS DOUBLE) AS s,
        bool_or(rn <= 20 AND (contains(code, 'def ') OR contains(code, 'class '))) AS fnl FROM h),
      l AS (SELECT lower({strip_sql('lang')}) AS l, count(*) AS n, min(doc_id) AS seen FROM h WHERE lang <> '' GROUP BY 1
        ORDER BY n DESC, seen LIMIT 3),
      j AS (SELECT string_agg(l, ',' ORDER BY n DESC, seen) AS detected_languages FROM l WHERE l <> ''),
      o AS ({_obs_select()})
      SELECT o.*, j.detected_languages FROM o, j"""


def observe_by_sql() -> str:
    """CTEs up to ``obs``: one row per run over all rows."""
    from .common import CORPUS_CODE

    return f"""h AS (SELECT source AS run_id, doc_id, {CORPUS_CODE} AS code, text AS doc, lang FROM documents),
      f AS (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE NOT {blank_sql('doc')}) AS nd,
        CAST(sum(length(code)) AS DOUBLE) AS s, bool_or(contains(code, 'def ') OR contains(code, 'class ')) AS fnl
        FROM h GROUP BY run_id),
      l AS (SELECT run_id, lower({strip_sql('lang')}) AS l, count(*) AS n, min(doc_id) AS seen FROM h WHERE lang <> ''
        GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY n DESC, seen) <= 3),
      j AS (SELECT run_id, string_agg(l, ',' ORDER BY n DESC, seen) AS detected_languages FROM l WHERE l <> '' GROUP BY 1),
      o AS ({_obs_select('run_id,')}),
      obs AS (SELECT o.*, coalesce(j.detected_languages, '') AS detected_languages FROM o LEFT JOIN j USING (run_id))"""


def _observed(spark, sf_dir):
    return rl.observe(corpus_rows(spark, sf_dir), OBSERVED, "run_id")


def observe_runs(spark, sf_dir):
    return _observed(spark, sf_dir)


def top_languages(spark, sf_dir):
    return rl.top_languages(keyed(spark, sf_dir, "documents", "doc_id"), "lang", 3)


def looks_like_functions(spark, sf_dir):
    return rl.observe_sample(corpus_rows(spark, sf_dir), OBSERVED, 20).select("code_looks_like_functions")


def looks_like_functions_sql() -> str:
    from .common import CORPUS_CODE

    return f"""SELECT bool_or(contains(code, 'def ') OR contains(code, 'class ')) AS code_looks_like_functions
      FROM (SELECT {CORPUS_CODE} AS code FROM documents ORDER BY doc_id LIMIT 20)"""


def dataset_traits(spark, sf_dir):
    return rl.dataset_traits(_observed(spark, sf_dir), OBSERVED, 2, "parquet", "run_id")


TRAITS = [
    ("sampled_rows", "CAST(sample_count AS STRING)"),
    ("code_column", "'code'"),
    ("docstring_column", "'doc'"),
    ("language_column", "'lang'"),
    ("functions_found", "CASE WHEN code_looks_like_functions THEN 'true' ELSE 'false' END"),
    ("docstring_coverage_percent", "CAST(CAST(floor(docstring_coverage_estimate * 100) AS BIGINT) AS STRING)"),
    ("mean_code_length", "CASE WHEN avg_code_length > 0 THEN CAST(avg_code_length AS STRING) END"),
    ("languages", "nullif(detected_languages, '')"),
    ("code_candidates", "'2'"),
    ("parquet_input", "'true'"),
]


def traits_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT run_id, '{t}' AS trait, {v} AS value FROM obs" for t, v in TRAITS)
    return f"WITH {observe_by_sql()} SELECT * FROM ({rows}) WHERE value IS NOT NULL"


def dataset_risks(spark, sf_dir):
    opts = PrepOptions(enable_augmentation=True)
    return rl.dataset_risks(_observed(spark, sf_dir), OBSERVED, opts, 2, "run_id")


RISKS = [
    ("ambiguous_code_column", "TRUE"),
    ("augmentation_needs_parsable_code", "TRUE"),
    ("low_docstring_coverage", "docstring_coverage_estimate < 0.3"),
    ("short_code", "avg_code_length > 0 AND avg_code_length < 50"),
    ("no_python_language", "detected_languages <> '' AND NOT list_has_any(string_split(detected_languages, ','), ['python', 'py'])"),
    ("no_functions_found", "sample_count > 0 AND NOT code_looks_like_functions"),
]


def risks_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT run_id, '{r}' AS risk FROM obs WHERE {c}" for r, c in RISKS)
    return f"WITH {observe_by_sql()} {rows}"


def recommend_options(spark, sf_dir):
    opts = PrepOptions(enable_augmentation=True)
    return rl.recommend_options(_observed(spark, sf_dir), OBSERVED, opts, "run_id")


OPTIONS_SELECT = """SELECT run_id, TRUE AS enable_dedup, TRUE AS enable_ast_dedup,
  TRUE AS enable_ast_extract, TRUE AS enable_augmentation,
  docstring_coverage_estimate >= 0.1 AS enable_instruction_pairs FROM obs"""


def recommend_mode(spark, sf_dir):
    return rl.recommend_mode(recommend_options(spark, sf_dir), "run_id")


def mode_sql() -> str:
    return f"""WITH {observe_by_sql()}, opt AS ({OPTIONS_SELECT})
      SELECT run_id, CASE WHEN enable_instruction_pairs AND enable_augmentation THEN 'enhanced_construction'
        WHEN enable_instruction_pairs THEN 'training_data_construction' ELSE 'cleaning_analysis' END AS recommended_mode
      FROM opt"""


INVALID_DOC = invalid_sql("text")

CATALOG = {
    "src_jsonl": (src_jsonl, f"SELECT {DOC_COLUMNS} FROM documents"),
    "src_csv": (
        src_csv,
        "SELECT CAST(doc_id AS STRING) AS doc_id, text, lang, source, CAST(n_chars AS STRING) AS n_chars FROM documents",
    ),
    "src_parquet": (src_parquet, f"SELECT {DOC_COLUMNS} FROM documents"),
    "sample_head": (sample_head, "SELECT doc_id, text, lang FROM documents ORDER BY doc_id LIMIT 50"),
    "sink_cleaned": (sink_cleaned, f"SELECT doc_id, text FROM documents WHERE {INVALID_DOC} IS NULL"),
    "sink_pairs": (sink_pairs, corpus_pairs_sql()),
    "output_manifest": (
        output_manifest,
        corpus_metrics_sql(
            "SELECT 'cleaned' AS file_role, 'processed_dataset.jsonl' AS file_name, "
            "CAST(sum(final_sample_count) AS BIGINT) AS row_count FROM m UNION ALL "
            "SELECT 'instruction_pairs', 'instruction_pairs.jsonl', CAST(sum(instruction_pair_count) AS BIGINT) FROM m"
        ),
    ),
    "badcase_split": (
        badcase_split,
        f"SELECT doc_id, text, 'filter_invalid' AS drop_stage, {INVALID_DOC} AS drop_reason FROM documents "
        f"WHERE {INVALID_DOC} IS NOT NULL",
    ),
    "preview": (
        preview,
        f"SELECT doc_id, text FROM documents WHERE {INVALID_DOC} IS NULL ORDER BY doc_id LIMIT 20",
    ),
    "run_log_append": (run_log_append, stage_log_sql("run_id, ord, stage, status, input_n, output_n, removed_n")),
    "run_log_read": (
        run_log_read,
        stage_log_sql(
            "ord, stage, status, input_n, output_n, removed_n",
            "run_id = 'src3'",
            ", CASE WHEN ord = 0 THEN final_sample_count END AS final_n, CASE WHEN ord = 0 THEN 'src3.jsonl' END AS file_name",
        ),
    ),
    "column_role_profile": (column_role_profile, profile_sql()),
    "role_candidates": (role_candidates, CANDIDATES_SQL + "SELECT * FROM candidates"),
    "role_decision": (role_decision, DECISION_SQL),
    "observe_sample": (observe_sample, observe_sample_sql()),
    "observe_runs": (observe_runs, f"WITH {observe_by_sql()} SELECT * FROM obs"),
    "top_languages": (
        top_languages,
        f"""SELECT l AS language, n FROM (SELECT lower({strip_sql('lang')}) AS l, count(*) AS n, min(doc_id) AS seen
            FROM documents WHERE lang <> '' GROUP BY 1 ORDER BY n DESC, seen LIMIT 3) WHERE l <> ''""",
    ),
    "looks_like_functions": (looks_like_functions, looks_like_functions_sql()),
    "dataset_traits": (dataset_traits, traits_sql()),
    "dataset_risks": (dataset_risks, risks_sql()),
    "recommend_mode": (recommend_mode, mode_sql()),
    "recommend_options": (recommend_options, f"WITH {observe_by_sql()} {OPTIONS_SELECT}"),
}
