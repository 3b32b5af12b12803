"""Row-wise functions, filters, extraction, deduplication, augmentation and pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from defgrain.config import ColumnRoles
from defgrain.functions import numbers, text
from defgrain.operators import augment as aug
from defgrain.operators import dedup as dd
from defgrain.operators import extract as ex
from defgrain.operators import kept_index
from defgrain.operators import pairs as pr
from defgrain.operators import parse_store as ps
from defgrain.operators import tags as tg
from defgrain.operators.normalize import normalize_samples
from defgrain.sources.staging import new_folder, stage

from .common import (
    CODE_DOC,
    CORPUS_CODE,
    CORPUS_FX,
    DEDUP_CODE,
    NL,
    OUTCOME_CODE,
    PLACEHOLDER_SQL,
    QUALITY_DOC,
    QUALITY_NAME,
    RENAME_CODE,
    blank_sql,
    corpus_rows,
    dedup_rows,
    invalid_sql,
    keyed,
    low_quality_sql,
    norm_code_sql,
    norm_doc_sql,
    outcome_rows,
    quality_rows,
    ratio_sql,
    rename_rows,
    repetitive_sql,
    strip_sql,
    table,
)

CODE = ColumnRoles("code")
TEXT = ColumnRoles("text")
DOC_ONLY = ColumnRoles("function_name", "doc")

# --- 2.3 ----------------------------------------------------------------------------------

# Real texts with line ends and blanks the tables lack, the same in both engines.
MESSY = f"chr(9) || replace(text, {NL}, chr(13) || chr(10) || chr(9)) || chr(13) || '\u2003\u3000\x85 '"
MESSY_DOC = "repeat('\"', 3) || ' ' || text || chr(9) || chr(9) || text || ' ' || repeat('\"', 3)"


def normalize_code(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", F.expr(MESSY).alias("t"))
    return t.select("doc_id", text.normalize_code("t").alias("code"))


def normalize_docstring(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", F.expr(MESSY_DOC).alias("t"))
    return t.select("doc_id", text.normalize_docstring("t").alias("doc"))


def normalize_rows(spark, sf_dir):
    t = normalize_samples(corpus_rows(spark, sf_dir), CODE_DOC)
    return t.select(F.col("_row_id").alias("doc_id"), "code", "doc")


def is_blank(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", F.expr(CORPUS_CODE).alias("code"))
    return t.select("doc_id", text.is_blank("code").alias("blank"))


def sha256_hex(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", text.sha256_hex("text").alias("hash"))


def safe_ratio(spark, sf_dir):
    """Purchases per event of a user, exact decimal ties included."""
    t = table(spark, sf_dir, "events").groupBy("user_id")
    t = t.agg(F.count_if(F.col("event_type") == "purchase").alias("n"), F.count_if(F.col("value") > 1).alias("d"))
    return t.select("user_id", numbers.safe_ratio(F.col("n"), F.col("d")).alias("ratio"))


def char_length(spark, sf_dir):
    t = table(spark, sf_dir, "pages")
    return t.select("page_id", text.char_length("html").cast("long").alias("n_chars"))


KEYWORDS = ["the ", "für", "Été", "que", "über"]


def substring_match(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", text.substring_match("text", KEYWORDS).alias("hit"))


# --- 2.4 ----------------------------------------------------------------------------------

P = "CAST(p_partkey AS STRING)"
OUTCOME_FX = f"""WITH src AS (SELECT p_partkey AS id, p_partkey % 6 AS k, {OUTCOME_CODE} AS code FROM part),
fx AS (
  SELECT id, k, 0 AS fn_ord,
    CASE WHEN k = 0 THEN 'def f_' || id || '(x):' || {NL} || '    return x' ELSE code END AS code,
    CASE k WHEN 0 THEN 'f_' || id WHEN 1 THEN 'h_' || id WHEN 5 THEN 'k_' || id END AS function_name,
    CASE k WHEN 0 THEN 'x' WHEN 1 THEN 'a' WHEN 5 THEN 'a,b' ELSE '' END AS parameters,
    CASE WHEN k = 5 THEN 'int' END AS return_annotation,
    CASE WHEN k = 5 THEN 'Add two numbers.' END AS docstring_in_code,
    CASE k WHEN 0 THEN 'return x' WHEN 1 THEN 'return a' WHEN 5 THEN 'return a + b' END AS body_without_docstring,
    k = 5 AS is_async, k IN (0, 1, 5) AS parse_ok,
    CASE k WHEN 2 THEN 'syntax error' WHEN 3 THEN 'no function definition' WHEN 4 THEN 'no function definition' END AS error,
    CASE k WHEN 0 THEN 'def f_' || id || '(x):' WHEN 1 THEN 'def h_' || id || '(a):'
      WHEN 5 THEN 'async def k_' || id || '(a: int, b=2) -> int:' END AS signature
  FROM src
  UNION ALL
  SELECT id, k, 1, 'def g(y):' || {NL} || '    return y', 'g', 'y', NULL, NULL, 'return y', FALSE, TRUE, NULL, 'def g(y):'
  FROM src WHERE k = 0
)"""


def _extracted(spark, sf_dir):
    return ex.extract_functions(outcome_rows(spark, sf_dir), CODE)


def _ids(df, *columns):
    return df.select(F.col("_row_id").alias("id"), F.col("_fn_ord").alias("fn_ord"), *columns)


def extract_functions(spark, sf_dir):
    kind = F.substring_index("error_message", ":", 1).alias("error")
    return _ids(_extracted(spark, sf_dir), "code", "function_name", "parse_ok", kind)


def extract_distinct(spark, sf_dir):
    """The form for corpora of far-spread copies: each text parsed once, joined back by hash."""
    rows = ex.extract_functions(dedup_rows(spark, sf_dir), CODE, parse_distinct=True)
    return _ids(rows, "code", "function_name", "parse_ok")


INVENTORY = ["function_name", "return_annotation", "docstring_in_code", "body_without_docstring", "is_async"]


def extract_stored(spark, sf_dir):
    """The whole table against a store that has the first half of its texts from an earlier load."""
    rows = stage(outcome_rows(spark, sf_dir), "rows")
    root, last = new_folder(spark, "parsed"), rows.agg(F.max("_row_id")).first()[0] or 0
    ps.extract_stored(rows.where(F.col("_row_id") <= last // 2), CODE, root, "first")
    rows = ps.extract_stored(rows, CODE, root, "second")
    return rows.select(
        F.col("_row_id").alias("id"),
        F.col("_fn_ord").alias("fn_ord"),
        "code",
        "function_name",
        "parse_ok",
        F.substring_index("error_message", ":", 1).alias("error"),
    )


def function_inventory(spark, sf_dir):
    rows = ex.function_inventory(_extracted(spark, sf_dir))
    return _ids(rows, *INVENTORY, F.array_join("parameters", ",").alias("parameters"))


def parse_counts(spark, sf_dir):
    return ex.parse_counts(_extracted(spark, sf_dir))


def extract_toggle(spark, sf_dir):
    rows = ex.extract_functions(outcome_rows(spark, sf_dir), CODE, enabled=False)
    return _ids(rows, "code", "function_name", "parse_ok", "signature")


def function_signature(spark, sf_dir):
    return _ids(ex.function_signature(_extracted(spark, sf_dir)), "signature")


# --- 2.5 ----------------------------------------------------------------------------------


def _parsed_corpus(spark, sf_dir):
    return ex.extract_functions(normalize_samples(corpus_rows(spark, sf_dir), CODE_DOC), CODE_DOC)


def _docs(spark, sf_dir):
    return keyed(spark, sf_dir, "documents", "doc_id")


def tag_invalid(spark, sf_dir):
    rows = tg.tag_invalid(_parsed_corpus(spark, sf_dir), CODE_DOC)
    return rows.select(F.col("_row_id").alias("doc_id"), F.col("_fn_ord").alias("fn_ord"), "drop_reason")


def filter_invalid(spark, sf_dir):
    return tg.filter_invalid(_docs(spark, sf_dir), TEXT).select("doc_id", "text")


def invalid_reason_counts(spark, sf_dir):
    return tg.invalid_reason_counts(tg.tag_invalid(_docs(spark, sf_dir), TEXT), "source")


def _reason_counts_sql(tagged: str, reasons: list[str], by: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT {by}, '{r}' AS drop_reason, count(*) FILTER (WHERE drop_reason = '{r}') AS n FROM t GROUP BY {by}"
        for r in reasons
    )
    return f"WITH t AS ({tagged}) {rows}"


def is_placeholder(spark, sf_dir):
    t = quality_rows(spark, sf_dir)
    return t.select(F.col("_row_id").alias("id"), tg.is_placeholder("doc").alias("placeholder"))


def is_repetitive(spark, sf_dir):
    t = quality_rows(spark, sf_dir)
    return t.select(F.col("_row_id").alias("id"), tg.is_repetitive("doc", "function_name").alias("repetitive"))


QUALITY_SRC = f"SELECT c_custkey AS id, {QUALITY_NAME} AS function_name, {QUALITY_DOC} AS doc FROM customer"
QUALITY_TAGGED = f"SELECT *, {low_quality_sql('doc', 'function_name')} AS drop_reason FROM ({QUALITY_SRC})"


def tag_low_quality(spark, sf_dir):
    rows = tg.tag_low_quality(quality_rows(spark, sf_dir), DOC_ONLY)
    return rows.select(F.col("_row_id").alias("id"), "drop_reason")


def tag_low_quality_relaxed(spark, sf_dir):
    rows = tg.tag_low_quality(quality_rows(spark, sf_dir), DOC_ONLY, 3)
    return rows.select(F.col("_row_id").alias("id"), "drop_reason")


def filter_low_quality(spark, sf_dir):
    rows = tg.filter_low_quality(quality_rows(spark, sf_dir), DOC_ONLY)
    return rows.select(F.col("_row_id").alias("id"), "doc")


def low_quality_reason_counts(spark, sf_dir):
    tagged = tg.tag_low_quality(quality_rows(spark, sf_dir), DOC_ONLY)
    return tg.low_quality_reason_counts(tagged.withColumn("name", F.col("function_name")), "name")


def border_candidates(spark, sf_dir):
    rows = tg.border_candidates(quality_rows(spark, sf_dir), DOC_ONLY)
    return rows.select(F.col("_row_id").alias("id"), "docstring", "function_name")


def apply_verdicts(spark, sf_dir):
    verdict = F.when(F.col("toxic") == 1, "low_quality").when(F.col("quality") == 1, "high_quality").otherwise("unsure")
    verdicts = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_row_id"), verdict.alias("verdict"))
    return tg.apply_verdicts(_docs(spark, sf_dir), verdicts).select("doc_id", "verdict", "drop_reason")


# --- 2.6 ----------------------------------------------------------------------------------


def dedup_exact(spark, sf_dir):
    return dd.dedup_exact(_docs(spark, sf_dir).select("_row_id", "doc_id", "text"), TEXT).select("doc_id", "text")


def _parsed_copies(spark, sf_dir):
    return stage(ex.extract_functions(dedup_rows(spark, sf_dir), CODE), "parsed")


COPIES_SRC = f"SELECT p_partkey AS id, {DEDUP_CODE} AS code, p_partkey % 500 AS tree FROM part"
COPIES_TAGGED = f"""SELECT id, CASE WHEN t_rn > 1 THEN 'exact_duplicate' WHEN a_rn > 1 THEN 'ast_duplicate' END AS drop_reason
  FROM (SELECT *, row_number() OVER (PARTITION BY tree, t_rn = 1 ORDER BY id) AS a_rn FROM
    (SELECT *, row_number() OVER (PARTITION BY code ORDER BY id) AS t_rn FROM ({COPIES_SRC})))"""


def dedup_ast(spark, sf_dir):
    return dd.dedup_ast(_parsed_copies(spark, sf_dir), CODE).select(F.col("_row_id").alias("id"), "code")


def dedup_samples(spark, sf_dir):
    tagged = dd.tag_duplicates(_parsed_copies(spark, sf_dir), CODE)
    return tagged.select(F.col("_row_id").alias("id"), "drop_reason")


def dedup_loads(spark, sf_dir):
    """The same rows in three loads against a stored index."""
    rows = stage(_parsed_copies(spark, sf_dir), "rows")
    root, last = new_folder(spark, "kept"), rows.agg(F.max("_row_id")).first()[0] or 0
    tagged = []
    for k in range(3):
        part = rows.where((F.col("_row_id") > last * k // 3 - (k == 0)) & (F.col("_row_id") <= last * (k + 1) // 3))
        tagged.append(stage(kept_index.tag_load(part, CODE, root, f"load{k}", stage), "tagged"))
    whole = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    return whole.select(F.col("_row_id").alias("id"), "drop_reason")


def dedup_counts(spark, sf_dir):
    return dd.dedup_counts(dd.tag_duplicates(_parsed_copies(spark, sf_dir), CODE))


def dup_groups(spark, sf_dir):
    return dd.dup_groups(_docs(spark, sf_dir), TEXT)


# --- 2.7 ----------------------------------------------------------------------------------


def _parsed_renames(spark, sf_dir):
    return ex.extract_functions(rename_rows(spark, sf_dir), CODE)


RENAME_SRC = f"SELECT o_orderkey AS id, o_orderkey % 3 AS k, o_orderkey % 100 AS h, {RENAME_CODE} AS code FROM orders"
NAMES = f"""SELECT id, unnest(CASE k WHEN 0 THEN ['tmp', 'total'] WHEN 2 THEN ['var_2', 'x'] ELSE [] END) AS name
  FROM ({RENAME_SRC})"""
NEW_CODE = (
    f"'def o_' || h || '(a, b):' || {NL} || '    var_2 = a + b' || {NL} || '    var_1 = var_2 * 2' || {NL} || '    return var_1'"
)


def local_names(spark, sf_dir):
    return aug.local_names(_parsed_renames(spark, sf_dir)).select(F.col("_row_id").alias("id"), "name")


def rename_map(spark, sf_dir):
    return aug.rename_map(_parsed_renames(spark, sf_dir)).select(F.col("_row_id").alias("id"), "name", "new_name")


def augment_rename(spark, sf_dir):
    rows = aug.augment_rename(_parsed_renames(spark, sf_dir), CODE)
    return rows.select(
        F.col("_row_id").alias("id"), "code", "body_without_docstring", F.array_join("local_names", ",").alias("names")
    )


def _augmented(spark, sf_dir):
    base = stage(_parsed_renames(spark, sf_dir), "parsed")
    return base, stage(aug.augment_rename(base, CODE), "renamed")


def augment_rename_fresh(spark, sf_dir):
    """Every function with a plain local name gives a row, also where ``var_n`` is taken."""
    rows = aug.augment_rename(_parsed_renames(spark, sf_dir), CODE, fresh=True)
    return rows.select(F.col("_row_id").alias("id"), "code", F.array_join("local_names", ",").alias("names"))


def augment_antijoin(spark, sf_dir):
    base, new = _augmented(spark, sf_dir)
    return aug.augment_antijoin(base, new, CODE).select(F.col("_row_id").alias("id"), "code")


def augment_union(spark, sf_dir):
    base, new = _augmented(spark, sf_dir)
    both = aug.augment_union(base, aug.augment_antijoin(base, new, CODE))
    return both.select(F.col("_row_id").alias("id"), "code", "is_augmented")


def augment_counts(spark, sf_dir):
    base, new = _augmented(spark, sf_dir)
    return aug.augment_counts(base, aug.tag_augmented(base, new, CODE))


# --- 2.8 ----------------------------------------------------------------------------------

PAIR_SRC = f"""WITH {CORPUS_FX}, usable AS (
  SELECT *, {strip_sql("CASE WHEN doc <> '' THEN doc ELSE in_doc END")} AS d FROM fx WHERE parse_ok)"""
D2C = """SELECT doc_id, fn_ord, 'docstring_to_code' AS pair_type,
  'Generate Python function implementation from the given docstring.' AS instruction,
  d AS input, code AS output, function_name AS source_function_name FROM usable WHERE d <> ''"""
S2B = """SELECT doc_id, fn_ord, 'signature_to_body' AS pair_type,
  'Complete the Python function body according to the signature.' AS instruction,
  signature AS input, body AS output, function_name AS source_function_name FROM usable"""
C2D = """SELECT doc_id, fn_ord, 'code_to_docstring' AS pair_type,
  'Generate a concise docstring for the given Python function.' AS instruction,
  code AS input, d AS output, function_name AS source_function_name FROM usable WHERE d <> ''"""


def _pair_rows(rows):
    return rows.select(
        F.col("_row_id").alias("doc_id"),
        F.col("_fn_ord").alias("fn_ord"),
        "pair_type",
        "instruction",
        "input",
        "output",
        "source_function_name",
    )


def pair_doc_to_code(spark, sf_dir):
    return _pair_rows(pr.pair_doc_to_code(_parsed_corpus(spark, sf_dir), CODE_DOC))


def pair_signature_to_body(spark, sf_dir):
    return _pair_rows(pr.pair_signature_to_body(_parsed_corpus(spark, sf_dir), CODE_DOC))


def pair_code_to_doc(spark, sf_dir):
    return _pair_rows(pr.pair_code_to_doc(_parsed_corpus(spark, sf_dir), CODE_DOC))


def build_pairs(spark, sf_dir):
    return _pair_rows(pr.build_pairs(_parsed_corpus(spark, sf_dir), CODE_DOC))


def pair_counts(spark, sf_dir):
    return pr.pair_counts(_parsed_corpus(spark, sf_dir), CODE_DOC, "run_id")


CATALOG = {
    "normalize_code": (
        normalize_code,
        f"SELECT doc_id, {norm_code_sql('t')} AS code FROM (SELECT doc_id, {MESSY} AS t FROM documents)",
    ),
    "normalize_docstring": (
        normalize_docstring,
        f"SELECT doc_id, {norm_doc_sql('t')} AS doc FROM (SELECT doc_id, {MESSY_DOC} AS t FROM documents)",
    ),
    "normalize_samples": (
        normalize_rows,
        f"SELECT doc_id, {norm_code_sql(CORPUS_CODE)} AS code, {norm_doc_sql('text')} AS doc FROM documents",
    ),
    "is_blank": (is_blank, f"SELECT doc_id, {blank_sql('c')} AS blank FROM (SELECT doc_id, {CORPUS_CODE} AS c FROM documents)"),
    "sha256_hex": (sha256_hex, "SELECT conv_id, turn, sha256(text) AS hash FROM conversations"),
    "safe_ratio": (
        safe_ratio,
        f"""SELECT user_id, {ratio_sql('n', 'd')} AS ratio FROM (SELECT user_id,
          count(*) FILTER (WHERE event_type = 'purchase') AS n, count(*) FILTER (WHERE value > 1) AS d
          FROM events GROUP BY user_id)""",
    ),
    "char_length": (char_length, "SELECT page_id, length(html) AS n_chars FROM pages"),
    "substring_match": (
        substring_match,
        "SELECT conv_id, turn, "
        + " OR ".join(f"contains(lower(text), '{k}')" for k in KEYWORDS)
        + " AS hit FROM conversations",
    ),
    "extract_functions": (
        extract_functions,
        f"{OUTCOME_FX} SELECT id, fn_ord, code, function_name, parse_ok, error FROM fx",
    ),
    "extract_stored": (
        extract_stored,
        f"{OUTCOME_FX} SELECT id, fn_ord, code, function_name, parse_ok, error FROM fx",
    ),
    "extract_distinct": (
        extract_distinct,
        f"SELECT id, 0 AS fn_ord, code, 'part_' || tree AS function_name, TRUE AS parse_ok FROM ({COPIES_SRC})",
    ),
    "function_inventory": (
        function_inventory,
        f"{OUTCOME_FX} SELECT id, fn_ord, {', '.join(INVENTORY)}, parameters FROM fx WHERE parse_ok",
    ),
    "parse_counts": (
        parse_counts,
        f"""{OUTCOME_FX} SELECT count(*) FILTER (WHERE parse_ok) AS ast_parse_success_count,
          count(*) FILTER (WHERE NOT parse_ok) AS parse_failed_rows FROM fx""",
    ),
    "extract_toggle": (
        extract_toggle,
        f"""SELECT p_partkey AS id, 0 AS fn_ord, {OUTCOME_CODE} AS code, CAST(NULL AS STRING) AS function_name,
          CAST(NULL AS BOOLEAN) AS parse_ok, CAST(NULL AS STRING) AS signature FROM part""",
    ),
    "function_signature": (
        function_signature,
        f"{OUTCOME_FX} SELECT id, fn_ord, signature FROM fx WHERE signature IS NOT NULL",
    ),
    "tag_invalid": (
        tag_invalid,
        f"WITH {CORPUS_FX} SELECT doc_id, fn_ord, {invalid_sql('code', 'doc', parsed=True)} AS drop_reason FROM fx",
    ),
    "filter_invalid": (filter_invalid, f"SELECT doc_id, text FROM documents WHERE {invalid_sql('text')} IS NULL"),
    "invalid_reason_counts": (
        invalid_reason_counts,
        _reason_counts_sql(
            f"SELECT source, {invalid_sql('text')} AS drop_reason FROM documents", tg.INVALID_REASONS, "source"
        ),
    ),
    "is_placeholder": (
        is_placeholder,
        f"SELECT id, lower({strip_sql('doc')}) IN {PLACEHOLDER_SQL} AS placeholder FROM ({QUALITY_SRC})",
    ),
    "is_repetitive": (
        is_repetitive,
        f"SELECT id, {repetitive_sql('doc', 'function_name')} AS repetitive FROM ({QUALITY_SRC})",
    ),
    "tag_low_quality": (tag_low_quality, f"SELECT id, drop_reason FROM ({QUALITY_TAGGED})"),
    "tag_low_quality_relaxed": (
        tag_low_quality_relaxed,
        f"SELECT id, {low_quality_sql('doc', 'function_name', 3)} AS drop_reason FROM ({QUALITY_SRC})",
    ),
    "filter_low_quality": (
        filter_low_quality,
        f"SELECT id, doc FROM ({QUALITY_TAGGED}) WHERE drop_reason IS NULL",
    ),
    "low_quality_reason_counts": (
        low_quality_reason_counts,
        _reason_counts_sql(
            f"SELECT function_name AS name, drop_reason FROM ({QUALITY_TAGGED})", tg.LOW_QUALITY_REASONS, "name"
        ),
    ),
    "border_candidates": (
        border_candidates,
        f"""SELECT id, {strip_sql('doc')} AS docstring, function_name FROM ({QUALITY_TAGGED})
          WHERE drop_reason IS NULL AND length({strip_sql('doc')}) BETWEEN 10 AND 60""",
    ),
    "apply_verdicts": (
        apply_verdicts,
        """SELECT doc_id, coalesce(CASE WHEN toxic = 1 THEN 'low_quality' WHEN quality = 1 THEN 'high_quality' END,
            'uncertain') AS verdict, CASE WHEN toxic = 1 THEN 'judged_low_quality' END AS drop_reason
          FROM documents LEFT JOIN labels USING (doc_id)""",
    ),
    "dedup_exact": (
        dedup_exact,
        "SELECT min(doc_id) AS doc_id, text FROM documents WHERE text <> '' GROUP BY text "
        "UNION ALL SELECT doc_id, text FROM documents WHERE text IS NULL OR text = ''",
    ),
    "dedup_ast": (
        dedup_ast,
        f"SELECT id, code FROM ({COPIES_SRC}) QUALIFY row_number() OVER (PARTITION BY tree ORDER BY id) = 1",
    ),
    "dedup_samples": (dedup_samples, COPIES_TAGGED),
    "dedup_loads": (dedup_loads, COPIES_TAGGED),
    "dedup_counts": (
        dedup_counts,
        f"""SELECT count(drop_reason) AS dedup_removed_count,
          count(*) FILTER (WHERE drop_reason = 'exact_duplicate') AS exact_dedup_removed_count,
          count(*) FILTER (WHERE drop_reason = 'ast_duplicate') AS ast_dedup_removed_count FROM ({COPIES_TAGGED})""",
    ),
    "dup_groups": (
        dup_groups,
        """SELECT sha256(text) AS code_hash, count(*) AS n, min(doc_id) AS first_key FROM documents
          WHERE text <> '' GROUP BY text HAVING count(*) > 1""",
    ),
    "local_names": (local_names, NAMES),
    "rename_map": (
        rename_map,
        f"""SELECT id, name, 'var_' || row_number() OVER (PARTITION BY id ORDER BY name) AS new_name FROM ({NAMES})
          QUALIFY NOT regexp_matches(name, '^var_[0-9]+$')""",
    ),
    "augment_rename": (
        augment_rename,
        f"""SELECT id, {NEW_CODE} AS code, 'var_2 = a + b' || {NL} || 'var_1 = var_2 * 2' || {NL} || 'return var_1'
            AS body_without_docstring, 'var_1,var_2' AS names FROM ({RENAME_SRC}) WHERE k = 0""",
    ),
    "augment_rename_fresh": (
        augment_rename_fresh,
        f"""SELECT id, 'var_1,var_2' AS names, CASE k WHEN 0 THEN {NEW_CODE} ELSE 'def v_' || id || '():' || {NL}
            || '    var_2 = 1' || {NL} || '    var_1 = 2' || {NL} || '    return var_2 + var_1' END AS code
            FROM ({RENAME_SRC}) WHERE k <> 1""",
    ),
    "augment_antijoin": (
        augment_antijoin,
        f"SELECT min(id) AS id, {NEW_CODE} AS code FROM ({RENAME_SRC}) WHERE k = 0 GROUP BY h",
    ),
    "augment_union": (
        augment_union,
        f"""SELECT id, code, FALSE AS is_augmented FROM ({RENAME_SRC}) UNION ALL
          SELECT min(id), {NEW_CODE}, TRUE FROM ({RENAME_SRC}) WHERE k = 0 GROUP BY h""",
    ),
    "augment_counts": (
        augment_counts,
        f"""SELECT count(*) AS augmentation_attempt_count,
          count(DISTINCT h) FILTER (WHERE k = 0) AS augmentation_success_count,
          count(*) FILTER (WHERE k <> 0) AS augmentation_failed_count,
          count(*) FILTER (WHERE k = 0) - count(DISTINCT h) FILTER (WHERE k = 0) AS augmentation_duplicate_dropped_count
          FROM ({RENAME_SRC})""",
    ),
    "pair_doc_to_code": (pair_doc_to_code, f"{PAIR_SRC} {D2C}"),
    "pair_signature_to_body": (pair_signature_to_body, f"{PAIR_SRC} {S2B}"),
    "pair_code_to_doc": (pair_code_to_doc, f"{PAIR_SRC} {C2D}"),
    "build_pairs": (build_pairs, f"{PAIR_SRC} {D2C} UNION ALL {S2B} UNION ALL {C2D}"),
    "pair_counts": (
        pair_counts,
        f"""WITH {CORPUS_FX}, p AS (SELECT run_id, parse_ok AS b,
            parse_ok AND NOT {blank_sql("CASE WHEN doc <> '' THEN doc ELSE in_doc END")} AS d FROM fx)
          SELECT run_id, count(*) FILTER (WHERE d) AS docstring_to_code_count,
            count(*) FILTER (WHERE b) AS signature_to_body_count, count(*) FILTER (WHERE d) AS code_to_docstring_count,
            2 * count(*) FILTER (WHERE d) + count(*) FILTER (WHERE b) AS instruction_pair_count,
            count(*) FILTER (WHERE NOT b) AS skipped_instruction_pair_count FROM p GROUP BY run_id""",
    ),
}
