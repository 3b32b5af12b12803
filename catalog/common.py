"""Inputs shared by the registered queries and their SQL counterparts.

The tables hold no source code, so code columns are templates over real rows: one SQL
expression, evaluated by Spark for the query and by the other engine for the oracle.
What the parser must find in a template is then known and can be written in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from defgrain.config import ColumnRoles
from defgrain.functions.text import WS
from defgrain.sources.readers import spread, with_row_id

NL = "chr(10)"


def _lines(*lines: str) -> str:
    return f" || {NL} || ".join(lines)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return with_row_id(table(spark, sf_dir, name), key)


# Many copies of few texts that differ by a comment: 1000 texts and 500 trees per 1500 keys.
DEDUP_CODE = _lines(
    "'def part_' || CAST(p_partkey % 500 AS STRING) || '(a, b):'",
    f"CASE WHEN p_partkey % 3 = 0 THEN '    # note' || {NL} ELSE '' END || '    total = a + b'",
    "'    return total'",
)

# Six extraction outcomes.
P = "CAST(p_partkey AS STRING)"
OUTCOME_CODE = (
    "CASE p_partkey % 6 "
    f"WHEN 0 THEN {_lines(f"'def f_' || {P} || '(x): return x'", "'def g(y): return y'")} "
    f"WHEN 1 THEN {_lines(f"'def h_' || {P} || '(a):'", "'    return a'")} "
    "WHEN 2 THEN 'def broken(:' "
    "WHEN 3 THEN 'x = 1' "
    "WHEN 4 THEN '   ' "
    "ELSE "
    + _lines(
        f"'async def k_' || {P} || '(a: int, b=2) -> int:'",
        "'    \"\"\"Add two numbers.\"\"\"'",
        "'    return a + b'",
    )
    + " END"
)

# Docstrings of every quality, with the function name they belong to.
QUALITY_NAME = "'f_' || CAST(c_custkey % 10 AS STRING)"
QUALITY_DOC = (
    "CASE c_custkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'doc' WHEN 2 THEN 'fixme' WHEN 3 THEN 'todo' "
    "WHEN 4 THEN 'F_' || CAST(c_custkey % 10 AS STRING) || ' Function' WHEN 5 THEN 'handles rows of orders' "
    "WHEN 6 THEN 'x y z w' WHEN 7 THEN 'Computes the total of all order lines of ' || c_name || ' and returns it as a float' "
    "ELSE '  Placeholder ' END"
)

# Renaming: renamable, nothing to rename, unsafe to rename.
O = "CAST(o_orderkey AS STRING)"
RENAME_CODE = (
    "CASE o_orderkey % 3 "
    "WHEN 0 THEN "
    + _lines(
        "'def o_' || CAST(o_orderkey % 100 AS STRING) || '(a, b):'",
        "'    total = a + b'",
        "'    tmp = total * 2'",
        "'    return tmp'",
    )
    + f" WHEN 1 THEN {_lines(f"'def n_' || {O} || '(a):'", "'    return a'")} "
    + f"ELSE {_lines(f"'def v_' || {O} || '():'", "'    var_2 = 1'", "'    x = 2'", "'    return var_2 + x'")} END"
)

# A corpus of eight kinds of code with the documents' texts as docstrings; each document
# source acts as one data set (run).
D = "CAST(doc_id AS STRING)"
CORPUS_CODE = (
    "CASE doc_id % 8 "
    f"WHEN 0 THEN {_lines(f"'def f_' || {D} || '(x):'", "'    return x'", "''", "'def g(y):'", "'    return y'")} "
    f"WHEN 1 THEN {_lines("'  def h_' || CAST(doc_id % 40 AS STRING) || '(a):'", "'    return a'")} "
    "WHEN 2 THEN 'def broken(:' WHEN 3 THEN 'x = 1' WHEN 4 THEN ' ' || chr(9) || ' ' "
    "WHEN 5 THEN "
    + _lines(
        f"'async def k_' || {D} || '(a: int, b=2) -> int:'",
        "'    \"\"\"Add two numbers.\"\"\"'",
        "'    return a + b'",
    )
    + " WHEN 6 THEN "
    + _lines(
        "'def part_' || CAST(doc_id % 30 AS STRING) || '(a, b):'",
        f"CASE WHEN doc_id % 3 = 0 THEN '    # note' || {NL} ELSE '' END || '    total = a + b'",
        "'    return total'",
    )
    + " ELSE 'def o_' || CAST(doc_id % 50 AS STRING) || '(a, b):' || chr(13) || chr(10) || chr(9) || 'total = a + b' "
    "|| chr(13) || chr(10) || chr(9) || 'tmp = total * 2' || chr(13) || chr(10) || chr(9) || 'return tmp' END"
)

CODE_DOC = ColumnRoles("code", "doc")


def dedup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = keyed(spark, sf_dir, "part", "p_partkey").select("_row_id", "p_partkey")
    return spread(t).select("_row_id", F.expr(DEDUP_CODE).alias("code"))


def outcome_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = keyed(spark, sf_dir, "part", "p_partkey").select("_row_id", "p_partkey", "p_brand")
    return spread(t).select("_row_id", "p_brand", F.expr(OUTCOME_CODE).alias("code"))


def quality_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = keyed(spark, sf_dir, "customer", "c_custkey")
    return t.select("_row_id", F.expr(QUALITY_NAME).alias("function_name"), F.expr(QUALITY_DOC).alias("doc"))


def rename_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = keyed(spark, sf_dir, "orders", "o_orderkey").select("_row_id", "o_orderkey")
    return spread(t).select("_row_id", F.expr(RENAME_CODE).alias("code"))


def corpus_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = keyed(spark, sf_dir, "documents", "doc_id").select("_row_id", "doc_id", "source", "lang", "text")
    return spread(t).select(
        "_row_id",
        F.col("source").alias("run_id"),
        "lang",
        F.col("text").alias("doc"),
        F.expr(CORPUS_CODE).alias("code"),
    )


# --- SQL side -----------------------------------------------------------------------------

WS_SQL = "'" + WS + "'"


def strip_sql(x: str) -> str:
    return f"trim({x}, {WS_SQL})"


def norm_code_sql(x: str) -> str:
    unix = f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    return strip_sql(f"replace({unix}, chr(9), '    ')")


def norm_doc_sql(x: str) -> str:
    t = strip_sql(x)
    quoted = " OR ".join(f"(starts_with({t}, {q}) AND ends_with({t}, {q}))" for q in ("'\"\"\"'", "repeat(chr(39), 3)"))
    peeled = f"CASE WHEN length({t}) >= 6 AND ({quoted}) THEN {strip_sql(f'substr({t}, 4, length({t}) - 6)')} ELSE {t} END"
    return strip_sql(f"regexp_replace({peeled}, '[ \\t]+', ' ', 'g')")


def blank_sql(x: str) -> str:
    return f"({x} IS NULL OR {strip_sql(x)} = '')"


def round_sql(x: str, digits: int, ties: str = "even") -> str:
    """Round by the stored double, see defgrain.functions.numbers."""
    s = f"{10**digits}.0::DOUBLE"
    a = f"abs({x})"
    split = "134217729.0::DOUBLE"
    high = f"({a} * {split} - ({a} * {split} - {a}))"
    err = f"(({high} * {s} - {a} * {s}) + ({a} - {high}) * {s})"
    below = f"floor({a} * {s})"
    excess = f"(({a} * {s} - {below} - 0.5::DOUBLE) + {err})"
    tie = "TRUE" if ties == "away" else f"{below} % 2 = 1"
    return (
        f"(({below} + CASE WHEN {excess} > 0 OR ({excess} = 0 AND {tie}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / {s}"
        f" * CASE WHEN {x} < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END)"
    )


def ratio_sql(n: str, d: str, digits: int = 4) -> str:
    """Ratio of two plain columns; pass column names, the text is repeated."""
    q = f"(CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE))"
    return f"CASE WHEN {d} = 0 THEN 0.0::DOUBLE ELSE {round_sql(q, digits)} END"


INVALID_SQL = """CASE
  WHEN {blank} THEN 'empty_code'
  {parse}
  WHEN length({code}) < 10 THEN 'code_too_short'
  WHEN length({code}) > 8000 THEN 'code_too_long'
  {doc}
END"""


def invalid_sql(code: str, doc: str | None = None, parsed: bool = False) -> str:
    parse = "WHEN NOT parse_ok THEN 'ast_parse_failed'" if parsed else ""
    doc_rule = f"WHEN length({doc}) > 2000 THEN 'docstring_too_long'" if doc else ""
    return INVALID_SQL.format(blank=blank_sql(code), code=code, parse=parse, doc=doc_rule)


PLACEHOLDER_SQL = "('todo', 'fixme', 'test', 'temp', 'none', 'n/a', 'tbd', 'placeholder')"


def repetitive_sql(doc: str, name: str) -> str:
    d, n = f"lower({strip_sql(doc)})", f"lower({strip_sql(name)})"
    return (
        f"(coalesce({name}, '') <> '' AND ({d} = {n} OR {d} IN ({n} || ' function', {n} || ' method', "
        f"{n} || 'function', {n} || 'method') OR replace({d}, '_', '') = replace({n}, '_', '')))"
    )


def low_quality_sql(doc: str, name: str | None, min_len: int = 5) -> str:
    repeat = f"WHEN {repetitive_sql(doc, name)} THEN 'repetitive_docstring'" if name else ""
    return (
        f"CASE WHEN {blank_sql(doc)} THEN 'empty_docstring' "
        f"WHEN length({strip_sql(doc)}) < {min_len} THEN 'short_docstring' "
        f"WHEN lower({strip_sql(doc)}) IN {PLACEHOLDER_SQL} THEN 'placeholder_docstring' {repeat} END"
    )


def _per_class(values: dict[int, str]) -> str:
    whens = " ".join(f"WHEN {k} THEN {v}" for k, v in values.items())
    return f"CASE doc_id % 8 {whens} END"


# The corpus after normalisation and extraction, written out per kind of code.
CORPUS_FX = f"""
raw AS (
  SELECT doc_id, source AS run_id, {norm_doc_sql('text')} AS doc, {norm_code_sql(CORPUS_CODE)} AS code FROM documents
),
fx AS (
  SELECT doc_id, 0 AS fn_ord, run_id, doc,
    CASE WHEN doc_id % 8 = 0 THEN {_lines(f"'def f_' || {D} || '(x):'", "'    return x'")} ELSE code END AS code,
    {_per_class({0: f"'f_' || {D}", 1: "'h_' || CAST(doc_id % 40 AS STRING)", 5: f"'k_' || {D}",
                 6: "'part_' || CAST(doc_id % 30 AS STRING)", 7: "'o_' || CAST(doc_id % 50 AS STRING)"})} AS function_name,
    doc_id % 8 NOT IN (2, 3, 4) AS parse_ok,
    CASE WHEN doc_id % 8 = 5 THEN 'int' END AS return_annotation,
    CASE WHEN doc_id % 8 = 5 THEN 'Add two numbers.' END AS in_doc,
    {_per_class({0: "'return x'", 1: "'return a'", 5: "'return a + b'",
                 6: "'total = a + b' || chr(10) || 'return total'",
                 7: "'total = a + b' || chr(10) || 'tmp = total * 2' || chr(10) || 'return tmp'"})} AS body,
    {_per_class({0: f"'def f_' || {D} || '(x):'", 1: "'def h_' || CAST(doc_id % 40 AS STRING) || '(a):'",
                 5: f"'async def k_' || {D} || '(a: int, b=2) -> int:'",
                 6: "'def part_' || CAST(doc_id % 30 AS STRING) || '(a, b):'",
                 7: "'def o_' || CAST(doc_id % 50 AS STRING) || '(a, b):'"})} AS signature
  FROM raw
  UNION ALL
  SELECT doc_id, 1, run_id, doc, 'def g(y):' || chr(10) || '    return y', 'g', TRUE, NULL, NULL, 'return y', 'def g(y):'
  FROM raw WHERE doc_id % 8 = 0
)"""


def corpus_tags(min_len: int = 5, dedup: bool = True) -> str:
    """CTEs from documents to ``tagged``: invalid, docstring and duplicate rules per run."""
    text_first = "row_number() OVER (PARTITION BY run_id, code ORDER BY doc_id, fn_ord)"
    tree_first = "row_number() OVER (PARTITION BY run_id, function_name ORDER BY doc_id, fn_ord)"
    exact = "t_rn > 1" if dedup else "FALSE"
    tree = "a_rn > 1" if dedup else "FALSE"
    return f"""{CORPUS_FX},
t1 AS (SELECT *, {invalid_sql('code', 'doc', parsed=True)} AS r1 FROM fx),
t2 AS (SELECT *, CASE WHEN r1 IS NULL THEN {low_quality_sql('doc', 'function_name', min_len)} END AS r2 FROM t1),
texts AS (SELECT doc_id, fn_ord, {text_first} AS t_rn FROM t2 WHERE r1 IS NULL AND r2 IS NULL),
trees AS (
  SELECT t2.doc_id, t2.fn_ord, {tree_first} AS a_rn
  FROM t2 JOIN texts USING (doc_id, fn_ord) WHERE NOT ({exact})
),
tagged AS (
  SELECT t2.* EXCLUDE (r1, r2),
    CASE WHEN r1 IS NOT NULL THEN 'filter_invalid' WHEN r2 IS NOT NULL THEN 'filter_low_quality'
         WHEN {exact} OR {tree} THEN 'deduplicate' END AS drop_stage,
    coalesce(r1, r2, CASE WHEN {exact} THEN 'exact_duplicate' WHEN {tree} THEN 'ast_duplicate' END) AS drop_reason
  FROM t2 LEFT JOIN texts USING (doc_id, fn_ord) LEFT JOIN trees USING (doc_id, fn_ord)
)"""


# The renamed copies of kept rows: only the last two kinds of code have local names, sorted as
# tmp, total. ``new`` tells them from the rows they were made from.
AUGMENTED = f"""made AS (
  SELECT doc_id, fn_ord, run_id, doc,
    CASE WHEN doc_id % 8 = 6
      THEN {_lines("'def part_' || CAST(doc_id % 30 AS STRING) || '(a, b):'", "'    var_1 = a + b'", "'    return var_1'")}
      ELSE {_lines("'def o_' || CAST(doc_id % 50 AS STRING) || '(a, b):'", "'    var_2 = a + b'", "'    var_1 = var_2 * 2'", "'    return var_1'")}
    END AS code,
    function_name, parse_ok, return_annotation, in_doc, body, signature, drop_stage, drop_reason, TRUE AS new
  FROM tagged WHERE drop_reason IS NULL AND doc_id % 8 IN (6, 7)
),
with_new AS (
  SELECT doc_id, fn_ord, run_id, doc, code, function_name, parse_ok, return_annotation, in_doc, body, signature,
    drop_stage, drop_reason, FALSE AS new FROM tagged
  UNION ALL SELECT * FROM made
)"""


def augmented_metrics_sql(select: str) -> str:
    return f"WITH {corpus_tags()}, {AUGMENTED}, {metrics_cte('with_new', new='new')} {select}"


def metrics_cte(tagged: str = "tagged", name: str = "m", with_pairs: bool = True, new: str = "FALSE") -> str:
    """CTEs from ``tagged`` to one row of run metrics per run."""
    c = lambda cond: f"count(*) FILTER (WHERE {cond})"
    reason = lambda r: c(f"drop_reason = '{r}'")
    kept = "drop_reason IS NULL"
    doc = f"(CASE WHEN doc <> '' THEN doc ELSE in_doc END)"
    has_doc = f"{kept} AND parse_ok AND NOT {blank_sql(doc)}"
    has_body = f"{kept} AND parse_ok"
    # Every kept row is tried; none of the new texts is a copy.
    made_not = f"{c(f'{kept} AND NOT {new}')} - {c(new)}" if new != "FALSE" else "CAST(0 AS BIGINT)"
    pairs = f"{c(has_doc)} * 2 + {c(has_body)}" if with_pairs else "CAST(0 AS BIGINT)"
    return f"""
{name}_c AS (
  SELECT run_id,
    {c(f'fn_ord = 0 AND NOT {new}')} AS raw_sample_count, {c(f'NOT {new}')} AS expanded_sample_count, {c(kept)} AS final_sample_count,
    {c(f'parse_ok AND NOT {new}')} AS ast_parse_success_count, {reason('ast_parse_failed')} AS ast_parse_failed_count,
    {c(f'NOT parse_ok AND NOT {new}')} AS parse_failed_rows,
    {reason('empty_code')} AS empty_code_count, {c("drop_stage = 'filter_invalid'")} AS invalid_removed_count,
    CAST(0 AS BIGINT) AS missing_function_name_count, {reason('code_too_short')} AS code_too_short_count,
    {reason('code_too_long')} AS code_too_long_count, {reason('docstring_too_long')} AS docstring_too_long_count,
    {c("drop_stage = 'filter_low_quality'")} AS low_quality_docstring_count,
    {c("drop_stage = 'deduplicate'")} AS dedup_removed_count,
    {reason('exact_duplicate')} AS exact_dedup_removed_count, {reason('ast_duplicate')} AS ast_dedup_removed_count,
    {c(new)} AS augmentation_success_count, {made_not} AS augmentation_failed_count,
    {c(f"{kept} AND parse_ok")} AS n_ok, {c(f"{kept} AND NOT {blank_sql(doc)}")} AS n_doc,
    {c(f"{kept} AND function_name <> ''")} AS n_name,
    {c(f"{kept} AND return_annotation <> '' AND return_annotation <> 'None'")} AS n_ret,
    coalesce(sum(length(code)) FILTER (WHERE {kept} AND code <> ''), 0) AS s_code, {c(f"{kept} AND code <> ''")} AS n_code,
    coalesce(sum(length(doc)) FILTER (WHERE {kept} AND doc <> ''), 0) AS s_doc, {c(f"{kept} AND doc <> ''")} AS n_text,
    {pairs} AS instruction_pair_count
  FROM {tagged} GROUP BY run_id
),
{name} AS (
  SELECT run_id, raw_sample_count, expanded_sample_count, final_sample_count,
    {ratio_sql('final_sample_count', 'raw_sample_count')} AS retain_rate,
    ast_parse_success_count, ast_parse_failed_count, parse_failed_rows, empty_code_count, invalid_removed_count,
    missing_function_name_count, code_too_short_count, code_too_long_count, docstring_too_long_count,
    low_quality_docstring_count, dedup_removed_count, exact_dedup_removed_count, ast_dedup_removed_count,
    augmentation_success_count, augmentation_failed_count,
    {ratio_sql('s_code', 'n_code', 2)} AS avg_code_length, {ratio_sql('s_doc', 'n_text', 2)} AS avg_docstring_length,
    {ratio_sql('n_ok', 'final_sample_count')} AS syntax_pass_rate,
    {ratio_sql('n_doc', 'final_sample_count')} AS docstring_coverage,
    {ratio_sql('n_name', 'final_sample_count')} AS function_name_match_rate,
    {ratio_sql('n_ret', 'final_sample_count')} AS return_annotation_rate,
    instruction_pair_count
  FROM {name}_c
)"""


def corpus_metrics_sql(select: str, **tag_args) -> str:
    return f"WITH {corpus_tags(**tag_args)}, {metrics_cte()} {select}"
