"""One row per top-level function.

The parser runs inside an Arrow UDF that receives the code column alone, so user columns
never leave the JVM, nothing is shuffled and a popular text cannot pile up in one task: its
rows stay where they were read and each task parses it once (bounded memo).
``parse_distinct=True`` is for corpora where most texts are far-spread copies: texts are
reduced to one per hash before parsing and the result is joined back on the hash, hot hashes
salted.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FN_ORD, ColumnRoles, engine, key_columns, set_aside
from ..functions import pysource
from ..functions.text import is_present, sha256_bin
from ..sources.staging import stage

# Executors get the helper module with the function, whatever is installed there.
cloudpickle.register_pickle_by_value(pysource)

_READ = [name for name, _, _ in pysource.FUNCTION_FIELDS if name not in ("code", "outcome", "detail")]
DERIVED_TYPES = {
    **{name: ddl for name, ddl, _ in pysource.FUNCTION_FIELDS if name in _READ},
    "parse_ok": "boolean",
    "error_message": "string",
}
DERIVED = list(DERIVED_TYPES)

# What the message of a row without facts begins with.
MESSAGES = {
    pysource.EMPTY: "empty code",
    pysource.SYNTAX: "syntax error",
    pysource.UNPARSABLE: "parse failed",
    pysource.NO_FUNCTION: "no function definition",
    pysource.UNREADABLE: "function not readable",
}


def derived_columns(function: str) -> dict[str, Column]:
    """The derived columns from the column that holds a parsed function."""
    outcome = F.col(f"{function}.outcome")
    label = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])[outcome]
    columns = {name: F.col(f"{function}.{name}") for name in _READ}
    columns["parse_ok"] = outcome == pysource.FUNCTION
    columns["error_message"] = F.when(label.isNotNull(), F.concat_ws(": ", label, F.col(f"{function}.detail")))
    return columns


def parse_functions(code: str | Column) -> Column:
    """array<struct> with one entry per top-level function, or one failed entry."""
    code = F.col(code) if isinstance(code, str) else code
    udf = F.arrow_udf(pysource.parse_batches, f"array<{pysource.FUNCTION_DDL}>")
    return udf(F.when(is_present(code), code))


def extract_functions(
    df: DataFrame, roles: ColumnRoles, enabled: bool = True, parse_distinct: bool = False
) -> DataFrame:
    """Expand rows to functions and add the derived columns.

    A row with one function keeps its text, a row with several becomes one row each with the
    printed function as text, any other row yields a single ``parse_ok = false`` row.
    ``enabled=False`` passes rows through with NULL derived columns.
    """
    roles.check(df)
    if not enabled:
        blanks = {n: F.lit(None).cast(ddl) for n, ddl in DERIVED_TYPES.items() if n not in df.columns}
        return df.withColumns({FN_ORD: F.lit(0), **blanks})
    df = set_aside(df, [*DERIVED, FN_ORD], roles)
    if parse_distinct:
        keyed, texts = texts_of(df, roles.code)
        parsed = join_parsed(keyed, texts, texts.select("_code_hash", parse_functions("_text").alias("_functions")))
    else:
        parsed = df.withColumn("_functions", parse_functions(roles.code))
    return expand_functions(parsed, df.columns, roles)


def expand_functions(parsed: DataFrame, columns: list[str], roles: ColumnRoles) -> DataFrame:
    """One row per entry of ``_functions`` with ``columns`` and the derived columns."""
    # The outer form: every array has an entry, and the inner form would add a size filter
    # that evaluates the UDF a second time.
    kept = [F.col(f"`{c}`") for c in columns]
    rows = parsed.select(*kept, F.posexplode_outer("_functions").alias(FN_ORD, "_fn"))
    return rows.select(
        *[F.coalesce("_fn.code", F.col(f"`{c}`")).alias(c) if c == roles.code else F.col(f"`{c}`") for c in columns],
        FN_ORD,
        *[engine(column, name) for name, column in derived_columns("_fn").items()],
    )


def texts_of(df: DataFrame, code: str) -> tuple[DataFrame, DataFrame]:
    """The rows with the hash of their code, and one copy per hash with its number of rows.

    The map side keeps a single copy of a popular text per task. The distinct texts are staged,
    because several reads follow."""
    keyed = df.withColumn("_code_hash", F.when(is_present(code), sha256_bin(code)))
    texts = keyed.where(F.col("_code_hash").isNotNull()).groupBy("_code_hash")
    return keyed, stage(texts.agg(F.any_value(code).alias("_text"), F.count(F.lit(1)).alias("_n")), "texts")


def join_parsed(keyed: DataFrame, texts: DataFrame, results: DataFrame) -> DataFrame:
    """The rows with the ``_functions`` of their text from ``results`` (_code_hash, _functions).

    A text with more rows than a join partition should hold is salted on both sides, in proportion to
    its rows; there are fewer such texts than partitions, which bounds the broadcast list of their
    hashes whatever the corpus. Rows without code join nothing and go past the join."""
    wanted = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")) * SALTED_SHARE
    per_salt = F.greatest(F.ceil(F.lit(texts.agg(F.sum("_n")).first()[0] or 0) / wanted), F.lit(1))
    salts = F.ceil(F.col("_n") / per_salt).cast("int")
    hot = F.broadcast(texts.where(salts > 1).select("_code_hash", salts.alias("_salts")))
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)).alias("_salt")
    parsed = results.join(hot, "_code_hash", "left").select("_code_hash", "_functions", copies)
    with_code = keyed.where(F.col("_code_hash").isNotNull()).join(hot, "_code_hash", "left")
    place = F.pmod(F.xxhash64(*key_columns(keyed)), F.coalesce("_salts", F.lit(1))).cast("int")
    joined = with_code.withColumn("_salt", place).drop("_salts").join(parsed, ["_code_hash", "_salt"])
    blank = keyed.where(F.col("_code_hash").isNull()).select("*", F.lit(0).alias("_salt"), F.array(_empty_entry()).alias("_functions"))
    return joined.select(*[F.col(f"`{c}`") for c in blank.columns]).unionByName(blank)


# A text is salted from one part in so many of an even join partition.
SALTED_SHARE = 4


def _empty_entry() -> Column:
    """The entry of a text without content, as the parser gives it."""
    known = {"parameters": F.array(), "local_names": F.array(), "is_async": F.lit(False), "outcome": F.lit(pysource.EMPTY)}
    fields = [(n, known.get(n, F.lit(None)).cast(ddl)) for n, ddl, _ in pysource.FUNCTION_FIELDS]
    return F.struct(*[c.alias(n) for n, c in fields])


def function_inventory(extracted: DataFrame) -> DataFrame:
    """The facts per function without the user's columns."""
    return extracted.where("parse_ok").select(
        *key_columns(extracted),
        "function_name",
        "parameters",
        "return_annotation",
        "docstring_in_code",
        "body_without_docstring",
        "is_async",
    )


def function_signature(extracted: DataFrame) -> DataFrame:
    return extracted.where(F.col("signature").isNotNull()).select(*key_columns(extracted), "signature")


def parse_counts(extracted: DataFrame) -> DataFrame:
    """Rows that parsed and rows that did not, after expansion."""
    ok = F.coalesce("parse_ok", F.lit(False))
    return extracted.agg(
        F.count_if(ok).alias("ast_parse_success_count"), F.count_if(~ok).alias("parse_failed_rows")
    )
