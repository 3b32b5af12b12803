"""Extraction with a store of parse results, so that a text is parsed once in its life.

The store has a row (hash, functions) for each text that was ever parsed, found by the SHA-256 of the
text whatever table it came from. A load reduces its texts to one per hash, looks the hashes up, parses
only what the store lacks, adds that as one commit and joins the results back. The store is a table of
commits (``sources.commits``): a repeated load overwrites its own commit, and ``compact`` merges many
into few files. Results of another Python version are another store, since grammar and printing
change with it."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FN_ORD, ColumnRoles, set_aside
from ..functions import pysource
from ..sources import commits
from .extract import DERIVED, expand_functions, join_parsed, parse_functions, texts_of

SCHEMA = f"hash binary, functions array<{pysource.FUNCTION_DDL}>"


def store_path(root: str) -> str:
    return f"{root}/py{sys.version_info.major}.{sys.version_info.minor}"


def read_store(spark: SparkSession, root: str, without: str | None = None) -> DataFrame | None:
    """The results stored so far, but for those of the commit ``without``; None if there are none."""
    path = store_path(root)
    names = [n for n in commits.live_commits(spark, path) if n != without]
    return spark.read.schema(SCHEMA).parquet(*[commits.folder(path, n) for n in names]) if names else None


def extract_stored(df: DataFrame, roles: ColumnRoles, root: str, commit: str) -> DataFrame:
    """What ``extract_functions`` gives, parsing only texts that the store at ``root`` lacks; their
    results are added under the name ``commit``, which a retry of the same load must use again.

    Empty and missing texts are neither parsed nor stored. Copies of a text are one entry, and a text
    of many rows is salted on the way back, as in ``parse_distinct``. Loads at the same time may store a
    text twice, which changes no row. User columns never meet the store; an empty load adds an empty
    commit."""
    roles.check(df)
    spark, path = df.sparkSession, store_path(root)
    df = set_aside(df, [*DERIVED, FN_ORD], roles)
    keyed, texts = texts_of(df, roles.code)
    store = read_store(spark, root, without=commit)
    new = texts if store is None else texts.join(_known(store, texts), "_code_hash", "left_anti")
    commits.write_commit(new.select(F.col("_code_hash").alias("hash"), parse_functions("_text").alias("functions")), path, commit)
    added = spark.read.schema(SCHEMA).parquet(commits.folder(path, commit))
    results = added.select(F.col("hash").alias("_code_hash"), F.col("functions").alias("_functions"))
    if store is not None:
        results = results.unionByName(_known(store, texts, "functions"))
    return expand_functions(join_parsed(keyed, texts, results), df.columns, roles)


def _known(store: DataFrame, texts: DataFrame, *more: str) -> DataFrame:
    """The stored rows of the hashes of ``texts``, once each. The hash column alone is read unless
    ``more`` is asked for; the smaller side is broadcast if Spark finds it small enough."""
    columns = [F.col("hash").alias("_code_hash"), *[F.col(c).alias(f"_{c}") for c in more]]
    return store.select(*columns).join(texts.select("_code_hash"), "_code_hash", "left_semi").dropDuplicates(["_code_hash"])


def compact(spark: SparkSession, root: str) -> int:
    """Merge the commits of the store into few files; returns how many were merged."""
    return commits.compact(spark, store_path(root))
