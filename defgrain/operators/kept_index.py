"""Deduplication against what earlier loads kept, by a stored index of hashes.

A load is compared with the index instead of with earlier texts: the index has a row (hash, first key,
load) for each text and each syntax tree that was ever seen, in a folder per load and, inside, per
first byte of the hash. A folder is overwritten when its load is repeated, so a retried driver adds
nothing twice, and a repeated load does not see its own rows. ``compact`` merges old folders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ColumnRoles, as_list, key_columns
from ..functions.text import is_present
from .dedup import AST, DEDUP_STAGE, EXACT, TEXT_HASH, TREE_HASH, _live, first_key, text_hash, tree_hash
from .tags import add_tag

TEXTS, TREES = "texts", "trees"
_PREFIX = "prefix"


def _read(spark: SparkSession, root: str, kind: str, load: str) -> DataFrame | None:
    """The index without the rows of ``load`` itself; None before the first load."""
    try:
        return spark.read.parquet(f"{root}/{kind}").where(F.col("load") != load)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _prefix(digest: Column) -> Column:
    return F.conv(F.hex(F.substring(digest, 1, 1)), 16, 10).cast("int")


def _write(firsts: DataFrame, root: str, kind: str, load: str) -> None:
    """One file a prefix: rows meet by prefix before they are written."""
    rows = firsts.withColumn(_PREFIX, _prefix(F.col("hash")))
    rows.repartition(_PREFIX).write.mode("overwrite").partitionBy(_PREFIX).parquet(f"{root}/{kind}/load={load}")


def _known(firsts: DataFrame, index: DataFrame | None, group: list[str]) -> DataFrame:
    """Of the first rows of a load those whose hash the index has. The index is read by hash and prefix
    alone; the side that Spark finds small, as a rule the load, is broadcast, and the index stays where
    it lies."""
    if index is None:
        return firsts.where("false")
    rows = firsts.withColumn(_PREFIX, _prefix(F.col("hash")))
    seen = index.select(*group, "hash", _PREFIX).join(rows.select(*group, "hash", _PREFIX), [*group, "hash", _PREFIX], "left_semi")
    return firsts.join(seen.select(*group, "hash").distinct(), [*group, "hash"], "left_semi")


def tag_load(
    df: DataFrame,
    roles: ColumnRoles,
    root: str,
    load: str,
    save: Callable[[DataFrame, str], DataFrame],
    ast: bool = True,
    by: list[str] | str = (),
) -> DataFrame:
    """Tag the rows of a load that are later copies: of a text in the load or in the index, else, where
    trees are known, of a tree. Loads in the order of their keys so give what one load of all gives.
    The load's new hashes are then added to the index under its name.

    Rows without code stay; rows that did not parse skip the tree rule; rows tagged before neither
    count nor enter the index. ``save`` writes a narrow table and returns a scan of it (``stage``). A
    text that occurs in the load under equal hashes is decided once, however many rows have it."""
    roles.check(df)
    by, keys = as_list(by), key_columns(df)
    spark, ast = df.sparkSession, ast and "parse_ok" in df.columns
    trees = [tree_hash(df)] if ast else []
    rows = _live(df).where(is_present(roles.code)).select(*by, *keys, text_hash(df, roles.code), *trees)
    rows = save(rows.withColumnRenamed(TEXT_HASH, "hash"), "load_hashes")
    firsts = save(first_key(rows, [*by, "hash", *([TREE_HASH] if ast else [])], keys), "load_firsts")
    old = save(_known(firsts.drop(TREE_HASH), _read(spark, root, TEXTS, load), by), "known")
    new = firsts.join(old.select(*by, "hash"), [*by, "hash"], "left_anti") if by else firsts.join(old.select("hash"), "hash", "left_anti")
    kept = save(new, "kept")
    copies = rows.select(*keys).join(kept.select(*keys), keys, "left_anti").withColumn("_copy", F.lit(EXACT))
    if ast:
        known = kept.where(F.col(TREE_HASH).isNotNull()).select(*by, F.col(TREE_HASH).alias("hash"), *keys)
        tops = save(first_key(known, [*by, "hash"], keys), "tree_firsts")
        old = save(_known(tops, _read(spark, root, TREES, load), by), "known")
        first = save(tops.join(old.select(*keys), keys, "left_anti"), "tree_kept")
        copies = copies.unionByName(
            known.select(*keys).join(first.select(*keys), keys, "left_anti").withColumn("_copy", F.lit(AST))
        )
        _write(first, root, TREES, load)
    _write(kept.drop(TREE_HASH), root, TEXTS, load)
    return add_tag(df.join(save(copies, "later_copies"), keys, "left"), DEDUP_STAGE, F.col("_copy")).drop("_copy")


def compact(spark: SparkSession, root: str, loads: list[str], into: str) -> None:
    """Merge the folders of ``loads`` into one of the name ``into``, which must be new. Until the old
    folders are removed, at the end, a hash may be there twice, which changes no answer."""
    for kind in (TEXTS, TREES):
        index = _read(spark, root, kind, into)
        if index is None:
            continue
        _write(index.where(F.col("load").isin(loads)).drop("load", _PREFIX), root, kind, into)
    path = spark._jvm.org.apache.hadoop.fs.Path
    for kind in (TEXTS, TREES):
        for load in loads:
            folder = path(f"{root}/{kind}/load={load}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
