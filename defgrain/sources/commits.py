"""Tables that grow by commits, each a folder that a retry overwrites.

``write_commit`` may be repeated with the same name, so a driver that dies and starts again adds
nothing twice. ``compact`` merges many small commits into few sorted files. What it replaced is
recorded after the merged folder is whole and before the old ones go: readers go by that record, so
a compaction that stops anywhere, or a commit repeated after it was merged, shows no row twice."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

_MERGED = "merged-"
_FOLDER = "_commit="  # how folders of commits begin


def folder(root: str, commit: str) -> str:
    """Where the rows of one commit lie."""
    return f"{root}/{_FOLDER}{commit}"


def _fs(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _names(spark: SparkSession, root: str) -> list[str]:
    """Commits that were written to their end."""
    fs, folder = _fs(spark, root)
    if not fs.exists(folder):
        return []
    entries = [e.getPath().getName() for e in fs.listStatus(folder)]
    whole = [n for n in entries if n.startswith(_FOLDER) and fs.exists(_fs(spark, f"{root}/{n}/_SUCCESS")[1])]
    return sorted(n[len(_FOLDER) :] for n in whole)


def live_commits(spark: SparkSession, root: str) -> list[str]:
    """The folders that make up the table: neither replaced nor of an unfinished compaction."""
    merges = _names(spark, f"{root}-merges")
    replaced = {r["value"] for r in spark.read.text([f"{root}-merges/{_FOLDER}{m}" for m in merges]).collect()} if merges else set()
    return [n for n in _names(spark, root) if n not in replaced and (not n.startswith(_MERGED) or n[len(_MERGED) :] in merges)]


def write_commit(df: DataFrame, root: str, commit: str, partition_by: str | None = None) -> None:
    """Write ``df`` as one commit; a commit of that name is overwritten. With ``partition_by`` the
    rows of a value meet in one task, so that a value is one file."""
    if not re.fullmatch(r"\w[\w.-]*", commit) or commit.startswith(_MERGED):
        raise ValueError(f"not a name of a commit: {commit!r}")
    rows = df.repartition(partition_by) if partition_by else df
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{root}/{_FOLDER}{commit}")


def read_commits(spark: SparkSession, root: str, partition_by: str | None = None) -> DataFrame:
    """All rows of the table. Filters on ``partition_by`` prune the folders of plain commits and reach
    the statistics of merged files. Its values are strings."""
    names = live_commits(spark, root)
    if not names:
        raise FileNotFoundError(f"no commit in {root}")
    parts = []
    for merged in (False, True):
        paths = [f"{root}/{_FOLDER}{n}" for n in names if n.startswith(_MERGED) == merged]
        if paths:
            df = spark.read.option("mergeSchema", True).option("basePath", root).parquet(*paths).drop("_commit")
            if partition_by:  # folder names that look like numbers stay what they are
                fields = [StructField(f.name, StringType() if f.name == partition_by else f.dataType) for f in df.schema]
                df = spark.read.schema(StructType(fields)).option("basePath", root).parquet(*paths).drop("_commit")
            parts.append(df)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def compact(spark: SparkSession, root: str, sort_by: str | None = None) -> int:
    """Merge all live commits into one folder of as few files as their size allows, ordered by
    ``sort_by``; returns how many were merged. Readers that began before may miss the old files."""
    names = live_commits(spark, root)
    if len(names) < 2:
        return 0
    merge = uuid.uuid4().hex
    rows = read_commits(spark, root, sort_by)
    rows = rows.sort(sort_by) if sort_by else rows.hint("rebalance")
    rows.write.parquet(f"{root}/{_FOLDER}{_MERGED}{merge}")
    spark.createDataFrame([(n,) for n in names], "value string").coalesce(1).write.text(f"{root}-merges/{_FOLDER}{merge}")
    for name in names:
        fs, folder = _fs(spark, f"{root}/{_FOLDER}{name}")
        fs.delete(folder, True)
    return len(names)
