"""Materialised steps: written tables in the cluster's shared checkpoint folder.

A written table survives lost executors, cuts lineage, and later reads prune its columns,
which a cached or checkpointed RDD would not."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_local_root: str | None = None


def staging_root(spark: SparkSession) -> str:
    """The folder named by the session. A local session without the setting, as in tests, gets a
    temporary folder of its own; on a cluster that would be invisible to other machines, so the
    setting is required there."""
    global _local_root
    configured = spark.conf.get(_SETTING, None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="defgrain-")
    return _local_root


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{staging_root(spark)}/defgrain/{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the folder that a staged ``df`` is a scan of; frames of other folders are left alone."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/defgrain/" in path:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
