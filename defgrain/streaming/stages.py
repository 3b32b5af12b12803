"""Streaming forms of the operators that make sense on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import ColumnRoles, PrepOptions
from ..functions.text import sha256_bin
from ..operators.report import latest_progress
from ..plans.prepare import tag_rows


def stream_tags(stream: DataFrame, roles: ColumnRoles, opts: PrepOptions = PrepOptions()) -> DataFrame:
    """Normalise, extract and tag: stateless, so batch and stream share one plan."""
    return tag_rows(stream, roles, opts)


def stream_dedup(stream: DataFrame, roles: ColumnRoles, event_time: str, delay: str) -> DataFrame:
    """First arrival per text within the watermark; state holds hashes, not texts, and is
    dropped once the watermark passes."""
    hashed = stream.withWatermark(event_time, delay).withColumn("_text", sha256_bin(roles.code))
    return hashed.dropDuplicatesWithinWatermark(["_text"]).drop("_text")


def stream_latest_progress(stream: DataFrame, key: str, order: list[str], payload: list[str]) -> DataFrame:
    """Last event per key; run in ``update`` mode."""
    return latest_progress(stream, key, order, payload)


def run_available(stream: DataFrame, sink, mode: str, checkpoint: str) -> None:
    """Process what is available through ``sink(batch, batch_id)`` and stop."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(sink)
        .start()
    )
    query.awaitTermination()


def batch_writer(path: str):
    """A sink for ``run_available`` that may be called again with the same batch: each batch
    overwrites a folder of its own, so a restart never writes rows twice. Read ``path`` as one
    Parquet table; the column ``batch_id`` comes from the folders."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write
