"""CSV whose quoted cells span lines, read by many tasks however large its files are.

A quote toggles whether a line end belongs to a cell, so whether a byte range begins inside a cell
depends on the number of quotes before it in the file:

1. each range counts its quotes; the running sum over the ranges of a file tells how each begins;
2. each range owns the records that begin in it and puts their lines together as it reads them;
3. the last record of a range may end in a later one. The pieces of such records, two a range at most,
   are brought together by the range that owns them.

Only the counts (a row a range) and the pieces are shuffled.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ROW_ID
from .staging import stage

_RECORD, _TAIL, _HEAD = 0, 1, 2


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines in the order of their range, without their line feed."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value")
    )


def _quotes(value: Column) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))


def ranges(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(range, inside, crlf, odd) per byte range with lines: ``range`` is a hash of file and start,
    ``inside`` whether it begins inside a cell, ``crlf`` whether the file's first line ends in CRLF,
    ``odd`` whether the file has an odd number of quotes."""
    place = F.monotonically_increasing_id()
    counts = _lines(spark, path).withColumn("place", place).groupBy("file", "block").agg(
        F.sum(_quotes(F.col("value"))).alias("n"), F.min(F.struct("place", F.col("value").endswith("\r").alias("crlf"))).alias("first")
    )
    counts = stage(counts, "ranges")
    file = Window.partitionBy("file")
    before = F.sum("n").over(file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return counts.select(
        F.xxhash64("file", "block").alias("range"),
        (F.coalesce(before, F.lit(0)) % 2 == 1).alias("inside"),
        F.coalesce(F.max(F.when(F.col("block") == 0, F.col("first.crlf"))).over(file), F.lit(False)).alias("crlf"),
        (F.sum("n").over(file) % 2 == 1).alias("odd"),
    )


def _assemble(batches):
    """Lines of ranges to records and pieces of records, numbered within the range."""
    names = ["file", "block", "row", "kind", "crlf", "text"]
    at, inside, held, row, kind = None, False, [], 0, _RECORD
    out = [[] for _ in names]

    def put(kind):
        nonlocal row
        for column, v in zip(out, (*at, row, kind, crlf, "\n".join(held))):
            column.append(v)
        row += 1
        held.clear()

    def flush():
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
        batch = pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
        for column in out:
            column.clear()
        return batch

    crlf = False
    for batch in batches:
        for file, block, value, begins_inside, is_crlf in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, block) != at:
                if held:
                    put(_TAIL if kind == _RECORD else _HEAD)
                at, inside, row, crlf = (file, block), begins_inside, 0, is_crlf
                kind = _HEAD if inside else _RECORD
            held.append(value)
            inside ^= value.count('"') % 2 == 1
            if not inside:
                put(kind)
                kind = _RECORD
        if out[0]:
            yield flush()
    if held:
        put(_TAIL if kind == _RECORD else _HEAD)
        yield flush()


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, row, text): the records of CSV files as text, by the range in which each begins."""
    known = ranges(spark, path)
    if not known.where("odd").isEmpty():
        raise ValueError("a file has an odd number of quotes; read it with whole_files=True")
    # A row of 18 bytes for each byte range: some MB at 100 TB. It must not be shuffled, as lines of a
    # range have to stay in order.
    lines = _lines(spark, path)
    met = lines.join(F.broadcast(known), F.xxhash64(lines["file"], lines["block"]) == known["range"], "left")
    missing = F.raise_error(F.lit("byte ranges changed between two reads of the files")).cast("boolean")
    met = met.select("file", "block", "value", F.coalesce("inside", missing).alias("inside"), "crlf")
    found = met.mapInArrow(_assemble, "file string, block long, row long, kind int, crlf boolean, text string")
    # A piece that opens a record owns those after it, up to the next that opens one. Ranges that
    # begin and end inside one cell give one piece.
    pieces = found.where(F.col("kind") != _RECORD)
    order = Window.partitionBy("file").orderBy("block", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.max(F.when(F.col("kind") == _TAIL, F.struct("block", "row"))).over(order)
    owned = pieces.withColumn("owner", opened).groupBy("file", "owner", "crlf")
    whole = owned.agg(F.sort_array(F.collect_list(F.struct("block", "row", "text"))).alias("parts"))
    whole = whole.select("file", "owner.block", "owner.row", "crlf", F.array_join("parts.text", "\n").alias("text"))
    rows = found.where(F.col("kind") == _RECORD).select("file", "block", "row", "crlf", "text").unionByName(whole)
    text = F.when(F.col("crlf"), F.replace(F.regexp_replace("text", r"\r$", ""), F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("text"))
    return rows.select("file", "block", "row", text.alias("text"))


def read(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Rows under ``_row_id`` (file, block, row within the block); the first record of a file is its
    header, and empty lines between records are skipped."""
    rows = records(spark, path).where(~((F.col("block") == 0) & (F.col("row") == 0)) & (F.col("text") != ""))
    cells = F.from_csv("text", schema.toDDL(), {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    return rows.select(F.struct("file", "block", "row").alias(ROW_ID), cells.alias("_cells")).select(ROW_ID, "_cells.*")
