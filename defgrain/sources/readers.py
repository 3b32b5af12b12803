"""Readers. Each attaches ``_row_id``, because first-wins rules need an order Spark tables
do not have: a key column if the caller names one, else the position in the files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CORRUPT, ROW_ID
from . import split_csv


def with_row_id(df: DataFrame, key: str | Column | None = None) -> DataFrame:
    """Attach ``_row_id``. A unique key column of a primitive type is the cheapest id; without
    one it is (file, row index) for Parquet, straight from the scan."""
    if key is None:
        try:
            df.select("_metadata.file_path", "_metadata.row_index")
        except AnalysisException as error:
            raise ValueError("rows have no position unless they come straight from Parquet; use with_row_id(df, key=...)") from error
        position = F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
        )
        return df.select(position.alias(ROW_ID), *df.columns)
    key = F.col(key) if isinstance(key, str) else key
    return df.select(key.alias(ROW_ID), *df.columns)


def _with_text_position(df: DataFrame) -> DataFrame:
    """Text formats have no row index: (file, block, running id within the scan task)."""
    position = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return df.select(position.alias(ROW_ID), *df.columns)


def read_parquet(spark: SparkSession, path: str | list[str], key: str | None = None) -> DataFrame:
    paths = [path] if isinstance(path, str) else path
    return with_row_id(spark.read.parquet(*paths), key)


def read_jsonl(
    spark: SparkSession,
    path: str | list[str],
    key: str | None = None,
    schema: T.StructType | str | None = None,
    strict: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """One JSON object per line; blank lines are skipped. ``strict`` fails on the first bad
    line, otherwise bad lines land in ``_corrupt_record``. Pass ``schema`` on large inputs:
    inferring it reads everything once more. ``multi_line`` accepts whole ``.json`` files."""
    reader = spark.read.option("mode", "FAILFAST" if strict else "PERMISSIVE").option("multiLine", multi_line)
    if schema is not None:
        declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if not strict and CORRUPT not in declared.names:
            declared = T.StructType([*declared.fields, T.StructField(CORRUPT, T.StringType())])
        reader = reader.schema(declared).option("columnNameOfCorruptRecord", CORRUPT)
    df = reader.json(path)
    return with_row_id(df, key) if key else _with_text_position(df)


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    key: str | None = None,
    columns: list[str] | None = None,
    multi_line: bool = True,
    whole_files: bool = False,
) -> DataFrame:
    """CSV with a header, every column a string. Quoted cells may span lines; files are split all the
    same, by ``split_csv``, at the price of a first pass that counts quotes. That takes quotes to stand
    at both ends of a cell and doubled inside it; files with stray quotes need ``whole_files=True``,
    by which each file is one task, however large. ``multi_line=False`` spares the first pass where
    cells never span lines. Empty unquoted cells and the missing cells of short rows are NULL, which
    every rule treats like the empty string. In a file with CRLF records, line ends inside cells
    become LF."""
    reader = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("inferSchema", False)
    )
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    df = reader.csv(path)
    if multi_line and not whole_files:
        rows = split_csv.read(spark, path, df.schema)
        return with_row_id(rows.drop(ROW_ID), key) if key else rows
    return with_row_id(df, key) if key else _with_text_position(df)


def spread(df: DataFrame, key: str = ROW_ID) -> DataFrame:
    """Give an input that arrives in fewer splits than there are cores one partition per core,
    so that parsing is not bound to a few tasks. Inputs with enough splits pass through without
    a shuffle. For plain scans: counting partitions plans the scan but runs nothing."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted, key)


def read_head(spark: SparkSession, path: str, n: int, key: str | None = None) -> DataFrame:
    """First ``n`` rows of a Parquet data set in file order, or in the order of ``key``. In file order
    the row counts in the footers of the first files tell which hold them; at most ``n`` files with
    rows are opened, and of these row indexes from ``n`` on are filtered in the scan."""
    if key is not None:
        return first_rows(read_parquet(spark, path, key), n, ROW_ID)
    files = sorted(spark.read.parquet(path).inputFiles(), key=str.encode)
    seen, rows, step, holding = 0, 0, 8, []
    while seen < len(files) and rows < n:
        counts = spark.read.parquet(*files[seen : seen + step]).groupBy("_metadata.file_path").count()
        for name, count in sorted(map(tuple, counts.collect()), key=lambda r: r[0].encode()):
            if rows < n:
                holding.append(name)
                rows += count
        seen, step = seen + step, 2 * step
    if not holding:
        return read_parquet(spark, path).limit(0)
    return read_parquet(spark, holding).where(F.col("_metadata.row_index") < n).orderBy(ROW_ID).limit(n)


def first_rows(df: DataFrame, n: int, key: str) -> DataFrame:
    """The first ``n`` rows in the order of ``key``. The narrow key is searched for its n-th least value
    first; rows up to it are then filtered by a literal, which reaches the scan, so that row groups
    whose statistics lie beyond it are not read. Keys that are structs are compared by a broadcast of
    the ``n`` least."""
    least = df.select(F.col(key).alias("_key")).orderBy("_key").limit(n)
    if isinstance(df.schema[key].dataType, (T.StructType, T.ArrayType, T.MapType)):
        return df.join(F.broadcast(least.distinct()), F.col(key) == F.col("_key"), "left_semi").orderBy(key).limit(n)
    found = least.agg(F.max("_key").alias("last"), F.count("_key").alias("known"), F.count(F.lit(1)).alias("n")).first()
    upto = F.lit(False) if found["last"] is None else F.col(key) <= F.lit(found["last"])
    if found["known"] < found["n"]:  # null keys come first
        upto = upto | F.col(key).isNull()
    return df.where(upto).orderBy(key).limit(n)
