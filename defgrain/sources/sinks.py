"""Writers for results and the list of what a run produced."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import DROP_REASON, INTERNAL, is_engine
from ..operators.tags import survivors

CLEANED = "cleaned"
PAIRS = "instruction_pairs"


def public_columns(df: DataFrame) -> DataFrame:
    """Without the library's own bookkeeping columns; every column of the user stays."""
    return df.drop(*INTERNAL)


@dataclass(frozen=True)
class Output:
    """A written result and the number of rows that went into it."""

    role: str
    path: str
    row_count: int

    @property
    def name(self) -> str:
        return self.path.rstrip("/").rsplit("/", 1)[-1]


def _write_json(df: DataFrame, role: str, path: str, mode: str) -> Output:
    """Write and count in the same pass, so that a manifest never reads the output again."""
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode(mode).option("ignoreNullFields", False).json(path)
    return Output(role, path, seen.get["rows"])


def write_cleaned(df: DataFrame, path: str, mode: str = "error") -> Output:
    """Surviving rows as JSONL; tagged input is reduced to its survivors first."""
    kept = survivors(df) if is_engine(df, DROP_REASON) else df
    return _write_json(public_columns(kept), CLEANED, path, mode)


def write_pairs(pairs: DataFrame | None, path: str, mode: str = "error", count: int | None = None) -> Output | None:
    """Pairs as JSONL; nothing is written, and None returned, if there are none: no frame, or a
    ``count`` of 0, such as ``instruction_pair_count`` of the metrics. Without a count an empty
    result is written and listed with no rows, since finding out first would compute it twice."""
    if pairs is None or count == 0:
        return None
    columns = ["pair_type", "instruction", "input", "output", "source_function_name"]
    return _write_json(pairs.select(*columns), PAIRS, path, mode)


def output_manifest(spark: SparkSession, outputs: Iterable[Output | None]) -> DataFrame:
    """One row per written output: role, name, path and rows. Steps without output give None
    and are left out."""
    rows = [(o.role, o.name, o.path, o.row_count) for o in outputs if o is not None]
    return spark.createDataFrame(rows, "file_role string, file_name string, file_path string, row_count long")
