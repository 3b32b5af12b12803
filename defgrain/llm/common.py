"""What the operators share: word rules, batch helpers, written intermediate tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import new_folder, stage  # noqa: F401  (re-exported)

# Words are runs of ASCII letters, digits and everything beyond ASCII, with A-Z lowered. In UTF-8
# all bytes beyond ASCII are 0x80 or more, so the rule holds byte by byte.
_WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lowering A-Z."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_TABLE).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lowering A-Z."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


_SLICE = 1000  # rows whose Python objects a worker holds at once


def slices(batches: Iterator[pa.RecordBatch], rows: int = _SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``function`` to each Arrow batch, a slice at a time; None drops the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = function(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def long_key(*parts: str | Column) -> Column:
    """A 64-bit row key that is also defined for nulls."""
    return F.xxhash64(*parts)


def signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def list_array(lengths, values: pa.Array) -> pa.Array:
    """A list column from the lengths of its lists and their joined values."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
