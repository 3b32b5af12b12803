"""Streaming operators with state that expires.

Both keep a narrow entry of state per key and drop it by an event-time timer, so state is bounded by
the keys that are active, not by all that were ever seen. Both give in update mode what the batch
operator gives on the same rows, whatever order rows arrive in within the watermark. Output may
repeat after a restart; readers take the last row of a key (``last_updates``)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import is_present, sha256_bin

_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_LEAST = -(2**63)
_TEXT = "<32sqq"  # hash, first key, last seen in milliseconds
PLACES = 1 << 12  # rows of state that share the texts; a call into Python costs as much as some thousand texts in it


def _arm(state: GroupState, last_ms: int, idle_ms: int) -> None:
    """A timer cannot be set before the watermark."""
    state.setTimeoutTimestamp(max(last_ms + idle_ms, state.getCurrentWatermarkMs() + 1))


def _millis(df: DataFrame, span: str) -> int:
    """Milliseconds of a span such as '2 hours'."""
    return df.sparkSession.range(1).select(F.expr(f"unix_millis(timestamp_millis(0) + INTERVAL {span})")).first()[0]


def stream_live_progress(
    stream: DataFrame, key: str, event_time: str, sequence: str, payload: list[str], delay: str, idle: str
) -> DataFrame:
    """(key, event_time, sequence, payload) whenever a key gets a newer last event; run in ``update`` mode.

    The last event is the one with the greatest (event_time, sequence, payload as JSON); null sequences come
    first. An event that comes late never overwrites a newer one, and one that is older than the watermark of
    the batch before is dropped. A key without events for ``idle`` loses its state: every event
    it may get after that is later than what was forgotten. Null keys are one key; events without time
    are left out. Rows travel as JSON, so that whole numbers with nulls stay exact in the workers."""
    shown = [key, event_time, sequence, *payload]
    schema = stream.select(*shown).schema
    idle_ms = _millis(stream, idle)
    timed = stream.where(F.col(event_time).isNotNull()).withWatermark(event_time, delay)
    rows = timed.select(
        F.xxhash64(F.col(key)).alias("_place"),
        F.col(key).cast("string").alias("_key"),
        F.col(event_time),
        F.unix_micros(F.col(event_time).cast("timestamp")).alias("_at"),
        F.coalesce(F.col(sequence).cast("long"), F.lit(_LEAST)).alias("_seq"),
        F.to_json(F.struct(*shown), _JSON).alias("_row"),
    )

    def last(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = best = state.get if state.exists else None
        for frame in frames:
            for found in zip(frame["_at"].tolist(), frame["_seq"].tolist(), frame["_row"]):
                if best is None or found > tuple(best):
                    best = found
        _arm(state, best[0] // 1000, idle_ms)
        if best is not old:
            state.update(best)
            yield pd.DataFrame({"_row": [best[2]]})

    held = rows.groupBy("_place", "_key").applyInPandasWithState(
        last, "_row string", "at long, seq long, row string", "update", GroupStateTimeout.EventTimeTimeout
    )
    return held.select(F.from_json("_row", schema, _JSON).alias("_row")).select("_row.*")


def stream_first_copies(stream: DataFrame, code: str, key: str, event_time: str, delay: str, places: int = PLACES) -> DataFrame:
    """(text_hash, first_key, instead_of): the least key of each text, whenever a text is new or an
    earlier row of it comes late; then ``instead_of`` is the key that was first until now. Run in ``update``
    mode. ``last_updates(..., "first_key")`` of the output are the rows that batch deduplication keeps.

    ``key`` is a whole number without nulls. State is 48 bytes a text, a hash, a key and a time, dropped once
    a text was not seen for ``delay``. Texts are dealt by their hash to ``places`` rows of state, so that a call
    into Python serves all texts of a place; a batch rewrites the places it meets, so some thousand active texts
    a place suit. A running stream must keep its number. Rows without code or time are left out. A batch's
    rows of a text are reduced to one a task before they meet, so a popular text is no hot key."""
    rows = stream.where(is_present(code) & F.col(event_time).isNotNull()).select(
        sha256_bin(code).alias("text_hash"), F.col(key).cast("long").alias("_key"), F.col(event_time).cast("timestamp").alias("_at")
    )
    delay_ms = _millis(stream, delay)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = pa.Table.from_batches([batch]).group_by("text_hash").aggregate([("_key", "min"), ("_at", "max")])
            yield from met.rename_columns(["text_hash", "_key", "_at"]).combine_chunks().to_batches()

    def first(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {text: (least, seen) for text, least, seen in struct.iter_unpack(_TEXT, state.get[0])} if state.exists else {}
        met, news = set(), {}
        for frame in () if state.hasTimedOut else frames:
            for text, least, seen in zip(frame["text_hash"], frame["_key"].tolist(), frame["_ms"].tolist()):
                met.add(text)
                old = held.get(text)
                if old is None or least < old[0]:
                    news.setdefault(text, old and old[0])
                held[text] = (least, seen) if old is None else (min(least, old[0]), max(seen, old[1]))
        mark = state.getCurrentWatermarkMs()
        held = {text: known for text, known in held.items() if text in met or known[1] + delay_ms >= mark}
        if not held:
            state.remove()
            return
        state.update((b"".join(struct.pack(_TEXT, text, *known) for text, known in held.items()),))
        _arm(state, min(seen for _, seen in held.values()), delay_ms)
        if news:
            yield pd.DataFrame(
                {
                    "text_hash": [text.hex() for text in news],
                    "first_key": [held[text][0] for text in news],
                    "instead_of": pd.array(list(news.values()), dtype="Int64"),
                }
            )

    narrow = rows.mapInArrow(reduce, "text_hash binary, _key long, _at timestamp").withWatermark("_at", delay)
    dealt = narrow.select(F.pmod(F.xxhash64("text_hash"), F.lit(places)).alias("_place"), "text_hash", "_key", F.unix_millis("_at").alias("_ms"), "_at")
    return dealt.groupBy("_place").applyInPandasWithState(
        first,
        "text_hash string, first_key long, instead_of long",
        "texts binary",
        "update",
        GroupStateTimeout.EventTimeTimeout,
    )


def last_updates(updates: DataFrame, least: str, key: str = "text_hash") -> DataFrame:
    """One row per key from written updates: the least value of ``least`` that was ever reported."""
    return updates.groupBy(key).agg(F.min(least).alias(least))
