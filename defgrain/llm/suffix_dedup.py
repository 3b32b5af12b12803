"""Substring dedup: removes every byte of a string of ``LENGTH`` bytes that also starts elsewhere.

Blockwise suffix sorting with a difference cover. Positions whose offset modulo ``PERIOD`` lies in
``COVER`` are the cover sample: of any two suffixes, some shift below ``PERIOD`` leads both to sample
positions. Only equality of 200-byte beginnings matters, so suffixes are ordered by 64-bit names of
their leading bytes instead of by the bytes; equal beginnings are neighbours in either order.

1. Sample suffixes are dealt into buckets by name and sorted a bucket at a time. Their rank says
   whether another sample suffix has the same first ``LENGTH - PERIOD + 1`` bytes. If two suffixes tie
   over ``LENGTH`` bytes, the samples at their common shift tie over these.
2. Sample suffixes with a shared rank are ranked again. One that ties over ``LENGTH + PERIOD`` bytes
   resolves the long ties of the next ``PERIOD`` suffixes: they go, and only the first occurrence
   sends them on, for others that tie with them less far. A sample whose surroundings of twice
   ``REACH`` bytes are unique leaves no suffix around it to look at.
3. The suffixes still open are dealt into buckets and sorted a bucket at a time.

Texts are kept in blocks of up to ``BLOCK`` bytes; a block sends each name once, so a string in a third
of all rows comes once a block, and gets a bit per name back. The number of buckets follows the count
of names, so that a task sorts ``BUCKET`` names at most, however large the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import list_array, stage

LENGTH = 200
#: A perfect difference set: every residue of 133 is the difference of two members (tests check it).
PERIOD = 133
COVER = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
SHORT = LENGTH - PERIOD + 1
#: A 200-byte string around a sample s at shift d holds [s - 66, s + 68) if d >= 66, else [s, s + 134).
REACH = 66
BLOCK = 4 << 20
BUCKET = 2_000_000
MIN_BUCKETS = 64
_IN_COVER = np.zeros(PERIOD, bool)
_IN_COVER[list(COVER)] = True
_AT_ONCE = 1 << 18
_TIMES = np.uint64(0x9E3779B97F4A7C15)


def names(data: bytes, at: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """A 64-bit name of the ``length`` bytes from each position ``at``."""
    out = np.empty(len(at), np.uint64)
    if not len(at):
        return out
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    places = [*range(0, length - 8, 8), length - 8]
    for a in range(0, len(at), _AT_ONCE):
        part = at[a : a + _AT_ONCE]
        h = np.full(len(part), (length << 8) + salt, np.uint64)
        for place in places:
            h ^= words[part + place]
            h *= _TIMES
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        out[a : a + _AT_ONCE] = h
    return out


def _marked(n: int, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the ranges [low, high)."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, lows, 1)
    np.add.at(steps, highs, -1)
    return np.cumsum(steps[:n]) > 0


class Block:
    """Texts of a block end to end, and what each round asks about them. A round's names are a pure
    function of the texts and of the earlier rounds' answers, so nothing else is kept."""

    def __init__(self, data: bytes, sizes: np.ndarray):
        self.data, self.n = data, len(data)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes

    def _bounds(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        doc = np.searchsorted(self.ends, at, side="right")
        return self.starts[doc], self.ends[doc]

    def samples(self) -> np.ndarray:
        out = []
        for a, b in zip(self.starts.tolist(), self.ends.tolist()):
            if b - a >= LENGTH:
                out.append(a + np.flatnonzero(_IN_COVER[np.arange(b - a - SHORT + 1) % PERIOD]))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def first(self) -> np.ndarray:
        self.at = self.samples()
        return names(self.data, self.at, SHORT)

    def second(self, shared: np.ndarray, later: np.ndarray) -> np.ndarray:
        self.at = self.at[shared]
        low, high = self._bounds(self.at)
        self.long = self.at[self.at + LENGTH + PERIOD <= high]
        self.right = self.at[self.at + 2 * REACH + 2 <= high]
        self.left = self.at[self.at - REACH >= low]
        return np.concatenate(
            [
                names(self.data, self.long, LENGTH + PERIOD),
                names(self.data, self.right, 2 * REACH + 2),
                names(self.data, self.left - REACH, 2 * REACH + 2, salt=1),
            ]
        )

    def third(self, shared: np.ndarray, later: np.ndarray) -> np.ndarray:
        a, b = len(self.long), len(self.long) + len(self.right)
        long, right, left = self.long[shared[:a]], self.right[shared[a:b]], self.left[shared[b:]]
        self.settled = _marked(self.n, long, long + PERIOD + 1)
        # An earlier occurrence, or one still earlier of which that is part, sends the same suffixes.
        again = self.long[later[:a]]
        sent = _marked(self.n, again, again + PERIOD + 1)
        low = self._bounds(right)[0]
        near = _marked(self.n, np.maximum(low, right - REACH + 1), right + 1)
        low = self._bounds(left)[0]
        near |= _marked(self.n, np.maximum(low, left - PERIOD + 1), left - REACH + 1)
        self.at = np.flatnonzero(near & ~sent)
        self.at = self.at[self.at + LENGTH <= self._bounds(self.at)[1]]
        return names(self.data, self.at, LENGTH)

    def covered(self, shared: np.ndarray, later: np.ndarray) -> np.ndarray:
        """Which bytes go."""
        starts = self.settled
        starts[self.at[shared]] = True
        at = np.flatnonzero(starts)
        return _marked(self.n, at, at + LENGTH)


ROUNDS = (Block.first, Block.second, Block.third)
#: Bytes of a name that travel; the first round only rules out, so a chance tie in it costs nothing.
WIDTHS = (5, 8, 8)


def _bucket(ordered: np.ndarray, buckets: int) -> np.ndarray:
    return ((ordered >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _lists(own: np.ndarray, buckets: int, width: int) -> tuple[np.ndarray, list[bytes]]:
    """The distinct names of a block as (buckets, their names end to end)."""
    ordered = np.unique(own)
    at = _bucket(ordered, buckets)
    cuts = np.flatnonzero(np.diff(at)) + 1
    raw = ordered.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    edges = [0, *(width * cuts).tolist(), len(raw)]
    return at[np.concatenate([[0], cuts])] if len(at) else at, [raw[a:b] for a, b in zip(edges, edges[1:]) if b > a]


def _answer(own: np.ndarray, buckets: int, hits: list | None) -> tuple[np.ndarray, np.ndarray]:
    """Which names occur again, in this block or, as the buckets have answered, in another; and
    which of these occurrences are not the first."""
    ordered, first, inverse, counts = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
    shared, later = counts > 1, np.zeros(len(ordered), bool)
    if hits:
        at = _bucket(ordered, buckets)
        for hit in hits:
            low, high = np.searchsorted(at, np.array([hit["bucket"], hit["bucket"] + 1], np.uint64)).tolist()
            bits = np.frombuffer(hit["bits"], np.uint8).reshape(2, -1)
            also, after = np.unpackbits(bits, axis=1, count=high - low).astype(bool)
            shared[low:high] |= also
            later[low:high] = after
    return shared[inverse], later[inverse] | (np.arange(len(own)) != first[inverse])


def _sort_bucket(width: int):
    """Sort the names of one bucket and answer each block with two bits for each of its own: whether
    another block has it, and whether an earlier one has."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        lists = [np.frombuffer(x, np.uint8).reshape(-1, width) for x in table["names"].to_pylist()]
        wide = np.zeros((sum(map(len, lists)), 8), np.uint8)
        np.concatenate(lists, out=wide[:, :width])
        values = wide.view("<u8").ravel()
        order = np.argsort(values, kind="stable")
        ties = values[order[1:]] == values[order[:-1]]
        shared, later = np.zeros(len(values), bool), np.zeros(len(values), bool)
        later[order[1:][ties]] = True
        shared[order[:-1][ties]] = True
        shared |= later
        blocks, bits, a = [], [], 0
        for block, own in zip(table["block"].to_pylist(), lists):
            b = a + len(own)
            if shared[a:b].any():
                blocks.append(block)
                bits.append(np.packbits(np.stack([shared[a:b], later[a:b]]), axis=1).tobytes())
            a = b
        bucket = pa.array([table["bucket"][0].as_py()] * len(blocks), pa.int64())
        return pa.table([pa.array(blocks, pa.int64()), bucket, pa.array(bits, pa.binary())], names=["block", "bucket", "bits"])

    return run


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, ids, sizes, data): consecutive texts, compressed, up to ``BLOCK`` bytes or one text."""

    def run(batches):
        ids, texts, size, number = [], [], 0, 0
        first = TaskContext.get().partitionId() << 32

        def close():
            data = zstandard.compress(b"".join(texts), 3)
            return pa.record_batch(
                [
                    pa.array([first + number], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                    pa.array([data], pa.binary()),
                ],
                names=["block", "ids", "sizes", "data"],
            )

        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1)):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if texts and size + len(raw) > BLOCK:
                    yield close()
                    ids, texts, size, number = [], [], 0, number + 1
                ids.append(i.as_py())
                texts.append(raw)
                size += len(raw)
        if texts:
            yield close()

    source = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return source.mapInArrow(run, "block long, ids array<long>, sizes array<long>, data binary")


def _replayed(row: dict, buckets: int, upto: int) -> tuple[Block, np.ndarray]:
    """A block after the answers of the first ``upto`` rounds, and the names it asks about next."""
    block = Block(zstandard.decompress(row["data"]), np.array(row["sizes"], np.int64))
    own = block.first()
    for k in range(upto):
        answer = _answer(own, buckets, row[f"hits{k}"])
        if k + 1 == len(ROUNDS):
            return block, block.covered(*answer)
        own = ROUNDS[k + 1](block, *answer)
    return block, own


def _asked(known: DataFrame, buckets: int, k: int) -> DataFrame:
    """(block, bucket, names) of round k."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                at, lists = _lists(_replayed(row, buckets, k)[1], buckets, WIDTHS[k])
                if len(lists):
                    yield pa.record_batch(
                        [pa.array([row["block"]] * len(lists), pa.int64()), pa.array(at.astype(np.int64)), pa.array(lists, pa.binary())],
                        names=["block", "bucket", "names"],
                    )

    return known.mapInArrow(run, "block long, bucket long, names binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes of the UTF-8 text, removed (array of start and end
    offsets in bytes, maximal and in order) and kept (binary: the bytes that remain).

    All copies of a repeated string go, the first too; strings are judged on the input and never cross
    documents; overlapping occurrences in one document count. Nulls count as empty; texts shorter than
    ``LENGTH`` keep all. Every row is a document of its own, also under a repeated or null doc_id, so
    rows that repeat each other lose all that is 200 bytes long. A cut may part the bytes of a code
    point, so ``kept`` need not be UTF-8. Other columns are ignored; an empty table gives an empty result."""
    texts = stage(blocks(docs, id_col, text_col), "blocks")
    total = texts.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    buckets = max(MIN_BUCKETS, total * len(COVER) // PERIOD // BUCKET)
    known, answers = texts, []
    for k, width in enumerate(WIDTHS):
        hits = _asked(known, buckets, k).groupBy("bucket").applyInArrow(_sort_bucket(width), "block long, bucket long, bits binary")
        answers.append(stage(hits.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias(f"hits{k}")), "hits"))
        known = known.join(answers[-1], "block", "left")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield _cut(row, *_replayed(row, buckets, len(ROUNDS)))

    return known.mapInArrow(run, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")


def _cut(row: dict, block: Block, gone: np.ndarray) -> pa.RecordBatch:
    edge = np.zeros(block.n + 1, bool)  # places where a document begins
    edge[block.starts] = True
    before = np.concatenate([[False], gone[:-1]]) & ~edge[:-1] if block.n else gone
    after = np.concatenate([gone[1:], [False]]) & ~edge[1:] if block.n else gone
    lows, highs = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
    doc = np.searchsorted(block.ends, lows, side="right")
    spans = pa.StructArray.from_arrays(
        [pa.array(lows - block.starts[doc]), pa.array(highs - block.starts[doc])], names=["start", "end"]
    )
    counts = np.bincount(doc, minlength=len(block.ends))
    raw, kept = np.frombuffer(block.data, np.uint8), []
    for a, b, n in zip(block.starts.tolist(), block.ends.tolist(), counts.tolist()):
        kept.append(raw[a:b][~gone[a:b]].tobytes() if n else block.data[a:b])
    return pa.record_batch(
        [pa.array(row["ids"], pa.int64()), pa.array(row["sizes"], pa.int64()), list_array(counts, spans), pa.array(kept, pa.binary())],
        names=["doc_id", "n_bytes", "removed", "kept"],
    )


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``remove_repeats`` does to each row, as counts and a digest of the remaining bytes."""
    lengths = F.transform("removed", lambda s: s["end"] - s["start"])
    return remove_repeats(docs, id_col, text_col).select(
        "doc_id",
        "n_bytes",
        F.aggregate(lengths, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
