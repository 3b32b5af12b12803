"""Near copies by the Jaccard similarity of five-word shingles, 0.8 or more, checked exactly.

Candidates meet in two ways. The SimHash operator (simhash.py, with its own words, bits and radius) links texts
whose fingerprints are close, all of them, which stands for a similarity of about 0.96. Down to 0.8 they meet by
min-hashes: ``BANDS`` bands of ``ROWS`` each, so a pair of similarity 0.8 shares
no band with probability (1 - 0.8^5)^30, under 1 in 100,000, and a closer pair less. Candidates whose
min-hashes agree in ``LEAST`` places, and those that SimHash links, are gathered into neighbourhoods, and
inside a neighbourhood shingle sets are compared exactly, each shipped once.

Both steps emit links that connect what is connected, never all pairs: members of a group are first
compared with its least one; what that leaves over is compared with all in cells of bounded size,
and a cell emits a spanning forest. No group is capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import list_array, long_key, map_batches, signed, slices, space_words, stage
from .components import components

SHINGLE = 5
BANDS, ROWS = 30, 5
#: Similarity is at least 8 of 10. Pairs whose min-hashes agree in under ``LEAST`` of 150 places (0.65,
#: 4.5 standard deviations below 0.8, so one close pair in 300,000 fails it) are not compared.
LEAST = 98
SEED = 42
CELL_ROWS, CELL_BYTES = 4096, 32 << 20  # what a task compares at once, about
BLOOM_BITS = 1 << 25
_BLOCK = 4096  # shingles whose min-hashes are taken at once
_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text is one shingle, one without words none."""
    words = space_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    ends = (ends - 1).tolist()
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :])], np.uint64))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of the BANDS * ROWS hash functions."""
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _BLOCK):
        values = _TIMES[:, None] * hashes[None, at : at + _BLOCK] + _PLUS[:, None]
        np.minimum(out, values.min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    keys = (sig.reshape(BANDS, ROWS) * _TIMES[:ROWS]).sum(axis=1, dtype=np.uint64) + _PLUS[:BANDS]
    keys = (keys ^ (keys >> np.uint64(32))) * _TIMES[ROWS]
    return keys ^ (keys >> np.uint64(29))


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row_key, fp, bands, sketch) of each row; ``fp`` is a hash of the shingle set, ``sketch``
    one byte of each min-hash."""

    def run(batch):
        fps, bands, sketches = [], [], []
        for text in batch.column(2).to_pylist():
            own = shingles(text)
            sig = signature(own)
            fps.append(xxhash.xxh3_64_intdigest(own.tobytes()))
            bands.append(band_keys(sig))
            sketches.append((sig >> np.uint64(24)).astype(np.uint8).tobytes())
        return pa.record_batch(
            [
                batch.column(0),
                batch.column(1),
                pa.array(signed(np.array(fps, dtype=np.uint64))),
                list_array([BANDS] * len(bands), pa.array(signed(np.concatenate(bands)))),
                pa.array(sketches, pa.binary()),
            ],
            names=["doc_id", "row_key", "fp", "bands", "sketch"],
        )

    source = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), long_key(id_col, text_col).alias("row_key"), F.col(text_col)
    )
    return map_batches(source, run, "doc_id long, row_key long, fp long, bands array<long>, sketch binary")


class Sketches:
    """Which min-hashes agree in ``LEAST`` places."""

    def __init__(self, data: list[bytes]):
        self.rows = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1)

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        return (self.rows[others] == self.rows[i]).sum(axis=1) >= LEAST

    @classmethod
    def pairs(cls, a: list[bytes], b: list[bytes]) -> list[bool]:
        return ((cls(a).rows == cls(b).rows).sum(axis=1) >= LEAST).tolist()


class Sets:
    """Which shingle sets have a Jaccard similarity of 0.8 or more, exactly. Common shingles of one
    set with all others are counted from an index over the shingles of the cell."""

    def __init__(self, data: list[bytes]):
        self.sizes = np.array([len(d) // 8 for d in data])
        _, at = np.unique(np.frombuffer(b"".join(data), np.uint64), return_inverse=True)
        self.holders = np.repeat(np.arange(len(data)), self.sizes)[np.argsort(at, kind="stable")]
        self.counts = np.bincount(at)
        self.first = np.cumsum(self.counts) - self.counts
        self.own = np.split(at, np.cumsum(self.sizes)[:-1])

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        counts, first = self.counts[self.own[i]], self.first[self.own[i]]
        place = np.arange(counts.sum()) + np.repeat(first - np.cumsum(counts) + counts, counts)
        shared = np.bincount(self.holders[place], minlength=len(self.sizes))[others]
        return 10 * shared >= 8 * (self.sizes[i] + self.sizes[others] - shared)

    @classmethod
    def pairs(cls, a: list[bytes], b: list[bytes]) -> list[bool]:
        return [x == y or bool(cls([x, y]).near(0, np.array([1]))[0]) for x, y in zip(a, b)]


def forest(rows: Sketches | Sets, main: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is near; members of ``main`` are connected already."""
    joined, left, links, front = np.flatnonzero(main), np.flatnonzero(~main), [], []
    if len(joined):
        for i in left.tolist():
            near = rows.near(i, joined)
            if near.any():
                links.append((i, int(joined[near.argmax()])))
                front.append(i)
        left = np.setdiff1d(left, front)
    while len(left):
        if not front:
            front, left = [int(left[0])], left[1:]
        at = front.pop()
        near = rows.near(at, left)
        links += [(at, k) for k in left[near].tolist()]
        front += left[near].tolist()
        left = left[~near]
    return links


def _with_least(groups: DataFrame, kind: type) -> DataFrame:
    """``groups`` (key, fp, data), each with whether it is near the least fp of its key."""
    least = groups.groupBy("key").agg(F.min("fp").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    least = stage(least, "leaders")
    leaders = groups.join(least.withColumn("fp", F.col("lead")), ["key", "fp"]).select("key", "lead", F.col("data").alias("lead_data"))
    met = groups.join(stage(leaders, "leaders"), "key")

    def run(batches):
        for batch in batches:
            for part in slices(iter([batch])):
                main = kind.pairs(part["lead_data"].to_pylist(), part["data"].to_pylist())
                yield pa.record_batch(
                    [part["key"], part["fp"], part["lead"], part["data"], pa.array(main, pa.bool_())], names=["key", "fp", "lead", "data", "main"]
                )

    return stage(met.select("key", "fp", "lead", "data", "lead_data").mapInArrow(run, "key long, fp long, lead long, data binary, main boolean"), "met")


def _cells(met: DataFrame) -> DataFrame:
    """Deal the groups that hold members not near their least one into cells, so that each of these
    shares a cell with every member of its group. Members near the least one need not meet each other."""
    count = "ceil(greatest(count_if({0}) / {1}, sum(if({0}, length(data), 0)) / {2}))"
    counts = met.groupBy("key").agg(
        F.expr(count.format("main", CELL_ROWS, CELL_BYTES)).alias("g"), F.expr(count.format("not main", CELL_ROWS, CELL_BYTES)).alias("r")
    )
    counts = counts.where("r > 0")
    rows = met.join(stage(counts, "cells"), "key")
    block = "pmod(xxhash64(fp), if(main, g, r))"
    # Cells (block of main members, block of others), and (-1 - j, k) of two blocks j < k of others.
    dealt = rows.withColumn("b", F.expr(block)).withColumn(
        "cell",
        F.explode(
            F.expr(
                "if(main, transform(sequence(0L, r - 1), j -> struct(b as x, j as y)), concat("
                "transform(sequence(0L, g - 1), i -> struct(i as x, b as y)), "
                "transform(filter(sequence(0L, r - 1), k -> k <> b), k -> struct(-1 - least(b, k) as x, greatest(b, k) as y))))"
            )
        ),
    )
    return dealt.select(F.xxhash64("key", "cell.x", "cell.y").alias("cell"), "fp", "main", "data")


def _links(groups: DataFrame, kind: type) -> DataFrame:
    """Links (u, v) that connect what is near inside each key of ``groups`` (key, fp, data)."""
    met = _with_least(groups, kind)

    def close(held):
        table = pa.Table.from_batches(held)
        fps, main = np.asarray(table["fp"]), np.asarray(table["main"])
        found = forest(kind(table["data"].to_pylist()), main)
        if found:
            u, v = (fps[np.array(x)] for x in zip(*found))
            yield pa.record_batch([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    def run(batches):
        last, held = None, []
        for batch in batches:
            keys = np.asarray(batch.column(0))
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if held and keys[a] != last:
                    yield from close(held)
                    held = []
                last = keys[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from close(held)

    dealt = _cells(met).repartition("cell").sortWithinPartitions("cell")
    found = stage(dealt.mapInArrow(run, "u long, v long"), "links")
    star = met.where("main and fp <> lead").select(F.col("lead").alias("u"), F.col("fp").alias("v"))
    return star.unionByName(found)


def _bloom(keys: DataFrame) -> np.ndarray:
    """A Bloom filter over ``row_key``, two bits a key, of a fixed size whatever the number of keys."""
    at = F.explode(F.array(F.col("row_key"), F.shiftright("row_key", 32))).alias("at")
    at = keys.select(at).select(F.col("at").bitwiseAND(BLOOM_BITS - 1).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(BLOOM_BITS // 64, np.int64)
    out[np.asarray(words["word"])] = np.asarray(words["bits"])
    return out


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, fp, data) for ``wanted`` (key, fp, row_key): the shingle set of a text as bytes. Sets are
    made where the texts lie, of rows that pass a Bloom filter, so that no text is shuffled."""
    bloom = _bloom(wanted)

    def passes(at: np.ndarray) -> np.ndarray:
        at = at & (BLOOM_BITS - 1)
        return (bloom[at >> 6] >> (at & 63)) & 1 == 1

    def run(batch):
        keys = np.asarray(batch.column(0))
        batch = batch.filter(pa.array(passes(keys) & passes(keys >> 32)))
        data = [shingles(t).tobytes() for t in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(data, pa.binary())], names=["row_key", "data"])

    source = docs.where(F.col(id_col).isNotNull()).select(long_key(id_col, text_col).alias("row_key"), F.col(text_col))
    return wanted.join(map_batches(source, run, "row_key long, data binary"), "row_key").select("key", "fp", "data")


def _simhash_links(docs: DataFrame, first: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links (u, v) between the classes of ``first`` (fp, doc_id, row_key) that connect those whose SimHash
    fingerprints are within the operator's radius."""
    prints = simhash.fingerprints(docs.where(F.col(id_col).isNotNull()), id_col, text_col).withColumnRenamed("fp", "print")
    prints = prints.join(first, ["doc_id", "row_key"]).groupBy("fp").agg(F.min("print").alias("print"))
    prints = stage(prints, "prints")
    nodes = stage(prints.groupBy("print").agg(F.min("fp").alias("node")), "nodes")
    same = prints.join(nodes, "print").where("fp <> node").select(F.col("node").alias("u"), F.col("fp").alias("v"))
    return simhash.links(nodes.select(F.col("print").alias("fp"), "node")).unionByName(same)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with one document of each group that links of similarity 0.8 or more connect: the one
    with the least doc_id. All columns stay.

    A null text counts as empty; documents without words are copies of each other. Repeated rows are
    reduced to one; texts under one doc_id are one document, and the one with the least key stays. Texts
    of any length take part whole; of documents that tie, all but the least go. Rows without doc_id
    belong to no group and stay; an empty table gives an empty result."""
    marked = stage(signatures(docs, id_col, text_col), "signatures")
    # The least (doc_id, row_key) of a class, without sorting rows that hold sketches.
    first = marked.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    first = marked.join(stage(first, "first"), ["fp", "doc_id"]).groupBy("fp", "doc_id").agg(F.min("row_key").alias("row_key"))
    first = stage(first, "first")
    repeated = marked.groupBy("doc_id", "row_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeats = not repeated.isEmpty()
    classes = marked.join(first, ["fp", "doc_id", "row_key"])
    classes = stage(classes.dropDuplicates(["fp"]) if repeats else classes, "classes")
    # Sketches follow only once it is known which bands are shared; most are not.
    members = classes.select(F.explode("bands").alias("key"), "fp")
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    members = members.join(stage(shared, "shared"), "key")
    members = stage(members.join(classes.select("fp", F.col("sketch").alias("data")), "fp"), "buckets")
    met = _links(members, Sketches).unionByName(_simhash_links(docs, first, id_col, text_col))
    near = components(met).select(F.col("node").alias("fp"), F.col("root").alias("key"))
    wanted = stage(near.join(first, "fp").select("key", "fp", "row_key"), "wanted")
    sets = shingle_sets(docs, wanted, id_col, text_col)
    found = _links(stage(sets.dropDuplicates(["key", "fp"]) if repeats else sets, "sets"), Sets)
    # A document with several texts ties their sets together.
    own = marked.groupBy("doc_id").agg(F.min("fp").alias("u"), F.max("fp").alias("b")).where("u <> b").select("doc_id", "u")
    ties = marked.join(own, "doc_id").where("fp <> u").select("u", F.col("fp").alias("v"))
    roots = components(found.unionByName(ties)).select(F.col("node").alias("fp"), F.col("root"))
    parts = first.join(roots, "fp", "left").withColumn("part", F.coalesce("root", "fp"))
    kept = stage(parts.groupBy("part").agg(F.min(F.struct("doc_id", "row_key")).alias("first")), "kept")
    kept = kept.select(F.col("first.doc_id").alias("_keep_id"), F.col("first.row_key").alias("_keep_key"))
    key = long_key(docs[id_col], docs[text_col])
    single = docs.join(kept, (docs[id_col].cast("long") == kept["_keep_id"]) & (key == kept["_keep_key"]), "left_semi")
    if repeats:
        single = single.dropDuplicates([id_col])
    return single.unionByName(docs.where(F.col(id_col).isNull()))
