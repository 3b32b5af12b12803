"""Near duplicates by SimHash, found with covering locality-sensitive hashing.

Each of the 64 bit positions gets a random code of ``radius + 1`` bits; for each non-zero code word
v the mask keeps the positions whose code has an odd inner product with v. The codes of at most
``radius`` positions span at most ``radius`` dimensions, so some v has an even product with all of
them: in that mask's table a pair that differs there only collides, always. No link can be missed, and there is no cap:
a bucket with more members than a task should compare is dealt out anew by a second family of
masks, again without loss.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import long_key, map_batches, space_words, stage
from .components import components

RADIUS = 4
SHINGLE = 4
SEED = 42
_BLOCK = 1 << 15  # shingles whose bits are counted at once
MAX_BUCKET = 8192
MAX_LEVELS = 6


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash: a bit is set if it is set in over half of the shingle hashes."""
    words = space_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    ends = (ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    n = len(words) - shingle + 1
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _BLOCK):
        to = min(n, at + _BLOCK)
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[at:to], ends[at + shingle - 1 : to + shingle - 1])]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n).view(">u8")[0])


def masks(level: int = 0, radius: int = RADIUS) -> list[int]:
    """The covering family of a level: 2^(radius+1) - 1 masks over 64 positions."""
    codes = np.random.default_rng([SEED, level]).integers(1, 1 << (radius + 1), 64)
    return [
        sum(1 << i for i, c in enumerate(codes.tolist()) if (c & v).bit_count() % 2)
        for v in range(1, 1 << (radius + 1))
    ]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, fp) for each row; a null text counts as empty."""

    def run(batch):
        fps = [fingerprint(t) for t in batch.column(2).to_pylist()]
        return pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))],
            names=["doc_id", "row_key", "fp"],
        )

    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), long_key(id_col, text_col).alias("row_key"), F.col(text_col)
    )
    return map_batches(source, run, "doc_id long, row_key long, fp long")


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning links of the graph of fingerprints within ``radius``: each is compared once with
    those not yet reached, so dense groups, of which few are left after a step, stay cheap."""
    found, left = [], np.arange(len(fps))
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= radius
            if near.any():
                reached = left[near].tolist()
                found += [(at, r) for r in reached]
                front += reached
                left = left[~near]
    return found


def _bucket_links(keyed: DataFrame, radius: int, max_bucket: int) -> DataFrame:
    """Rows (key, fp, node) of one table each to spanning links (u, v), and for buckets beyond
    ``max_bucket`` to the rows themselves with ``deeper`` set. Buckets are read as a sorted stream;
    at most ``max_bucket`` rows of one are held."""
    schema = "u long, v long, key long, deeper boolean"

    def run(batches):
        held_key, held, spilled = None, [], False

        def close():
            if held_key is None or spilled:
                return
            rows = np.concatenate(held)
            if len(rows) < 2:
                return
            links = _forest(rows[:, 0].view(np.uint64), radius)
            if links:
                pair = rows[np.array(links)][:, :, 1]
                yield out(pair[:, 0], pair[:, 1], held_key, False)

        def out(u, v, key, deeper):
            n = len(u)
            return pa.record_batch(
                [pa.array(u), pa.array(v), pa.array(np.full(n, key)), pa.array(np.full(n, deeper))],
                names=["u", "v", "key", "deeper"],
            )

        size = 0
        for batch in batches:
            keys, fps, nodes = (np.asarray(c) for c in batch.columns)
            rows = np.stack([fps, nodes], axis=1)
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            edges = [0, *cuts.tolist(), len(keys)]
            # Buckets that lie wholly inside the batch and have one member need no work.
            for a, b in zip(edges, edges[1:]):
                if a == b or (b - a == 1 and 0 < a and b < len(keys)):
                    continue
                if held_key is None or keys[a] != held_key:
                    yield from close()
                    held_key, held, spilled, size = int(keys[a]), [], False, 0
                size += b - a
                held.append(rows[a:b])
                if size > max_bucket:
                    for part in held:
                        yield out(part[:, 0].copy(), part[:, 1].copy(), held_key, True)
                    held, spilled = [], True
        yield from close()

    return keyed.repartition("key").sortWithinPartitions("key").select("key", "fp", "node").mapInArrow(run, schema)


def _dealt(nodes: DataFrame, level: int, radius: int) -> DataFrame:
    """One row per fingerprint and mask; the key tells the tables and parent buckets apart."""
    family = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks(level, radius)])
    parts = nodes.select("*", F.posexplode(family).alias("table", "mask"))
    above = ["key"] if "key" in nodes.columns else []
    key = F.xxhash64(F.lit(level), "table", F.col("fp").bitwiseAND(F.col("mask")), *above)
    return parts.select(key.alias("key"), "fp", "node")


def links(fps: DataFrame, radius: int = RADIUS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links (u, v) between nodes whose fingerprints differ in at most ``radius`` bits: enough to
    connect whatever is connected. ``fps`` has one row (fp, node) per distinct fingerprint."""
    found, todo = [], fps.select("fp", "node")
    for level in range(MAX_LEVELS):
        last = level == MAX_LEVELS - 1
        # After six families any bucket shares so many bits that few different members are left.
        out = stage(_bucket_links(_dealt(todo, level, radius), radius, 1 << 62 if last else max_bucket), "links")
        found.append(out.where(~F.col("deeper")).select("u", "v"))
        deeper = out.where("deeper")
        if last or deeper.isEmpty():
            break
        todo = deeper.select(F.col("u").alias("fp"), F.col("v").alias("node"), "key")
    return reduce(DataFrame.unionByName, found)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, max_bucket: int = MAX_BUCKET
) -> DataFrame:
    """One row per input row: doc_id, row_key, fingerprint (16 hex digits) and component_id, the
    least doc_id that links of at most ``radius`` differing bits reach.

    Copies share a fingerprint and enter the search once. A null text is an empty one; empty texts
    have fingerprint zero and link like others. Rows that repeat a doc_id are one document and so
    linked. A row without doc_id gets its fingerprint, links nothing and has a null component.
    Other columns are ignored; an empty table gives an empty result."""
    marked = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    known = marked.where(F.col("doc_id").isNotNull())
    classes = stage(known.groupBy("fp").agg(F.min("doc_id").alias("node")), "classes")
    found = links(classes, radius, max_bucket)
    # A document with several texts has several fingerprints; tie them together.
    own = known.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b")
    several = known.join(own.select("doc_id"), "doc_id").join(classes, "fp").select("doc_id", "node")
    roots = components(found.unionByName(several.select(F.col("doc_id").alias("u"), F.col("node").alias("v"))))
    labelled = classes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    # Written first: between two plain shuffles Spark can split the partition of a hot fingerprint.
    labelled = stage(labelled, "labelled")
    return marked.join(labelled, "fp", "left").select(
        "doc_id",
        "row_key",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with one document of each group of near duplicates: the one with the least
    doc_id. All columns stay. Repeated rows are reduced to one; of several texts under one doc_id
    the one with the least key stays. Rows without doc_id belong to no group and stay."""
    found = near_duplicates(docs, id_col, text_col)
    kept = (
        found.where(F.col("doc_id") == F.col("component_id"))
        .groupBy("doc_id")
        .agg(F.min("row_key").alias("_keep_key"))
        .withColumnRenamed("doc_id", "_keep_id")
    )
    key = long_key(docs[id_col], docs[text_col])
    single = docs.join(
        kept, (docs[id_col].cast("long") == kept["_keep_id"]) & (key == kept["_keep_key"]), "left_semi"
    ).dropDuplicates([id_col])
    return single.unionByName(docs.where(F.col(id_col).isNull()))
