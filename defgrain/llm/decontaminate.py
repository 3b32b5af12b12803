"""Benchmark decontamination: a broadcast set of the benchmark's normalised windows, looked up at
every token window of every document.

A window is ``width`` consecutive words of an item; a shorter item is one window. The set holds the
windows themselves, so a hit needs no further check. It is broadcast in parts of bounded size: a
benchmark beyond one part is looked up part by part and the hits are joined per document.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, long_key, map_batches, stage

WIDTH = 13
MAX_PART = 500_000  # windows broadcast at once
HIT_SHARE = 20  # contaminated from one hit word in so many

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
HITS = "item_ids array<long>, starts array<long>, ends array<long>"


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(window, n, item_id) of each item, with or without id; items without words have none."""

    def run(batch):
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = alnum_words(text)
            n = min(width, len(words))
            rows += {(b" ".join(words[i : i + n]), n, item) for i in range(len(words) - n + 1)} if n else ()
        if not rows:
            return None
        kinds = (pa.binary(), pa.int32(), pa.int64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["window", "n", "item_id"])

    source = benchmark.select(F.col(id_col).cast("long").alias("item_id"), text_col)
    return map_batches(source, run, "window binary, n int, item_id long")


def find(words: list[bytes], windows: dict[int, dict[bytes, list[int]]]) -> list[tuple[int, int, list[int]]]:
    """(start, end, item_ids) of each occurrence of a window, in words."""
    if not words:
        return []
    joined, starts, at = b" ".join(words), [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    starts.append(at)
    out = []
    for n, known in windows.items():
        for i, (a, b) in enumerate(zip(starts, starts[n:])):
            items = known.get(joined[a : b - 1])
            if items is not None:
                out.append((i, i + n, items))
    return sorted(out, key=lambda x: x[:2])


def covered(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open intervals as disjoint ones."""
    out: list[list[int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _scan(source: DataFrame, part: list, keep: list[str]) -> DataFrame:
    """Rows of ``source`` (row_key, text and ``keep``) with the merged hits of one part."""
    windows: dict[int, dict[bytes, list[int]]] = {}
    for row in part:
        windows.setdefault(row["n"], {})[bytes(row["window"])] = row["items"]
    shared = source.sparkSession.sparkContext.broadcast(windows)

    def run(batch):
        known = shared.value
        counts, items, starts, ends = [], [], [], []
        for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
            words = alnum_words(text)
            hits = find(words, known)
            spans = covered([(a, b) for a, b, _ in hits])
            counts.append(len(words))
            items.append(sorted({i for _, _, own in hits for i in own}))
            starts.append([a for a, _ in spans])
            ends.append([b for _, b in spans])
        kind = pa.list_(pa.int64())
        added = [pa.array(counts, pa.int64()), pa.array(items, kind), pa.array(starts, kind), pa.array(ends, kind)]
        names = [*keep, "n_words", "item_ids", "starts", "ends"]
        return pa.record_batch([*[batch.column(batch.schema.get_field_index(c)) for c in keep], *added], names=names)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in keep)
    return map_batches(source, run, f"{kept}, n_words long, {HITS}")


def hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WIDTH,
    max_part: int = MAX_PART,
) -> DataFrame:
    """(doc_id, row_key, n_words, item_ids, starts, ends): items that occur, and the hit words as
    disjoint spans.

    Null texts have no words. Words of an item without item_id are hit like any, but no id is listed for
    it. Repeated rows are scanned alike, and other
    columns ignored; an empty benchmark hits nothing."""
    windows = item_windows(benchmark, item_col, item_text_col, width)
    known = stage(windows.groupBy("n", "window").agg(F.sort_array(F.collect_set("item_id")).alias("items")), "windows")
    n_parts = max(1, -(-known.count() // max_part))
    source = docs.select(
        F.col(id_col).alias("doc_id"), long_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text")
    )
    parted = known.withColumn("part", F.pmod(F.xxhash64("window"), F.lit(n_parts)))
    scans = [_scan(source, parted.where(F.col("part") == p).collect(), ["doc_id", "row_key"]) for p in range(n_parts)]
    if n_parts == 1:
        return scans[0]
    merge = F.udf(lambda s, e: covered(list(zip(s, e))), "array<struct<a:long,b:long>>")
    joined = (
        reduce(DataFrame.unionByName, scans)
        .groupBy("doc_id", "row_key")
        .agg(
            F.max("n_words").alias("n_words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
            merge(F.flatten(F.collect_list("starts")), F.flatten(F.collect_list("ends"))).alias("spans"),
        )
    )
    merged = joined.select("doc_id", "row_key", "n_words", "item_ids", F.col("spans.a").alias("starts"), F.col("spans.b").alias("ends"))
    # Repeated rows were merged into one; give each its own again.
    return source.select("doc_id", "row_key").join(
        merged.withColumnRenamed("doc_id", "_id"), "row_key"
    ).where(F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id")


def n_hit():
    return F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("long"), lambda s, x: s + x["ends"] - x["starts"])


def contaminated():
    return (n_hit() > 0) & (n_hit() * HIT_SHARE >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 (of the item_ids, sorted as strings and
    comma-joined), contaminated."""
    ids = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return hits(docs, benchmark, **options).select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def remove_spans(text: str | None, starts: list[int], ends: list[int]) -> str | None:
    """``text`` without the words of the given spans and the characters between them."""
    if not text or not starts:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(raw)]
    kept, last = [], 0
    for a, b in zip(starts, ends):
        kept.append(raw[last : places[a][0]])
        last = places[b - 1][1]
    kept.append(raw[last:])
    return b"".join(kept).decode("utf-8", "surrogatepass")


def clean(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: str = "documents", **options
) -> DataFrame:
    """The documents with all their columns, without the contaminated ones (``documents``), or with
    their hit words cut out of the text (``spans``). Documents that are not contaminated stay as
    they are, whatever single words in them were hit."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be 'documents' or 'spans'")
    found = hits(docs, benchmark, id_col, text_col, **options).where(contaminated())
    # Written first: contaminated documents are few, and a table of known size is broadcast by itself.
    spans = [] if remove == "documents" else [F.col("starts").alias("_starts"), F.col("ends").alias("_ends")]
    found = stage(found.select(F.col("row_key").alias("_hit_key"), *spans), "contaminated")
    key = long_key(docs[id_col], docs[text_col])
    if remove == "documents":
        return docs.join(found, key == found["_hit_key"], "left_anti")
    cut = F.udf(remove_spans, "string")
    found = found.dropDuplicates(["_hit_key"])
    joined = docs.join(found, key == found["_hit_key"], "left")
    new = cut(docs[text_col], found["_starts"], found["_ends"])
    text = F.when(found["_hit_key"].isNotNull(), new).otherwise(docs[text_col])
    return joined.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns])
