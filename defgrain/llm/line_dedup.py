"""Substring dedup by hashing units of text: lines, and long lines at their sentence ends.

Units are normalised (A-Z lowered, white space joined) and hashed. For each digest that occurs more
than once the earliest occurrence is found by a map-side combined minimum over doc_id; later ones
are marked. A run of marked units that follow each other and together have at least ``min_words``
words is a repeated passage; it is cut out, its original offsets are reported, and everything else
stays as it was. Sentences find passages that were copied into an otherwise different line.

Passages that begin or end inside a unit are found by windows of ``WINDOW`` words at places that the
words alone choose: of each ``STEP`` windows in a row the one of least hash is grouped like a unit. A
copied passage so has the same windows wherever it lies; they overlap and leave out at most
``STEP - 1`` words at either end. Of 50 words in a row at least 40 are covered, and covered runs of at
least ``min_words`` words are cut out too.
"""

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import list_array, long_key, map_batches, signed, stage

MIN_WORDS = 40
WINDOW = 20
STEP = 6
_IS_WINDOW = 1 << 62
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
# A run of marks is taken whole even if no blank follows; the empty group then tells that nothing ends.
_END = re.compile(r"\n|[.!?][^\s\w]*+(?:[ \t]++|())")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def units(text: str) -> list[tuple[int, int]]:
    """(start, end) of each unit; together they are the text."""
    ends = [m.end() for m in _END.finditer(text) if m.lastindex is None]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return list(zip([0, *ends], ends))


def digest(unit: str) -> tuple[int, int]:
    """(hash, words) of a normalised unit."""
    words = unit.encode("utf-8", "surrogatepass").lower().split()
    return xxhash.xxh3_64_intdigest(b" ".join(words)), len(words)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, base)
    out[:1] = 1
    return np.multiply.accumulate(out)


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first words of the chosen windows, in order."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) < WINDOW + STEP - 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    # The polynomial of each window from running sums: words times inverse powers, scaled back.
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(hashes * _powers(_INVERSE, len(words)), out=sums[1:])
    sums = (sums[WINDOW:] - sums[:-WINDOW]) * _powers(_BASE, len(words))[WINDOW - 1 :]
    sums = (sums ^ (sums >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    sums ^= sums >> np.uint64(30)
    n = len(sums) - STEP + 1
    least, places = sums[:n].copy(), np.arange(n)
    for k in range(1, STEP):
        less = sums[k : k + n] < least
        np.copyto(least, sums[k : k + n], where=less)
        np.copyto(places, np.arange(k, k + n), where=less)
    # The first least window never moves back, so equal places are neighbours.
    places = places[np.append(True, places[1:] != places[:-1])]
    return sums[places], places


def _window_units(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and packed numbers of the windows. One that overlaps its first like is no copy of it."""
    hashes, places = windows(text)
    packed = _IS_WINDOW | places << 21 | WINDOW
    if len(set(hashes.tolist())) < len(hashes):
        _, first, like = np.unique(hashes, return_index=True, return_inverse=True)
        packed |= (places - places[first[like]] >= WINDOW).astype(np.int64) << 20
    return hashes, packed


def unit_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(digest, doc_id, row_key, unit) for the units with words and the chosen windows. ``unit`` packs
    the unit's number, or a window's first word with a flag, whether its document had the digest
    before, and the words (up to a million)."""

    def run(batch):
        digests, packed, lengths = [], [], []
        for text in batch.column(2).to_pylist():
            seen, own, hashes = set(), [], []
            for k, (a, b) in enumerate(units(text)):
                h, words = digest(text[a:b])
                if words:
                    hashes.append(h)
                    own.append(k << 21 | (h in seen) << 20 | min(words, (1 << 20) - 1))
                    seen.add(h)
            more, places = _window_units(text)
            digests += [np.array(hashes, np.uint64), more]
            packed += [np.array(own, np.int64), places]
            lengths.append(len(own) + len(places))
        repeat = np.repeat(np.arange(len(lengths)), lengths)
        return pa.record_batch(
            [
                pa.array(signed(np.concatenate(digests))),
                batch.column(0).take(pa.array(repeat)),
                batch.column(1).take(pa.array(repeat)),
                pa.array(np.concatenate(packed)),
            ],
            names=["digest", "doc_id", "row_key", "unit"],
        )

    source = docs.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(
        F.col(id_col).cast("long").alias("doc_id"), long_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text")
    )
    return map_batches(source, run, "digest long, doc_id long, row_key long, unit long")


def later_units(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row_key, later): per row the units that are not the earliest occurrence of their digest."""
    rows = unit_rows(docs, id_col, text_col)
    repeated = (
        rows.groupBy("digest")
        .agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", "first_id")
    )
    # Written first: between two plain shuffles Spark can split the partition of a hot digest.
    repeated = stage(repeated, "repeated")
    again = F.col("unit").bitwiseAND(1 << 20) != 0
    later = rows.join(repeated, "digest").where((F.col("doc_id") != F.col("first_id")) | again)
    # Rows that repeat one another have the same key and the same units; a set holds them once.
    return later.groupBy("row_key").agg(F.sort_array(F.collect_set("unit")).alias("later"))


def passages(text: str, later: list[int], min_words: int) -> list[tuple[int, int]]:
    """(start, end) of each run of later units, or of later windows, with enough words; runs that
    meet are one. Units without words, such as empty lines, neither end a run nor begin one."""
    marked = {u >> 21: u & (1 << 20) - 1 for u in later if not u & _IS_WINDOW}
    out, run, words = [], None, 0
    for k, (a, b) in enumerate(units(text) if marked else ()):
        if k in marked:
            run, words = (run[0] if run else a, b), words + marked[k]
        elif run and text[a:b].strip():
            if words >= min_words:
                out.append(run)
            run, words = None, 0
    if run and words >= min_words:
        out.append(run)
    return _merged(out + _covered(text, sorted((u ^ _IS_WINDOW) >> 21 for u in later if u & _IS_WINDOW), min_words))


def _covered(text: str, starts: list[int], min_words: int) -> list[tuple[int, int]]:
    """(start, end) of each run of words that windows from ``starts`` cover, with the blanks after it."""
    runs = []
    for i in starts:
        if runs and i <= runs[-1][1]:
            runs[-1][1] = i + WINDOW
        else:
            runs.append([i, i + WINDOW])
    runs = [r for r in runs if r[1] - r[0] >= min_words]
    if not runs:
        return []
    places, out = [m.span() for m in _WORD.finditer(text)], []
    for i, j in runs:
        end = places[j - 1][1]
        while end < len(text) and text[end] in " \t":
            end += 1
        out.append((places[i][0], end))
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per input row: doc_id, text without later copies of passages, removed (array of
    start and end offsets in the original, in code points), n_removed (passages) and
    removed_chars.

    Occurrences are ranked by doc_id, then by place. Rows that repeat a doc_id are one document:
    equal rows keep or lose the same passages. Null and empty texts come back as they are; rows
    without doc_id have no rank and are left alone. Other columns are ignored; an empty table gives
    an empty result."""
    marks = later_units(docs, id_col, text_col)
    source = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), long_key(id_col, text_col).alias("row_key")
    )
    joined = source.join(marks, "row_key", "left").select("doc_id", "text", F.when(F.col("doc_id").isNotNull(), F.col("later")).alias("later"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    return map_batches(joined, _cut(min_words), f"doc_id {id_type}, text string, removed array<struct<start:long,end:long>>, n_removed long, removed_chars long")


def _cut(min_words: int):
    def run(batch):
        texts, spans = [], []
        for text, later in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            own = passages(text, later, min_words) if later else []
            spans.append(own)
            texts.append(without(text, own))
        flat = [s for own in spans for s in own]
        pairs = pa.StructArray.from_arrays(
            [pa.array([a for a, _ in flat], pa.int64()), pa.array([b for _, b in flat], pa.int64())], names=["start", "end"]
        )
        return pa.record_batch(
            [
                batch.column(0),
                pa.array(texts, pa.string()),
                list_array([len(s) for s in spans], pairs),
                pa.array([len(s) for s in spans], pa.int64()),
                pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
            ],
            names=["doc_id", "text", "removed", "n_removed", "removed_chars"],
        )

    return run


def without(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    if not spans:
        return text
    edges = [0, *(x for span in spans for x in span), len(text)]
    return "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def dedup_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None, min_words: int = MIN_WORDS
) -> DataFrame:
    """The input with all its columns, later copies cut out of the text, and ``chars_col`` set to
    the new length of changed texts. Documents of which nothing but white space is left are
    dropped; texts that were blank before stay."""
    marks = later_units(docs, id_col, text_col).select(F.col("row_key").alias("_defgrain_key"), F.col("later").alias("_defgrain_later"))
    key = F.when(docs[id_col].isNotNull(), long_key(docs[id_col], docs[text_col]))
    joined = docs.join(marks, key == marks["_defgrain_key"], "left").drop("_defgrain_key")
    at = docs.columns.index(text_col)
    chars_at = docs.columns.index(chars_col) if chars_col else None

    def run(batch):
        columns, later = batch.columns[:-1], batch.column(batch.num_columns - 1).to_pylist()
        texts = columns[at].to_pylist()
        new = [t if u is None else without(t, passages(t, u, min_words)) for t, u in zip(texts, later)]
        changed = [u is not None and a != b for u, a, b in zip(later, texts, new)]
        columns[at] = pa.array(new, columns[at].type)
        if chars_at is not None:
            sizes = [len(t) if c else n for t, c, n in zip(new, changed, columns[chars_at].to_pylist())]
            columns[chars_at] = pa.array(sizes, columns[chars_at].type)
        kept = pa.array([not c or bool(t.strip()) for t, c in zip(new, changed)], pa.bool_())
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1]).filter(kept)

    return map_batches(joined, run, docs.schema)
