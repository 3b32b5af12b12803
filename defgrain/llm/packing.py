"""Lexical retrieval packing: fill training windows with documents that share words.

Documents are tokenised once into a written table, and how many documents hold each token is
counted over all of them. A shard is a run of consecutive documents of bounded total length; it gets
a BM25 inverted index, weighted by the corpus-wide counts. Full windows are cut off long documents
first. The rest of each document is a seed in turn: the index returns its best unused neighbours,
which fill the seed's window; the last one is cut to fit and its remainder stays in the pool. What a
shard has left at its end, less than a window, becomes sequences of power-of-two length, so there is
no padding at all. Shards are read as a stream: nothing is shuffled but the token counts.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

WINDOW = 4096
TOKENIZER = "word_bpe_49k.json"
END = 2
SHARD_TOKENS = 1_000_000
K1, B = 1.2, 0.75
_CACHE = 200_000  # pieces whose ids a worker remembers; twice as many at most


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Pieces:
    """Ids of the pieces that texts are made of, most recent and most used ones remembered.

    The tokenizer splits texts into pieces that it encodes on their own, so each different piece
    need be encoded once. Texts in Latin-1 are split here by the tokenizer's own rule, many at once;
    other texts are cut at ASCII white space, which no piece spans, and encoded chunk by chunk."""

    def __init__(self, path: str, kind: str):
        self.tokenizer, self.kind = _tokenizer(path), np.dtype(kind)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype=bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.ends[i] = token.endswith(_WORD_END)
        self.splits = _RULE in _rules(path)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        plain = [self._plain(t) for t in texts]
        out = [self._in_chunks(t) if p is None else b"" for t, p in zip(texts, plain)]
        at = [k for k, p in enumerate(plain) if p is not None]
        for k, ids in zip(at, self._together([plain[k] for k in at])):
            out[k] = ids
        return out

    def _plain(self, text: str) -> bytes | None:
        """The text as lower Latin-1, or None if its splitting needs the tokenizer."""
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        if not self.splits or b"<|" in raw or len(raw.translate(None, _NOT_PLAIN)) < len(raw):
            return None
        return raw.translate(_LOWER)

    def _in_chunks(self, text: str) -> bytes:
        chunks = [_CHUNK + c for c in text.encode("utf-8", "surrogatepass").split()]
        known = self.learn(set(chunks))
        return b"".join(map(known.__getitem__, chunks))

    def _together(self, texts: list[bytes]) -> list[bytes]:
        """Split and encode texts side by side: their different pieces are found by Arrow."""
        raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        kinds, begins = piece_starts(raw)
        places = np.flatnonzero(begins)
        inside = kinds > 0
        data = raw[inside]
        offsets = np.append(np.flatnonzero(begins[inside]), len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        different = coded.dictionary.to_pylist()
        known = self.learn(set(different))
        ids = [known[p] for p in different]
        flat = np.frombuffer(b"".join(ids), self.kind)
        sizes = np.array([len(i) for i in ids], dtype=np.int64) // self.kind.itemsize
        firsts = np.cumsum(sizes) - sizes
        index = np.asarray(coded.indices)
        lengths = sizes[index]
        ends = np.cumsum(lengths)
        whole = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(firsts[index] - ends + lengths, lengths)]
        # Where each text ends: in the bytes, in the pieces, in the ids.
        stops = np.searchsorted(places, np.cumsum([len(t) + 1 for t in texts]))
        stops = np.append(0, ends)[stops].tolist()
        return [whole[a:b].tobytes() for a, b in zip([0, *stops], stops)]

    def learn(self, wanted: set[bytes]) -> dict[bytes, bytes]:
        """A table that has the ids of all wanted pieces."""
        if len(self.young) > _CACHE:
            self.old, self.young = self.young, {}
        known = self.young
        new = []
        for p in wanted.difference(known):
            ids = self.old.get(p)
            if ids is None:
                new.append(p)
            else:
                known[p] = ids
        single = [p for p in new if not p.startswith(_CHUNK)]
        for at in range(0, len(single), 5000):
            known.update(self._joined(single[at : at + 5000]))
        chunks = [p for p in new if p not in known]
        for at in range(0, len(chunks), 5000):
            part = chunks[at : at + 5000]
            plain = [p[1:].decode("utf-8", "replace") if p.startswith(_CHUNK) else p.decode("latin-1") for p in part]
            encoded = self.tokenizer.encode_batch(plain, add_special_tokens=False)
            known.update((p, np.array(e.ids, dtype=self.kind).tobytes()) for p, e in zip(part, encoded))
        return known

    def _joined(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Encode pieces side by side; ids that end a word tell them apart again."""
        lines = [b" ".join(pieces[at : at + 50]).decode("latin-1") for at in range(0, len(pieces), 50)]
        encoded = self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.array([i for e in encoded for i in e.ids], dtype=np.int64)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(pieces):
            return {}
        raw, width = ids.astype(self.kind).tobytes(), self.kind.itemsize
        edges = [0, *(cuts * width).tolist()]
        return {p: raw[a:b] for p, a, b in zip(pieces, edges, edges[1:])}


def piece_starts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kind of each byte of lower Latin-1 text (0 space, 1 letter, 2 number, 3 other), and
    whether a piece begins there: runs of letters, single numbers, runs of others, and the endings
    after an apostrophe that begins such a run."""
    kinds = _KINDS_OF[raw]
    begins = np.empty(len(raw), dtype=bool)
    begins[:1] = True
    np.not_equal(kinds[1:], kinds[:-1], out=begins[1:])
    begins |= kinds == 2
    begins &= kinds > 0
    marks = np.flatnonzero((raw == 39) & begins)
    if len(marks):
        after = np.append(raw, np.zeros(3, np.uint8))
        one = np.isin(after[marks + 1], _ENDINGS_1)
        two = np.isin(after[marks + 1].astype(np.uint16) << 8 | after[marks + 2], _ENDINGS_2)
        begins[marks[one | two] + 1] = False
        rest = np.concatenate([marks[one] + 2, marks[two] + 3])
        rest = rest[rest < len(raw)]
        begins[rest] = kinds[rest] > 0
    return kinds, begins


@cache
def _rules(path: str) -> list[str]:
    """The splitting patterns that a tokenizer's file names."""
    with open(path, encoding="utf-8") as f:
        kinds = (json.load(f).get("pre_tokenizer") or {}).get("pretokenizers", [])
    return [k["pattern"].get("Regex", "") for k in kinds if "pattern" in k]


# Fixed value: the splitting rule of the tokenizer that piece_starts spells for Latin-1.
_RULE = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_WORD_END = "</w>"
_CHUNK = b"\x00"
_ENDINGS_1 = np.frombuffer(b"stmd", np.uint8)
_ENDINGS_2 = np.frombuffer(b"revell", ">u2").astype(np.uint16)
_LOWER = bytes(b + 32 if 65 <= b <= 90 or (192 <= b <= 222 and b != 215) else b for b in range(256))
_KINDS_OF = np.array(
    [0 if chr(b) in "\t\n\r " else 1 if chr(b).isalpha() else 2 if chr(b).isnumeric() else 3 for b in range(256)], dtype=np.uint8
)
# Control characters and odd spaces; texts with these, or with special tokens, go in chunks.
_NOT_PLAIN = bytes(b for b in range(256) if (b < 32 and b not in b"\t\n\r") or 127 <= b <= 160)
_pieces: dict[tuple[str, str], _Pieces] = {}


def token_ids(texts: list[str | None], path: str, kind: str, end: int | None = END) -> list[bytes]:
    """Ids of whole texts as numbers of ``kind``."""
    if (path, kind) not in _pieces:
        _pieces[path, kind] = _Pieces(path, kind)
    tail = b"" if end is None else np.array([end], dtype=kind).tobytes()
    return [ids + tail for ids in _pieces[path, kind].encode([t or "" for t in texts])]


def id_kind(path: str) -> str:
    """Little-endian 16-bit numbers if the ids fit, else 32-bit ones."""
    return "<u2" if _tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def tokenised(docs: DataFrame, path: str, kind: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """(doc_id, ids) of each row."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                packed = pa.array(token_ids(batch.column(1).to_pylist(), path, kind, end), pa.binary())
                yield pa.record_batch([batch.column(0), packed], names=["doc_id", "ids"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"))
    return source.mapInArrow(run, "doc_id long, ids binary")


def token_documents(tokens: DataFrame, kind: str) -> tuple[np.ndarray, int]:
    """In how many documents each token id occurs, and the number of documents; one number per
    token of the vocabulary, whatever the size of the corpus."""

    def run(batches):
        counts, n = np.zeros(1 << 16, dtype=np.int64), 0
        held = np.zeros(len(counts), dtype=bool)
        for batch in batches:
            n += batch.num_rows
            for raw in batch.column(0).to_pylist():
                ids = np.frombuffer(raw, kind)
                if kind != "<u2" and ids.max() >= len(counts):
                    more = np.zeros(int(ids.max()), dtype=np.int64)
                    counts, held = np.concatenate([counts, more]), np.concatenate([held, more > 0])
                held[ids] = True
                some = np.flatnonzero(held)
                counts[some] += 1
                held[some] = False
        some = np.flatnonzero(counts)
        ids = np.concatenate([some, [-1]])
        yield pa.record_batch([pa.array(ids), pa.array(np.concatenate([counts[some], [n]]))], names=["token", "n"])

    rows = tokens.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    by = dict(zip(rows["token"], rows["n"]))
    total = int(by.pop(-1, 0))
    counts = np.zeros(max(by, default=0) + 1, dtype=np.int64)
    counts[list(by)] = list(by.values())
    return counts, total


class Shard:
    """The inverted index over the document rests of one shard, and its greedy packing."""

    def __init__(self, docs: list[tuple[int, int, np.ndarray]], idf: np.ndarray, window: int):
        """docs: (number, start, ids) with fewer ids than a window each."""
        self.docs, self.window = docs, window
        self.left = np.array([len(ids) for _, _, ids in docs])
        self.taken = np.zeros(len(docs), dtype=np.int64)
        terms, freqs = zip(*(np.unique(ids, return_counts=True) for _, _, ids in docs)) if docs else ((), ())
        self.terms = terms
        sizes = np.array([len(t) for t in terms], dtype=np.int64)
        if not len(sizes):
            return
        owner, term, tf = np.repeat(np.arange(len(docs)), sizes), np.concatenate(terms), np.concatenate(freqs)
        norm = K1 * (1 - B + B * self.left / self.left.mean())
        weight = (idf[term] * tf * (K1 + 1) / (tf + norm[owner])).astype(np.float32)
        order = np.argsort(term, kind="stable")
        self.owner, self.weight = owner[order], weight[order]
        self.vocabulary, self.first = np.unique(term[order], return_index=True)
        self.last = np.append(self.first[1:], len(term))

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused documents by falling score for the seed's words, all others after them."""
        at = np.searchsorted(self.vocabulary, self.terms[seed])
        lengths = self.last[at] - self.first[at]
        ends = np.cumsum(lengths)
        places = np.arange(ends[-1]) + np.repeat(self.first[at] - ends + lengths, lengths)
        score = np.bincount(self.owner[places], weights=self.weight[places], minlength=len(self.docs))
        unused = np.flatnonzero(self.left > 0)
        return unused[np.argsort(-score[unused], kind="stable")]

    def sequences(self):
        """Lists of (number, start, ids), each list one sequence."""
        seed, pool = 0, int(self.left.sum())
        while pool >= self.window:
            while not self.left[seed]:
                seed += 1
            row, room = [self._take(seed, self.window)], 0
            room = self.window - len(row[0][2])
            if room:
                for other in self.neighbours(seed).tolist():
                    row.append(self._take(other, room))
                    room -= len(row[-1][2])
                    if not room:
                        break
            pool -= self.window
            yield row
        size = 1 << max(pool.bit_length() - 1, 0)
        rest = iter(np.flatnonzero(self.left).tolist())
        at = next(rest, None)
        while at is not None:
            while size > pool:
                size >>= 1
            row, room = [], size
            while room:
                row.append(self._take(at, room))
                room -= len(row[-1][2])
                if not self.left[at]:
                    at = next(rest, None)
            pool -= size
            yield row

    def _take(self, k: int, most: int) -> tuple[int, int, np.ndarray]:
        number, start, ids = self.docs[k]
        at = int(self.taken[k])
        piece = ids[at : at + most]
        self.taken[k] += len(piece)
        self.left[k] -= len(piece)
        return number, start + at, piece


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    tokenizer: str | None = None,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit), ids_crc32, doc_tokens,
    sequence_id, offset. Sequences have ``window`` ids, or a lower power of two.

    A null or empty text is its end token alone. Null doc_ids are kept as they are, repeated rows
    are packed one by one, other columns are ignored, and an empty table gives an empty result."""
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    kind = id_kind(path)
    tokens = stage(tokenised(docs, path, kind, id_col, text_col), "tokens")
    counts, total = token_documents(tokens, kind)
    idf = np.log1p((total - counts + 0.5) / (counts + 0.5))
    shared = docs.sparkSession.sparkContext.broadcast(idf.astype(np.float32))

    def run(batches):
        base, made = TaskContext.get().partitionId() << 33, 0
        held, rests, n_held = [], [], 0

        def flush():
            nonlocal made
            rows = []
            for sequence in full():
                offset = 0
                for number, start, ids in sequence:
                    raw = ids.astype("<u4").tobytes()
                    doc_id, n = held[number]
                    rows.append((doc_id, start, len(ids), raw, zlib.crc32(raw), n, base + made, offset))
                    offset += len(ids)
                made += 1
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), KINDS)], names=NAMES)

        def full():
            for number, ids in rests:
                for at in range(0, len(ids) - window + 1, window):
                    yield [(number, at, ids[at : at + window])]
            tails = [(number, cut := len(ids) // window * window, ids[cut:]) for number, ids in rests]
            yield from Shard([t for t in tails if len(t[2])], shared.value, window).sequences()

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(raw, kind)
                rests.append((len(held), ids))
                held.append((doc_id, len(ids)))
                n_held += len(ids)
                if n_held >= shard_tokens:
                    yield from flush()
                    held, rests, n_held = [], [], 0
        if held:
            yield from flush()

    return tokens.mapInArrow(run, SCHEMA)


NAMES = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
SCHEMA = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
