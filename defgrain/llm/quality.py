"""Quality without hand-made labels: overlapping heuristic labellers, an expectation-maximisation
estimate of how far each can be trusted, and a hashed linear scorer trained on the posteriors.

Each labeller votes good or bad, is undecided, or gives no vote. Votes form a pattern; with m
labellers there are at most 4^m patterns, so the counts of all documents fit on the driver whatever the corpus.
Expectation-maximisation runs on these counts. The scorer is fitted on a bounded sample and applied
to every document in the pass that reads it.
"""

from __future__ import annotations

import zlib
from collections import Counter
from functools import lru_cache
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

DIM = 1 << 12
SAMPLE = 2000  # documents of each side of the posterior that the scorer is fitted on
ROUNDS = 60

LABELLERS = ("upper", "symbols", "marked_words", "top_word", "repeats", "echo", "word_length", "lone_symbols", "letters")
MISSING = 2
FALSE_ALARMS = 0.01  # share of good documents that a labeller may call bad
MAX_PRAISE = 0.5  # log odds that a vote other than bad may add
_SYMBOLS = bytes(range(33, 39)) + b"*+/<=>@[\\]^_`{|}~"
_LONE = {bytes([b]) for b in _SYMBOLS + b"-.:;,"}
_NOT_LETTERS = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122 or b >= 192))
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_NOT_ASCII_LETTERS = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122))
_LATER_BYTES = bytes(range(128, 192))  # of characters beyond ASCII, whose first byte is 192 or more
_PLAIN = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))


def _vote(value: float, good: float, bad: float) -> int:
    """Good up to ``good``, bad from ``bad``, nothing between."""
    return 1 if value <= good else -1 if value >= bad else 0


def votes(text: str | None) -> list[int]:
    """One vote per labeller: good (1), bad (-1), undecided (0), or missing (2) if the text is too
    short for the labeller. An empty text has no votes at all."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    n = len(words)
    if not n:
        return [MISSING] * len(LABELLERS)
    upper = len(raw.translate(None, _NOT_UPPER))
    ascii_letters = len(raw.translate(None, _NOT_ASCII_LETTERS))
    letters = len(raw.translate(None, _NOT_LETTERS))
    dense = sum(map(len, words))
    seen = len(b"".join(words).translate(None, _LATER_BYTES))  # characters but white space
    symbols = dense - len(raw.translate(None, _SYMBOLS)) + len(raw) - dense
    out = [_vote(upper / max(ascii_letters, 1), 0.25, 0.6), _vote(symbols / max(dense, 1), 0.015, 0.06)]
    if n < 5:
        return out + [MISSING] * (len(LABELLERS) - 2)
    counts = Counter(words)
    marked = sum(c for w, c in counts.items() if len(w) > 2 and w[-1] in _SYMBOLS and w[-2] in _SYMBOLS)
    out.append(_vote(marked / n, 0.02, 0.15))
    out.append(_vote(max(counts.values()) / n, 0.15, 0.3) if n >= 20 else MISSING)
    if n >= 30:
        grams = set(zip(words, words[1:], words[2:], words[3:]))
        out.append(_vote(1 - len(grams) / (n - 3), 0.1, 0.4))
    else:
        out.append(MISSING)
    echo = sum(map(eq, words, islice(words, 1, None))) / n
    out.append(_vote(echo, 0.02, 0.05) if n >= 20 else _vote(echo, 0.15, 0.3))
    mean = seen / n
    out.append(1 if 2.5 <= mean <= 12 else -1 if mean < 1.5 or mean > 20 else 0)
    out.append(_vote(sum(counts[w] for w in _LONE if w in counts) / n, 0.02, 0.15) if n >= 20 else MISSING)
    out.append(_vote(1 - letters / max(seen, 1), 0.12, 0.3) if n >= 20 else MISSING)
    return out


def pattern(v: list[int]) -> int:
    out = 0
    for x in v:
        out = out * 4 + x + 1
    return out


def unpack(p: int) -> list[int]:
    out = []
    for _ in LABELLERS:
        out.append(p % 4 - 1)
        p //= 4
    return out[::-1]


@lru_cache(1 << 16)
def _shape(ends: bytes) -> int:
    return zlib.crc32(ends)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed counts of word shapes and pairs of them, as (indexes, weights of unit length). A shape
    is letter case, digits and punctuation at a word's ends, without which letters: it shows how a
    text is written, not what it is about."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0)
    shapes = np.array([_shape(w[:1] + w[-3:]) for w in raw.translate(_PLAIN).split()], dtype=np.int64)
    top = Counter(words)
    # How often words return, in steps; a text is compared with its own length only.
    repeat = min(9, int(10 * (1 - len(top) / n)))
    share = min(9, int(10 * max(top.values()) / n))
    both = (shapes[:-1] * 31 + shapes[1:] * 17) % DIM
    extra = np.repeat([zlib.crc32(b"repeat%d" % repeat) % DIM, zlib.crc32(b"top%d" % share) % DIM], n)
    counts = np.bincount(np.concatenate([shapes % DIM, both, extra]), minlength=DIM)
    at = np.flatnonzero(counts)
    return at, counts[at] / np.sqrt((counts[at].astype(float) ** 2).sum())


def fit_labellers(counts: dict[int, int], rounds: int = ROUNDS) -> dict[int, float]:
    """Posterior probability of good for each vote pattern.

    Two classes; within a class the labellers vote independently, each with its own chances of good,
    bad and neither (smoothed); a missing vote is no evidence. It starts from the view that one bad vote outweighs others, since the
    labellers look for different faults; that also settles which class is good. For the same reason
    a good vote says little (MAX_PRAISE), and labellers are taken to raise few false alarms."""
    if not counts:
        return {}
    table = np.array([unpack(p) for p in counts])
    n = np.array(list(counts.values()), dtype=float)
    worst, any_vote = table.min(axis=1), (np.abs(table) == 1).any(axis=1)
    post = np.where(worst < 0, 0.1, np.where(any_vote, 0.95, 0.5))
    for _ in range(rounds):
        log_odds = np.log((n @ post + 1) / (n @ (1 - post) + 1)) * np.ones(len(n))
        for j in range(table.shape[1]):
            given = table[:, j] != MISSING
            for vote in (-1, 0, 1):
                cast = table[:, j] == vote
                good = (n @ (post * cast) + 0.1) / (n @ (post * given) + 0.3)
                bad = (n @ ((1 - post) * cast) + 0.1) / (n @ ((1 - post) * given) + 0.3)
                if vote < 0:
                    log_odds += cast * np.log(min(good, FALSE_ALARMS) / max(bad, FALSE_ALARMS))
                else:
                    log_odds += cast * np.clip(np.log(good / bad), -MAX_PRAISE, MAX_PRAISE)
        new = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return dict(zip(counts, post.tolist()))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], wanted: np.ndarray, steps: int = 150, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels by accelerated gradient descent, both sides weighted
    alike; DIM weights and a bias."""
    weights = np.zeros(DIM + 1)
    if not rows or wanted.max() < 0.5 or wanted.min() >= 0.5:
        weights[DIM] = 0.0 if not rows else 5.0 if wanted.min() >= 0.5 else -5.0
        return weights
    owner = np.repeat(np.arange(len(rows)), [len(k) for k, _ in rows])
    index = np.concatenate([k for k, _ in rows]).astype(np.int64)
    value = np.concatenate([v for _, v in rows])
    good = wanted >= 0.5
    share = np.where(good, 0.5 / good.sum(), 0.5 / (~good).sum())
    ahead, momentum, rate = weights.copy(), weights.copy(), 8.0
    for step in range(steps):
        z = np.bincount(owner, weights=ahead[index] * value, minlength=len(rows)) + ahead[DIM]
        error = (1 / (1 + np.exp(-z)) - wanted) * share
        gradient = np.append(np.bincount(index, weights=error[owner] * value, minlength=DIM), error.sum())
        gradient[:DIM] += ridge * ahead[:DIM]
        new = ahead - rate * gradient
        ahead = new + step / (step + 3) * (new - momentum)
        momentum = new
    return momentum


class Model:
    """What scoring needs: posteriors by vote pattern and the scorer's weights."""

    def __init__(self, posteriors: dict[int, float], weights: np.ndarray):
        self.posteriors, self.weights = posteriors, weights

    def score(self, text: str | None) -> float:
        at, values = features(text)
        z = self.weights[DIM] + self.weights[at] @ values
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Count the votes of all documents, estimate the labellers, and fit the scorer on at most
    ``sample`` documents of either side, drawn by the hash of their text."""

    def count(batches):
        seen: Counter[int] = Counter()
        for batch in batches:
            seen.update(pattern(votes(t)) for t in batch.column(0).to_pylist())
        yield pa.record_batch([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["p", "n"])

    text = docs.select(F.col(text_col).cast("string").alias("text"))
    counted = text.mapInArrow(count, "p int, n long").groupBy("p").agg(F.sum("n").alias("n")).collect()
    totals = {r["p"]: r["n"] for r in counted}
    posteriors = fit_labellers(totals)
    side = {p: q >= 0.5 for p, q in posteriors.items()}
    sizes = {s: sum(n for p, n in totals.items() if side[p] == s) for s in (True, False)}
    # Of each side a share that gives about the sample; the rest is cut off by order of the hash.
    shares = {s: min(1.0, 1.2 * sample / max(n, 1) + 50 / max(n, 1)) for s, n in sizes.items()}

    def draw(batches):
        for batch in batches:
            rows = []
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (h % (1 << 32)) / (1 << 32) < max(shares.values()):
                    p = pattern(votes(t))
                    if (h % (1 << 32)) / (1 << 32) < shares[side[p]]:
                        rows.append((h, side[p], posteriors[p], *(x.tolist() for x in features(t))))
            if rows:
                kinds = (pa.int64(), pa.bool_(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float32()))
                yield pa.record_batch(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["h", "good", "wanted", "k", "v"]
                )

    drawn = text.select(F.xxhash64("text").alias("h"), "text").mapInArrow(
        draw, "h long, good boolean, wanted double, k array<int>, v array<float>"
    )
    rows = [r for s in (True, False) for r in drawn.where(F.col("good") == s).orderBy("h", "wanted").limit(sample).collect()]
    weights = fit_scorer([(np.array(r["k"]), np.array(r["v"])) for r in rows], np.array([r["wanted"] for r in rows]))
    return Model(posteriors, weights)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, votes (one sign per labeller: + - 0, or . if missing), posterior, score, keep.

    A document goes if both the posterior of its votes and the scorer reject it; either alone is not
    enough to lose a text. Null and empty texts get no votes and are rejected. Repeated rows score
    alike, other columns are ignored, and an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        rows = [judge(shared.value, t) for t in batch.column(1).to_pylist()]
        kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        return pa.record_batch([batch.column(0), *columns], names=["doc_id", "votes", "posterior", "score", "keep"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    return map_batches(
        source,
        lambda b: run(b) if b.num_rows else None,
        f"doc_id {id_type}, votes string, posterior double, score double, keep boolean",
    )


def judge(model: Model, text: str | None) -> tuple[str, float, float, bool]:
    v = votes(text)
    posterior = model.posteriors.get(pattern(v), 0.5)
    value = model.score(text)
    blank = not text or not text.strip()
    return "".join("-0+."[x + 1] for x in v), posterior, value, not blank and (posterior >= 0.5 or value >= 0.5)


def keep_good(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The input with all its columns, without the documents that are rejected. One narrow pass
    after fitting; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, text_col, sample))
    at = docs.columns.index(text_col)

    def run(batch):
        return batch.filter(pa.array([judge(shared.value, t)[3] for t in batch.column(at).to_pylist()], pa.bool_()))

    return map_batches(docs, run, docs.schema)


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    return score(docs, fit(docs, text_col, sample), id_col, text_col)


