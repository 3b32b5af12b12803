"""Toxicity by class-conditional Kneser-Ney models of word pairs.

For each class c, P_c(w | h) = max(n_c(h w) - D, 0) / n_c(h .) + L_c(h) P_c(w) and
P_c(w) = max(m_c(w) - D, 0) / m_c + L_c P(w). n_c(h w) counts the rows of the class that hold the pair, so
that a burst in one text is one event, and n_c(h .) sums the pairs that begin with h. m_c(w) is the
continuation count: the different words that w follows in the class. P(w) is shared by both classes: w's
share of the different pairs of all rows. The start of a text is a left context as well, so each word has one.
L is what discounting leaves. Discounts and totals are taken from all counts of all training rows,
before anything is pruned; no word or pair is left out for being rare.

A word or pair whose rows differ between the classes no more than chance would have it
(likelihood-ratio statistic below LEAST_G) is pruned, and backs off by the same formulas: its discounted
part goes to L, a pair to its words and a word to the shared P(w). So any pruned word, and any word that was
never seen, weighs log L_t / L_o, and any such pair adds log L_t(h) / L_o(h) to its word. A document's
log-likelihood ratio is thus a sum of weights of its words and kept pairs.

Counts grow with the rows. Words are 32-bit hashes. A document has two ratios: that of its words by P_c(w) and
the whole one by P_c(w | h). Per word and per root of the words they are turned into a probability by a logistic
fit on rows that the models have not seen.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import alnum_words, slices, stage

FOLDS = 5  # fold 0 is held out, fold FOLDS - 1 calibrates, the others train
MAX_LABELS = 2_000_000  # labels broadcast at most; beyond, texts are joined by a shuffle
MAX_WEIGHTS = 4_000_000  # weights broadcast at most; beyond, words are joined by a shuffle
LEAST_G = 10.0
START = 0  # stands before the first word of a text; crc32 of no bytes
LEAST_WEIGHT = 1e-3  # this and the next two: of ``weights`` only
LEAST_DOCS = 5
LEAST_PAIRS = 4
_WORD, _PAIR, _ROWS, _CONTEXT = range(4)


def word_codes(text: str | None) -> np.ndarray:
    crc = zlib.crc32
    return np.array([crc(w) for w in alnum_words(text)], dtype=np.uint64)


def pairs(codes: np.ndarray) -> np.ndarray:
    return codes[:-1] << np.uint64(32) | codes[1:]


def started(codes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.array([START], np.uint64), codes]) if len(codes) else codes


def fold(id_col):
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def training_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(doc_id, toxic) once per document; several labels count as toxic if one of them is."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    return known.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("toxic"))


def _sized(df: DataFrame, limit: int) -> DataFrame:
    """Marked for broadcast if it has at most ``limit`` rows; df is a written table."""
    return F.broadcast(df) if df.count() <= limit else df


def count_ngrams(train: DataFrame, start: bool = False) -> DataFrame:
    """(kind, key, t, o): the toxic and ordinary rows that hold each word and each pair of words, the
    sums over the pairs of each first word, and all rows. With ``start``, START and the first word are a
    pair too. Counts are combined in the worker and again before the shuffle."""

    def table(kind, keys, toxic):
        each, inverse = np.unique(keys, return_inverse=True)
        t = np.bincount(inverse, weights=toxic, minlength=len(each)).astype(np.int64)
        o = np.bincount(inverse, minlength=len(each)) - t
        columns = [np.full(len(each), kind, dtype=np.int32), each.view(np.int64), t, o]
        return pa.record_batch([pa.array(c) for c in columns], names=["kind", "key", "t", "o"])

    def run(batches):
        for batch in slices(batches, 2000):
            toxic = np.asarray(batch.column(1)) > 0
            codes = [word_codes(t) for t in batch.column(0).to_pylist()]
            twos = [np.unique(pairs(started(c) if start else c)) for c in codes]
            for kind, held in (
                (_WORD, [np.unique(c) for c in codes]),
                (_PAIR, twos),
                (_CONTEXT, [p >> np.uint64(32) for p in twos]),
                (_ROWS, [np.zeros(1, np.uint64) for _ in codes]),
            ):
                if sum(map(len, held)):
                    yield table(kind, np.concatenate(held), np.repeat(toxic, [len(h) for h in held]))

    counted = train.select("text", "toxic").mapInArrow(run, "kind int, key long, t long, o long")
    return counted.groupBy("kind", "key").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def weights(train: DataFrame) -> DataFrame:
    """As ``kneser_ney``, which ``score`` uses, but of a plainer model: P_c(w) and P(w) are of the rows that hold
    w, not of its left contexts, words of fewer than LEAST_DOCS rows and pairs of fewer than LEAST_PAIRS
    are outside, and pruned words weigh nothing."""
    seen = Observation()
    word, pair = F.col("kind") == _WORD, F.col("kind") == _PAIR
    n = F.col("t") + F.col("o")
    enough = (word & (n >= LEAST_DOCS)) | (F.col("kind").isin(_PAIR, _CONTEXT) & (n >= LEAST_PAIRS)) | (F.col("kind") == _ROWS)
    ones = [F.count_if(pair & (F.col(c) == k)).alias(f"p_{c}{k}") for c in "to" for k in (1, 2)]
    kept = stage(count_ngrams(train).observe(seen, *ones).where(enough), "ngrams")
    once = [F.count_if(word & (F.col(c) == k)).alias(f"w_{c}{k}") for c in "to" for k in (1, 2)]
    sums = [F.sum(F.when(word, F.col(c))).alias(f"n_{c}") for c in "to"]
    rows = [F.sum(F.when(F.col("kind") == _ROWS, F.col(c))).alias(f"rows_{c}") for c in "to"]
    m = {k: v or 0 for k, v in (seen.get | kept.agg(*once, *sums, *rows).first().asDict()).items()}

    def discount(name, c):
        one, two = m[f"{name}_{c}1"], m[f"{name}_{c}2"]
        return min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.5

    def less(name, c):
        return F.greatest(F.col(c) - F.lit(discount(name, c)), F.lit(0.0))

    share = m["rows_t"] / max(m["rows_t"] + m["rows_o"], 1)
    if not 0 < share < 1:
        return kept.where("false").select("kind", "key", F.lit(0.0).alias("first"), F.lit(0.0).alias("second"))

    def part(c, p):
        return F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (n * p))).otherwise(F.lit(0.0))

    telling = 2 * (part("t", share) + part("o", 1 - share)) >= LEAST_G
    left = kept.where(word).agg(*[F.sum(F.least(F.col(c).cast("double"), F.lit(discount("w", c)))).alias(c) for c in "to"]).first()
    chance = {
        c: less("w", c) / float(m[f"n_{c}"] or 1)
        + F.lit(left[c] / m[f"n_{c}"] if m[f"n_{c}"] else 1.0) * n / float(m["n_t"] + m["n_o"] or 1)
        for c in "to"
    }
    words = kept.where(word).select(
        F.col("key").alias("word"), telling.alias("telling"), *[chance[c].alias(f"chance_{c}") for c in "to"]
    )
    twos = kept.where(pair & telling).select(
        F.shiftrightunsigned("key", 32).alias("context"),
        F.col("key").bitwiseAND(0xFFFFFFFF).alias("word"),
        "key",
        *[less("p", c).alias(f"p_{c}") for c in "to"],
    )
    used = twos.groupBy(F.col("context").alias("word")).agg(*[F.sum(f"p_{c}").alias(f"used_{c}") for c in "to"])
    begun = kept.where(F.col("kind") == _CONTEXT).select(F.col("key").alias("word"), *[F.col(c).alias(f"h_{c}") for c in "to"])

    def backoff(c):
        rest = 1 - F.coalesce(F.col(f"used_{c}"), F.lit(0.0)) / F.col(f"h_{c}")
        return F.when(F.col(f"h_{c}") > 0, rest).otherwise(F.lit(1.0))

    words = stage(words.join(begun, "word", "left").join(used, "word", "left").withColumns({f"rest_{c}": backoff(c) for c in "to"}), "words")
    ratio = F.log(F.col("rest_t") / F.col("rest_o"))
    own = F.when(F.col("telling"), F.log(F.col("chance_t") / F.col("chance_o"))).otherwise(F.lit(0.0))
    singles = words.select(F.lit(_WORD).alias("kind"), F.col("word").alias("key"), ratio.alias("first"), own.alias("second"))
    contexts = words.select(F.col("word").alias("context"), *[f"h_{c}" for c in "to"], *[f"rest_{c}" for c in "to"])
    full = {
        c: F.when(F.col(f"h_{c}") > 0, F.col(f"p_{c}") / F.col(f"h_{c}")).otherwise(F.lit(0.0)) + F.col(f"rest_{c}") * F.col(f"chance_{c}")
        for c in "to"
    }
    joined = twos.join(contexts, "context").join(words.select("word", "telling", "chance_t", "chance_o"), "word")
    extra = F.log(full["t"] / full["o"]) - ratio - own
    doubles = joined.select(F.lit(_PAIR).alias("kind"), "key", extra.alias("first"), F.lit(0.0).alias("second"))
    told = (F.abs("first") >= LEAST_WEIGHT) | (F.abs("second") >= LEAST_WEIGHT)
    return singles.unionByName(doubles).where(told)


def _telling(share: float):
    """Whether a row's counts t and o differ from ``share`` by more than chance."""
    n = F.col("t") + F.col("o")

    def part(c, p):
        return F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (n * p))).otherwise(F.lit(0.0))

    return 2 * (part("t", share) + part("o", 1 - share)) >= LEAST_G


def _discount(one: int, two: int) -> float:
    return min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.5


def kneser_ney(train: DataFrame) -> DataFrame:
    """(kind, key, first, second), the weights of the models that the module describes: for a word its weight
    as a context and as itself, for a kept pair what it adds to those of its words, and one row of kind
    _ROWS for what every word weighs, known or not, to which a word's own weight is added. Empty unless
    there are rows of both classes."""
    seen = Observation()
    word, pair, context = (F.col("kind") == k for k in (_WORD, _PAIR, _CONTEXT))
    ones = [F.count_if(pair & (F.col(c) == k)).alias(f"p_{c}{k}") for c in "to" for k in (1, 2)]
    rows = [F.sum(F.when(F.col("kind") == _ROWS, F.col(c))).alias(f"rows_{c}") for c in "to"]
    ngrams = stage(count_ngrams(train, start=True).observe(seen, *ones, *rows), "ngrams")
    m = {k: v or 0 for k, v in seen.get.items()}
    share = m["rows_t"] / max(m["rows_t"] + m["rows_o"], 1)
    if not 0 < share < 1:
        return ngrams.where("false").select("kind", "key", F.lit(0.0).alias("first"), F.lit(0.0).alias("second"))

    # A word's rows, its different left contexts (m_t, m_o; m of all rows), and its pairs as a context.
    of = F.when(pair, F.col("key").bitwiseAND(0xFFFFFFFF)).otherwise(F.col("key")).alias("word")
    words = ngrams.where(F.col("kind") != _ROWS).groupBy(of).agg(
        *[F.coalesce(F.sum(F.when(word, F.col(c))), F.lit(0)).alias(c) for c in "to"],
        *[F.count_if(pair & (F.col(c) > 0)).alias(f"m_{c}") for c in "to"],
        F.count_if(pair).alias("m"),
        *[F.coalesce(F.sum(F.when(context, F.col(c))), F.lit(0)).alias(f"h_{c}") for c in "to"],
    )
    words = stage(words.withColumn("telling", F.coalesce(_telling(share), F.lit(False)) & (F.col("m") > 0)), "words")
    once = [F.count_if(F.col(f"m_{c}") == k).alias(f"m_{c}{k}") for c in "to" for k in (1, 2)]
    sums = [F.sum(c).alias(c) for c in ("m", "m_t", "m_o")]
    apart = [F.sum(F.when(F.col("telling"), F.col(f"m_{c}"))).alias(f"kept_{c}") for c in "to"]
    types = [F.count_if(F.col("telling") & (F.col(f"m_{c}") > 0)).alias(f"types_{c}") for c in "to"]
    m |= {k: v or 0 for k, v in words.agg(*once, *sums, *apart, *types).first().asDict().items()}
    d_word = {c: _discount(m[f"m_{c}1"], m[f"m_{c}2"]) for c in "to"}
    d_pair = {c: _discount(m[f"p_{c}1"], m[f"p_{c}2"]) for c in "to"}
    left = {c: 1 - (m[f"kept_{c}"] - d_word[c] * m[f"types_{c}"]) / max(m[f"m_{c}"], 1) for c in "to"}
    base = math.log(left["t"] / left["o"])

    def less(column, d):
        return F.greatest(F.col(column) - F.lit(d), F.lit(0.0))

    def chance(c):
        own = F.when(F.col("telling"), less(f"m_{c}", d_word[c]) / float(max(m[f"m_{c}"], 1))).otherwise(F.lit(0.0))
        return (own + F.lit(left[c]) * F.col("m") / float(max(m["m"], 1))).alias(f"chance_{c}")

    def rest(c):
        part = 1 - F.coalesce(F.col(f"used_{c}"), F.lit(0.0)) / F.col(f"h_{c}")
        return F.when(F.col(f"h_{c}") > 0, part).otherwise(F.lit(1.0)).alias(f"rest_{c}")

    twos = ngrams.where(pair & _telling(share)).select(
        F.shiftrightunsigned("key", 32).alias("context"),
        F.col("key").bitwiseAND(0xFFFFFFFF).alias("word"),
        "key",
        *[less(c, d_pair[c]).alias(f"p_{c}") for c in "to"],
    )
    used = twos.groupBy(F.col("context").alias("word")).agg(*[F.sum(f"p_{c}").alias(f"used_{c}") for c in "to"])
    told = words.join(used, "word", "left").where(F.col("telling") | F.col("used_t").isNotNull())
    told = told.select("word", "telling", *[chance(c) for c in "to"], *[f"h_{c}" for c in "to"], *[rest(c) for c in "to"])
    told = stage(told, "told")
    ratio = F.log(F.col("rest_t") / F.col("rest_o"))
    own = F.log(F.col("chance_t") / F.col("chance_o"))
    singles = told.select(
        F.lit(_WORD).alias("kind"),
        F.col("word").alias("key"),
        ratio.alias("first"),
        F.when(F.col("telling"), own - F.lit(base)).otherwise(F.lit(0.0)).alias("second"),
    )
    contexts = told.select(F.col("word").alias("context"), *[f"h_{c}" for c in "to"], *[f"rest_{c}" for c in "to"])
    joined = twos.join(contexts, "context").join(words.select("word", *[chance(c) for c in "to"]), "word")
    full = {
        c: F.when(F.col(f"h_{c}") > 0, F.col(f"p_{c}") / F.col(f"h_{c}")).otherwise(F.lit(0.0)) + F.col(f"rest_{c}") * F.col(f"chance_{c}")
        for c in "to"
    }
    extra = F.log(full["t"] / full["o"]) - ratio - own
    doubles = joined.select(F.lit(_PAIR).alias("kind"), "key", extra.alias("first"), F.lit(0.0).alias("second"))
    every = ngrams.where(F.col("kind") == _ROWS).select("kind", "key", F.lit(0.0).alias("first"), F.lit(base).alias("second"))
    return singles.unionByName(doubles).unionByName(every)


class Weights:
    """Sorted arrays of the weights, for lookups of whole documents at once."""

    def __init__(self, rows: pa.Table):
        kind, key = np.asarray(rows["kind"]), np.asarray(rows["key"]).view(np.uint64)
        first, second = (np.asarray(rows[c]).astype(np.float64) for c in ("first", "second"))
        w, p = (np.flatnonzero(kind == k)[np.argsort(key[kind == k])] for k in (_WORD, _PAIR))
        self.words, self.context, self.own = key[w], first[w], second[w]
        self.pairs, self.extra = key[p], first[p]
        self.every = float(second[kind == _ROWS].sum())

    def parts(self, codes: np.ndarray) -> tuple[float, float]:
        """The log-likelihood ratio of a document's words by themselves, and what their contexts add to it."""
        alone, added, before = self.every * len(codes), 0.0, started(codes)
        if len(codes) and len(self.words):
            at = np.minimum(np.searchsorted(self.words, before), len(self.words) - 1)
            known = self.words[at] == before
            alone += float((self.own[at] * known)[1:].sum())
            added += float((self.context[at] * known)[:-1].sum())
        if len(codes) and len(self.pairs):
            keys = pairs(before)
            at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            added += float((self.extra[at] * (self.pairs[at] == keys)).sum())
        return alone, added

    def ratio(self, codes: np.ndarray) -> float:
        """The log-likelihood ratio of a document."""
        return sum(self.parts(codes))


def ratios(docs: DataFrame, table: DataFrame, max_weights: int = MAX_WEIGHTS) -> DataFrame:
    """(doc_id, n, alone, ratio) of each row: the ratio of its words by themselves and the whole one. The
    weights are broadcast if there are at most ``max_weights``; else each document's different words and
    pairs are joined to them."""
    if table.count() <= max_weights:
        shared = docs.sparkSession.sparkContext.broadcast(Weights(table.toArrow()))

        def run(batches):
            for batch in slices(batches):
                codes = [word_codes(text) for text in batch.column(1).to_pylist()]
                parts = np.array([shared.value.parts(c) for c in codes]).reshape(-1, 2)
                n = pa.array([len(c) for c in codes], pa.int64())
                columns = [batch.column(0), n, pa.array(parts[:, 0]), pa.array(parts.sum(axis=1))]
                yield pa.record_batch(columns, names=["doc_id", "n", "alone", "ratio"])

        return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, alone double, ratio double")

    def explode(batches):
        for batch in slices(batches):
            for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                codes = word_codes(text)
                before = started(codes)
                each, inverse = np.unique(before, return_inverse=True)
                first, own = (np.bincount(i, minlength=len(each)) for i in (inverse[:-1], inverse[1:]))
                twos, n_twos = np.unique(pairs(before), return_counts=True)
                # A row of its own for the document, to which what every word weighs is joined.
                keys = np.concatenate([each, twos, np.zeros(1, np.uint64)]).view(np.int64)
                size = len(keys)
                kinds = np.concatenate([np.full(len(each), _WORD), np.full(len(twos), _PAIR), [_ROWS]]).astype(np.int32)
                yield pa.record_batch(
                    [
                        pa.array(np.full(size, row)),
                        pa.array([doc_id] * size, pa.int64()),
                        pa.array(np.full(size, len(codes))),
                        pa.array(kinds),
                        pa.array(keys),
                        pa.array(np.concatenate([first, n_twos, [0]]).astype(np.int64)),
                        pa.array(np.concatenate([own, n_twos * 0, [len(codes)]]).astype(np.int64)),
                    ],
                    names=["row", "doc_id", "n", "kind", "key", "x", "y"],
                )

    source = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    grams = source.mapInArrow(explode, "row long, doc_id long, n long, kind int, key long, x long, y long")
    joined = grams.join(table, ["kind", "key"], "left")
    alone = F.sum(F.coalesce(F.col("y") * F.col("second"), F.lit(0.0)))
    added = F.sum(F.coalesce(F.col("x") * F.col("first"), F.lit(0.0)))
    return joined.groupBy("row", "doc_id", "n").agg(alone.alias("alone"), (alone + added).alias("ratio")).drop("row")


def signals():
    """What the logistic fit sees: both ratios per word and per root of the words."""
    n = F.greatest(F.col("n"), F.lit(1))
    return [x for c in ("alone", "ratio") for x in (F.col(c) / n * 20, F.col(c) / F.sqrt(n))]


def calibrate(points: DataFrame) -> tuple[float, list[float]]:
    """The share of label 1, and bias and slopes of a logistic fit to rows of (x0, x1, ..., label), by damped
    Newton steps whose sums Spark takes. Slopes below zero are taken out, the least first, so that a score never falls as a ratio rises."""
    m = points.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic")).first()
    size, share = len(points.columns), (m["toxic"] or 0) / max(m["n"], 1)
    if not 0 < share < 1:
        return share, [-3.0 if share < 0.5 else 3.0] + [0.0] * (size - 1)
    x = [F.lit(1.0), *[F.col(f"x{i}") for i in range(size - 1)]]
    w, use = np.zeros(size), list(range(size))
    while True:
        for _ in range(50):
            z = sum((F.lit(float(w[i])) * x[i] for i in use[1:]), F.lit(float(w[0])))
            p = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
            slope = [F.sum(x[i] * (F.col("label") - F.col("p"))) for i in use]
            bend = [F.sum(x[i] * x[j] * F.col("p") * (1 - F.col("p"))) for i in use for j in use if j <= i]
            got = points.withColumn("p", p).agg(*[c.alias(f"s{k}") for k, c in enumerate(slope + bend)]).first()
            hessian = np.zeros((len(use), len(use)))
            hessian[np.tril_indices(len(use))] = got[len(use) :]
            hessian += np.tril(hessian, -1).T + 1e-3 * np.eye(len(use))
            step = np.linalg.solve(hessian, np.array(got[: len(use)]) - 1e-3 * w[use])
            step *= min(1.0, 5 / max(np.abs(step).max(), 1e-9))
            w[use] += step
            if np.abs(step).max() < 1e-8:
                break
        least = min(use[1:], key=lambda i: w[i], default=0)
        if not least or w[least] >= 0:
            return share, w.tolist()
        use.remove(least)
        w[least] = 0.0


def score(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_labels: int = MAX_LABELS,
    max_weights: int = MAX_WEIGHTS,
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Rows of fold 0 (crc32 of the id as text, modulo 5) teach nothing. Null and texts without
    words tell nothing and score the share of toxic rows; rows without doc_id are held out. Repeated
    rows are scored alike and, if labelled, counted each time. Other columns are ignored. Without
    labels, or with one class only, all documents get that class's side."""
    known = _sized(stage(training_labels(labels, id_col, label_col), "labels"), max_labels)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    part = fold(F.col("doc_id"))
    train = rows.where((part > 0) & (part < FOLDS - 1)).join(known, "doc_id").select("text", "toxic")
    table = stage(kneser_ney(train), "weights")
    scored = stage(ratios(rows, table, max_weights), "ratios")
    bounded = [F.greatest(F.least(x, F.lit(40.0)), F.lit(-20.0)).alias(f"x{i}") for i, x in enumerate(signals())]
    points = scored.where((part == FOLDS - 1) & (F.col("n") > 0)).join(known, "doc_id")
    points = stage(points.select(*bounded, (F.col("toxic") > 0).cast("int").alias("label")), "points")
    share, (bias, *slopes) = calibrate(points)
    z = sum((F.lit(w) * x for w, x in zip(slopes, signals())), F.lit(bias))
    probability = F.when(F.col("n") > 0, 1 / (1 + F.exp(-z))).otherwise(F.lit(float(share)))
    return scored.select(
        "doc_id",
        (F.col("doc_id").isNull() | (part == 0)).alias("held_out"),
        probability.alias("score"),
        (probability >= 0.5).cast("int").alias("predicted"),
    )
