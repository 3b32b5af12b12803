import zlib

import numpy as np
import pytest

from defgrain.llm import toxicity as t


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(3)
    plain = [f"w{k}" for k in range(150)]
    rows, labels = [], []
    for i in range(600):
        words = rng.choice(plain, rng.integers(20, 80)).tolist()
        toxic = int(i % 6 == 0)
        if toxic:
            for _ in range(3):
                words.insert(int(rng.integers(len(words))), str(rng.choice(["nasty", "vile", "awful"])))
        rows.append((i, " ".join(words), toxic, "x"))
        labels.append((i, 1, toxic))
    rows += [(1000, None, 0, "x"), (1001, "", 0, "x"), (1002, "nasty", 0, "x"), (None, "vile vile", 0, "x"), (3, rows[3][1], 0, "x")]
    labels += [(6, 1, 1), (1002, None, None), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, ratio string").repartition(4)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def auc(pairs):
    bad = np.array([s for s, y in pairs if y])
    good = np.array([s for s, y in pairs if not y])
    return np.mean([(good < b).mean() + 0.5 * (good == b).mean() for b in bad])


def test_scores_and_folds(spark, small):
    docs, labels = small
    got = t.score(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        want = r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        assert r["held_out"] == want and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    assert auc([(r["score"], r["doc_id"] % 6 == 0) for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]) > 0.97
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[1000] == by[1001] < 0.5 < by[1002] and by[None] > 0.5


def test_join_equals_broadcast(spark, small):
    docs, labels = small
    a = sorted(((r["doc_id"] or -1), round(r["score"], 6)) for r in t.score(docs, labels).collect())
    b = sorted(((r["doc_id"] or -1), round(r["score"], 6)) for r in t.score(docs, labels, max_labels=0, max_weights=0).collect())
    assert a == b


def test_held_out_labels_teach_nothing(spark, small):
    docs, labels = small
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(t.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = sorted(((r["doc_id"] or -1), r["score"]) for r in t.score(docs, labels).collect())
    b = sorted(((r["doc_id"] or -1), r["score"]) for r in t.score(docs, turned).collect())
    assert np.allclose(a, b)


def test_ratio_is_the_sum_of_model_ratios(spark, small):
    docs, labels = small
    train = docs.drop("toxic").join(t.training_labels(labels, "doc_id", "toxic"), "doc_id").select("text", "toxic")
    table = t.weights(train)
    model = t.Weights(table.toArrow())
    weights = {(r["kind"], r["key"] & (1 << 64) - 1): (r["first"], r["second"]) for r in table.collect()}
    for text in ("nasty w1 w2 vile", "w5", "zzz nasty zzz", "", "vile awful nasty w7 w7 w7"):
        codes = t.word_codes(text).tolist()
        want = sum(weights.get((0, c), (0, 0))[1] for c in codes) + sum(weights.get((0, c), (0, 0))[0] for c in codes[:-1])
        want += sum(weights.get((1, a << 32 | b), (0, 0))[0] for a, b in zip(codes, codes[1:]))
        assert model.ratio(t.word_codes(text)) == pytest.approx(want, abs=1e-4)
    assert model.ratio(t.word_codes("nasty")) > 2 and abs(model.ratio(t.word_codes("unknown words"))) < 1e-9


@pytest.mark.parametrize("toxic", [0, 1])
def test_one_class_or_no_labels(spark, small, toxic):
    docs, labels = small
    one = labels.where("toxic is not null").selectExpr("doc_id", f"{toxic} as toxic")
    assert {r["predicted"] for r in t.score(docs, one).collect()} == {toxic}
    assert {r["predicted"] for r in t.score(docs, labels.where("false")).collect()} == {0}
    assert t.score(docs.where("false"), labels).count() == 0


def test_held_out_accuracy_on_the_tables(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = t.score(docs, labels).where("held_out").join(labels, "doc_id").select("score", "toxic").collect()
    assert auc([(r["score"], r["toxic"]) for r in got]) > 0.95
    assert np.mean([r["score"] < 0.5 for r in got if not r["toxic"]]) > 0.99
    assert np.mean([r["score"] >= 0.5 for r in got if r["toxic"]]) > 0.85


def dictionary_model(rows):
    """The models as the docstring defines them, with plain dictionaries: a function from texts to
    log-likelihood ratios."""
    from collections import Counter, defaultdict
    from math import log

    one, two, first = ([Counter(), Counter()] for _ in range(3))
    total = [0, 0]
    for text, toxic in rows:
        words = t.word_codes(text).tolist()
        total[toxic] += 1
        one[toxic].update(set(words))
        held = set(zip(words, words[1:]))
        two[toxic].update(held)
        first[toxic].update(a for a, _ in held)

    def inside(counts, least):
        return {k for k in set(counts[0]) | set(counts[1]) if counts[0][k] + counts[1][k] >= least}

    def discount(values):
        a, b = (sum(v == k for v in values) for k in (1, 2))
        return min(0.95, max(0.1, a / (a + 2 * b))) if a else 0.5

    def telling(n):
        p = [total[c] / sum(total) for c in (0, 1)]
        return 2 * sum(n[c] * log(n[c] / (sum(n) * p[c])) for c in (0, 1) if n[c]) >= t.LEAST_G

    vocabulary, contexts = inside(one, t.LEAST_DOCS), inside(first, t.LEAST_PAIRS)
    kept = {p for p in inside(two, t.LEAST_PAIRS) if telling((two[0][p], two[1][p]))}
    d1 = [discount([one[c][w] for w in vocabulary]) for c in (0, 1)]
    d2 = [discount(two[c].values()) for c in (0, 1)]
    n1 = [sum(one[c][w] for w in vocabulary) for c in (0, 1)]
    left = [sum(min(one[c][w], d1[c]) for w in vocabulary) / n1[c] for c in (0, 1)]
    used = [defaultdict(float), defaultdict(float)]
    for c in (0, 1):
        for a, b in kept:
            used[c][a] += max(two[c][a, b] - d2[c], 0)

    def word(c, w):
        return max(one[c][w] - d1[c], 0) / n1[c] + left[c] * (one[0][w] + one[1][w]) / sum(n1)

    def rest(c, a):
        return 1 - used[c][a] / first[c][a] if a in contexts and first[c][a] else 1.0

    def pair(c, a, b):
        own = max(two[c][a, b] - d2[c], 0) / first[c][a] if first[c][a] else 0.0
        return own + rest(c, a) * word(c, b)

    def single(w):
        return log(word(1, w) / word(0, w)) if w in vocabulary and telling((one[0][w], one[1][w])) else 0.0

    def ratio(text):
        words = t.word_codes(text).tolist()
        out = single(words[0]) if words else 0.0
        for a, b in zip(words, words[1:]):
            if (a, b) in kept and a in vocabulary and b in vocabulary:
                out += log(pair(1, a, b) / pair(0, a, b))
            else:
                out += (log(rest(1, a) / rest(0, a)) if a in vocabulary else 0.0) + single(b)
        return out

    return ratio


@pytest.mark.parametrize("source", ["small", "table"])
def test_equals_a_dictionary_model(spark, small, source, monkeypatch):
    monkeypatch.setattr(t, "LEAST_WEIGHT", 0.0)
    if source == "small":
        docs, labels = small[0].drop("toxic"), small[1]
    else:
        docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    known = t.training_labels(labels, "doc_id", "toxic")
    train = t.stage(docs.select("doc_id", "text").join(known, "doc_id").select("text", "toxic"), "train")
    table = t.weights(train).toArrow()
    model, want = t.Weights(table), dictionary_model([(r["text"], r["toxic"]) for r in train.collect()])
    for name, column in (("context", "first"), ("own", "second"), ("extra", "first")):  # doubles, as the table has them
        rows = {r["key"] & (1 << 64) - 1: r[column] for r in table.to_pylist() if r["kind"] == (1 if name == "extra" else 0)}
        setattr(model, name, np.array([rows[int(k)] for k in (model.pairs if name == "extra" else model.words)], dtype=float))
    texts = [r["text"] for r in docs.select("text").limit(400).collect()] + ["nasty w1 vile unknown awful", None]
    got = [model.ratio(t.word_codes(x)) for x in texts]
    for g, x in zip(got, texts):
        assert g == pytest.approx(want(x), rel=1e-9, abs=1e-6)
    assert any(abs(g) > 1 for g in got)



def kneser_ney_model(rows):
    """The models of the module's docstring with plain dictionaries and sets: a function from texts to the
    log-likelihood ratios of the words by themselves and of the whole, and the distributions of class c."""
    from collections import Counter, defaultdict
    from math import log

    held, twos, lefts, total = Counter(), Counter(), defaultdict(set), Counter()
    for text, toxic in rows:
        words = t.word_codes(text).tolist()
        total[toxic] += 1
        held.update((toxic, w) for w in set(words))
        for a, b in set(zip(["start", *words], words)):
            twos[toxic, a, b] += 1
            for group in (toxic, "all"):
                lefts[group, b].add(a)

    vocabulary = {w for _, w in held}
    every = {(a, b) for _, a, b in twos}
    share = {c: total[c] / sum(total.values()) for c in (0, 1)}

    def telling(n):
        return 2 * sum(n[c] * log(n[c] / (sum(n) * share[c])) for c in (0, 1) if n[c]) >= t.LEAST_G

    def discount(values):
        one, two = (sum(v == k for v in values) for k in (1, 2))
        return min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.5

    m = {c: {w: len(lefts[c, w]) for w in vocabulary if lefts[c, w]} for c in (0, 1, "all")}
    kept_words = {w for w in vocabulary if telling((held[0, w], held[1, w]))}
    kept = {(a, b) for a, b in every if telling((twos[0, a, b], twos[1, a, b]))}
    size = {c: sum(m[c].values()) for c in m}
    d1 = {c: discount(m[c].values()) for c in (0, 1)}
    d2 = {c: discount([n for (k, _, _), n in twos.items() if k == c]) for c in (0, 1)}
    begun, used = Counter(), Counter()
    for (c, a, b), n in twos.items():
        begun[c, a] += n
        used[c, a] += max(n - d2[c], 0) if (a, b) in kept else 0

    def own(c, w):
        return max(m[c].get(w, 0) - d1[c], 0) / size[c] if w in kept_words else 0.0

    left = {c: 1 - sum(own(c, w) for w in vocabulary) for c in (0, 1)}

    def word(c, w):  # a word never seen has the share of any: it cancels
        return own(c, w) + left[c] * m["all"].get(w, 1) / size["all"]

    def pair(c, a, b):
        if not begun[c, a]:
            return word(c, b)
        got = max(twos[c, a, b] - d2[c], 0) / begun[c, a] if (a, b) in kept else 0.0
        return got + (1 - used[c, a] / begun[c, a]) * word(c, b)

    def ratios(text):
        words = t.word_codes(text).tolist()
        whole = sum(log(pair(1, a, b) / pair(0, a, b)) for a, b in zip(["start", *words], words))
        return sum(log(word(1, w) / word(0, w)) for w in words), whole

    return ratios, word, pair, vocabulary


@pytest.mark.parametrize("source", ["small", "table"])
def test_equals_a_dictionary_kneser_ney(spark, small, source):
    if source == "small":
        docs, labels = small[0].drop("toxic"), small[1]
    else:
        docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    known = t.training_labels(labels, "doc_id", "toxic")
    train = t.stage(docs.select("doc_id", "text").join(known, "doc_id").select("text", "toxic"), "train")
    table = t.stage(t.kneser_ney(train), "weights")
    want, word, pair, vocabulary = kneser_ney_model([(r["text"], r["toxic"]) for r in train.collect()])
    for c in (0, 1):  # pruned or not, the models are distributions
        assert sum(word(c, w) for w in vocabulary) == pytest.approx(1)
        for a in ["start", *sorted(vocabulary)[:3]]:
            assert sum(pair(c, a, w) for w in vocabulary) == pytest.approx(1)
    texts = docs.select("text").limit(400).union(spark.createDataFrame([("nasty w1 vile unknown awful",), ("vile",), ("",), (None,)], "text string"))
    texts = t.stage(texts.selectExpr("monotonically_increasing_id() as doc_id", "text"), "texts")
    by = {r["doc_id"]: want(r["text"]) for r in texts.collect()}
    for limit in (t.MAX_WEIGHTS, 0):  # broadcast and joined
        got = t.ratios(texts, table, limit).collect()
        assert len(got) == len(by)
        for r in got:
            assert (r["alone"], r["ratio"]) == pytest.approx(by[r["doc_id"]], rel=1e-9, abs=1e-6)
    assert any(abs(whole) > 1 and abs(whole - alone) > 1e-3 for alone, whole in by.values())


def test_words_count_by_left_contexts_and_rare_ones_back_off(spark):
    """Both words are in all toxic rows, but one follows a single word and the other a different one in each:
    equal by rows, not by continuation. Words of one row, and unknown ones, weigh what backing off weighs."""
    rows = [(f"x{i} y{i} z{i}", 0) for i in range(60)]
    rows += [(f"same fixed q{i} free", 1) for i in range(12)]
    table = t.kneser_ney(spark.createDataFrame(rows, "text string, toxic int"))
    model = t.Weights(table.toArrow())
    fixed, free, rare, unknown = (model.parts(t.word_codes(w))[0] for w in ("fixed", "free", "q3", "unknown"))
    assert free > fixed + 1
    assert rare == unknown == model.every != 0


def test_scores_come_from_the_continuation_counts(spark, small, monkeypatch):
    made = []
    real = t.kneser_ney
    monkeypatch.setattr(t, "kneser_ney", lambda train: made.append(1) or real(train))
    monkeypatch.setattr(t, "weights", None)
    assert t.score(*small).count() == small[0].count() and made == [1]
