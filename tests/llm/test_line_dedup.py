import random
import re
from collections import Counter

import pytest
import xxhash

from defgrain.llm import line_dedup as ld


def slow(rows, min_words):
    """Texts after removal, by walking the documents in order of doc_id."""
    first = {}
    for i, t in sorted((r for r in set(rows) if r[0] is not None and r[1]), key=lambda r: r[0]):
        for a, b in ld.units(t):
            h, n = ld.digest(t[a:b])
            if n:
                first[h] = min(i, first.get(h, i))
    counts = Counter(h for i, t in rows if i is not None and t for a, b in ld.units(t) for h, n in [ld.digest(t[a:b])] if n)
    out = []
    for i, t in rows:
        later, seen = [], set()
        for k, (a, b) in enumerate(ld.units(t) if t and i is not None else []):
            h, n = ld.digest(t[a:b])
            if n and counts[h] > 1 and (first[h] != i or h in seen):
                later.append(k << 21 | n)
            seen.add(h)
        spans = ld.passages(t, later, min_words) if later else []
        out.append((i, ld.without(t, spans), spans))
    return out


def passage(rng, n):
    return " ".join(f"p{rng.randrange(10**6)}" + ("." if k % 9 == 8 else "") for k in range(n)) + "."


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    shared = [passage(rng, n) for n in (20, 45, 60, 90)]
    out = []
    for i in range(40):
        parts = [passage(rng, rng.randrange(5, 40)) for _ in range(rng.randrange(1, 5))]
        if rng.random() < 0.6:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared).upper() if rng.random() < 0.3 else rng.choice(shared))
        out.append((i, rng.choice(["\n", "\n\n", " "]).join(parts)))
    own = passage(rng, 50)
    return out + [(100, None), (101, ""), (102, " \n "), (103, out[0][1]), (103, out[0][1]), (104, own + "\n" + own), (None, shared[3])]


def test_units_are_the_text():
    for text in ("a. b\n\nc!? d", "", "x", "\n", "e.g. one.two  three.\n"):
        assert "".join(text[a:b] for a, b in ld.units(text)) == text


def test_long_runs_of_marks_end_units_only_before_blanks():
    marks = "!.,?" * 50000
    assert ld.units(f"a{marks} b {marks}c\nd") == [(0, 200002), (200002, 400006), (400006, 400007)]


def test_windows_equal_their_definition():
    rng = random.Random(6)
    for n in (0, 24, 25, 26, 90, 400):
        words = [rng.choice(["a", "b", f"w{rng.randrange(99)}"]) for _ in range(n)]
        sums = []
        for k in range(len(words) - ld.WINDOW + 1):
            value = 0
            for w in words[k : k + ld.WINDOW]:
                value = (value * 0x9E3779B97F4A7C15 + xxhash.xxh3_64_intdigest(w)) % 2**64
            value = (value ^ value >> 31) * 0xBF58476D1CE4E5B9 % 2**64
            sums.append(value ^ value >> 30)
        blocks = [sums[k : k + ld.STEP] for k in range(len(sums) - ld.STEP + 1)]
        places = sorted({k + block.index(min(block)) for k, block in enumerate(blocks)})
        hashes, got = ld.windows(" ".join(words).upper())
        assert got.tolist() == places and hashes.tolist() == [sums[p] for p in places]
        first = {}
        want = [ld._IS_WINDOW | p << 21 | (p - first.setdefault(sums[p], p) >= ld.WINDOW) << 20 | ld.WINDOW for p in places]
        assert ld._window_units(" ".join(words))[1].tolist() == want


def test_equals_brute_force(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, removed int, digest string").repartition(4)
    got = ld.dedup(df, min_words=40).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    want = slow(rows, 40)
    assert sorted(((r[0], r[1], [tuple(x) for x in r["removed"]]) for r in got), key=key) == sorted(want, key=key)
    assert any(r["n_removed"] for r in got)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t)
    for r in got:
        assert r["removed_chars"] == sum(b - a for a, b in r["removed"])
        assert r["text"] == ld.without(texts[r["doc_id"]], [tuple(x) for x in r["removed"]])


def test_the_earliest_copy_stays_once(spark, rows):
    rng = random.Random(9)
    text = passage(rng, 70)
    docs = [(5, "intro here.\n" + text), (3, text + "\nother end."), (9, "Middle " + "of it. " + text.upper() + " End.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in ld.dedup(df).collect()}
    assert got[3] == docs[1][1] and got[5] == "intro here.\n" and got[9] == "Middle of it. End."


def test_documents(spark, rows):
    df = spark.createDataFrame([(i, t, len(t) if t else 0) for i, t in rows], "doc_id long, text string, n_chars long")
    got = ld.dedup_documents(df, chars_col="n_chars", min_words=40)
    assert got.columns == df.columns
    want = [(i, t) for (i, t, s), (_, old) in zip(slow(rows, 40), rows) if not s or t.strip()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=key) == sorted(want, key=key)
    assert all(r["n_chars"] == len(r["text"] or "") for r in got.collect())


def test_empty_table(spark):
    assert ld.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def uncovered(rows, spans, least):
    """Runs of ``least`` words or more that recur from an earlier document and meet no cut, word by word."""
    seen, out = set(), []
    for i, t in sorted(rows):
        places = [m.span() for m in re.finditer(r"\S+", t)]
        words = [t[a:b].lower() for a, b in places]
        grams = [tuple(words[k : k + least]) for k in range(len(words) - least + 1)]
        out += [(i, k) for k, g in enumerate(grams) if g in seen and not any(a < places[k + least - 1][1] and places[k][0] < b for a, b in spans[i])]
        seen |= set(grams)
    return out


def test_passages_anywhere(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}" + rng.choice(["", "", "", "", ",", ".", ".\n"])
    plain = lambda n: [f"q{rng.randrange(10**6)}" for _ in range(n)]
    shared = [[word() for _ in range(n)] for n in (50, 55, 70, 96)] + [plain(50), plain(64)]
    shared += [" ".join(" ".join(plain(17)) + "." for _ in range(3)).split(" "), plain(19)]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(3, 60))) for _ in range(3)]
        parts.insert(rng.randrange(4), " ".join(shared[i % len(shared)]))
        rows.append((i, " ".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spans = {r["doc_id"]: [tuple(s) for s in r["removed"]] for r in ld.dedup(df).collect()}
    assert uncovered(rows, {i: [] for i, _ in rows}, 50) and not uncovered(rows, spans, 50)
    for i, t in rows:
        own = shared[i % len(shared)]
        if i < len(shared) or len(own) < 40:
            assert not spans[i]
        else:
            (a, b), text = spans[i][0], " ".join(own)
            assert len(spans[i]) == 1 and len(t[a:b].split()) >= 40 and t[a:b].strip() in text


def test_a_word_said_a_hundred_times_keeps_its_first_window(spark):
    df = spark.createDataFrame([(1, "spam " * 100)], "doc_id long, text string")
    assert ld.WINDOW <= len(ld.dedup(df).first()["text"].split()) < ld.WINDOW + ld.STEP
