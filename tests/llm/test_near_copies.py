import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from defgrain.llm import near_copies, simhash


def slow_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    a, b = slow_shingles(a), slow_shingles(b)
    return a == b or 10 * len(a & b) >= 8 * len(a | b)


def brute_force(rows):
    left, groups = sorted({i for i, _ in rows if i is not None}), {}
    texts = {i: [t for j, t in rows if i == j] for i in left}
    while left:
        front, least = [left[0]], left.pop(0)
        groups[least] = least
        while front:
            at = front.pop()
            near = [j for j in left if any(similar(a, b) for a in texts[at] for b in texts[j])]
            left = [j for j in left if j not in near]
            front += near
    return sorted(groups)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for k in range(14):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(100, 300))]
        for c in range(rng.randrange(1, 9)):
            edited = list(words)
            for _ in range(c * len(words) // 150):
                edited[rng.randrange(len(edited))] = f"x{rng.randrange(100)}"
            out.append((10 * k + c, " ".join(edited)))
    out += [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "one"), (505, "One two")]
    return out + [(600, out[0][1]), (600, out[0][1]), (601, out[9][1]), (601, out[30][1]), (None, "one"), (None, "one")]


def test_equals_brute_force(spark, rows):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp long").repartition(3)
    got = near_copies.keep_one(df)
    assert got.columns == df.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert ids.count(None) == 2
    assert sorted(i for i in ids if i is not None) == brute_force(rows)
    assert near_copies.keep_one(df.where("false")).count() == 0


def test_copies_beyond_the_radius_of_op2_go(spark):
    from corpus_pipeline import one_of_each_group

    rng, docs = random.Random(3), []
    for k in range(20):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        edited = list(words)
        for at in (30, 80, 130):
            edited[at] = "changed"
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(edited))]
    far = [(simhash.fingerprint(a[1]) ^ simhash.fingerprint(b[1])).bit_count() > simhash.RADIUS for a, b in zip(docs[::2], docs[1::2])]
    assert any(far) and all(similar(a[1], b[1]) for a, b in zip(docs[::2], docs[1::2]))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in one_of_each_group(spark, df, "").collect()) == list(range(0, 40, 2))


def group(rng, n, words, share):
    """Documents of one base in which every one has ``share`` of its words changed, apart from others."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        own = list(base)
        for at in rng.sample(range(words), round(share * words)):
            own[at] = f"x{i}y{at}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("share, similarity", [(0.008, 0.86), (0.018, 0.74)])
def test_rows_are_linear_in_a_group(spark, share, similarity, monkeypatch):
    """2000 documents of one mutual similarity, above or below the limit."""
    monkeypatch.setattr(near_copies, "CELL_ROWS", 700)
    texts = group(random.Random(1), 2000, 250, share)
    own = [near_copies.shingles(t) for t in texts[:40]]
    seen = [len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for a in own for b in own if a is not b]
    assert abs(np.mean(seen) - similarity) < 0.03
    made = []
    links = near_copies._links
    monkeypatch.setattr(near_copies, "_links", lambda groups, kind: made.append(links(groups, kind)) or made[-1])
    got = near_copies.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count()
    assert all(m.count() < 40 * len(texts) for m in made) and len(made) == 2
    index = near_copies.Sets([near_copies.shingles(t).tobytes() for t in texts])
    links = near_copies.forest(index, np.zeros(len(texts), bool))
    assert got == len(texts) - len(links)
    assert (got == 1) == (similarity > 0.8)


def test_forest_connects_what_is_near():
    rng = np.random.default_rng(5)
    for n in (1, 2, 9, 40):
        sets = [np.unique(rng.integers(0, 12, rng.integers(0, 9))).astype(np.uint64) for _ in range(n)]
        main = rng.random(n) < 0.3
        rows = near_copies.Sets([x.tobytes() for x in sets])
        near = [[bool(10 * len(np.intersect1d(a, b)) >= 8 * len(np.union1d(a, b))) for b in sets] for a in sets]
        assert [rows.near(i, np.arange(n)).tolist() for i in range(n)] == near
        edges = [(i, j) for i in range(n) for j in range(n) if near[i][j]]

        def parts(links):
            part = list(range(n))
            for i, j in [*zip(np.flatnonzero(main)[:-1].tolist(), np.flatnonzero(main)[1:].tolist()), *links]:
                part = [part[i] if p == part[j] else p for p in part]
            return {frozenset(k for k in range(n) if part[k] == p) for p in part}

        found = near_copies.forest(rows, main)
        assert all(near[i][j] for i, j in found) and len(found) < n
        assert parts(found) == parts(edges)


def test_cells_bring_all_others_together(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "CELL_ROWS", 3)
    rows = [(k, k * 100 + i, 0, b"x", i == 0 or (k == 1 and i % 2 == 0)) for k in (1, 2) for i in range(20)]
    met = spark.createDataFrame(rows, "key long, fp long, lead long, data binary, main boolean")
    cells = near_copies._cells(met).groupBy("cell").agg(F.collect_list("fp").alias("fps")).collect()
    main = {r[1]: r[4] for r in rows}
    pairs = {(a, b) for c in cells for a in c["fps"] for b in c["fps"]}
    for a in main:
        for b in main:
            if a // 100 == b // 100 and not (main[a] and main[b]) and a != b:
                assert (a, b) in pairs
    assert max(len(c["fps"]) for c in cells) < 20


def test_long_and_clashing(spark):
    rng = random.Random(2)
    long = " ".join(str(rng.randrange(10**7)) for _ in range(120_000))
    rows = [(1, long, 1, 1, 1), (2, long + " more", 2, 2, 2), (3, "a b c d e f", 3, 3, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long, key long, data int")
    assert sorted(r["doc_id"] for r in near_copies.keep_one(df).collect()) == [1, 3]


def test_simhash_brings_candidates_that_are_checked(spark, monkeypatch):
    """Without min-hashes the SimHash operator's links alone lead to the exact comparison."""
    from corpus_pipeline import one_of_each_group

    links = near_copies._links
    monkeypatch.setattr(near_copies, "_links", lambda groups, kind: links(groups, kind).where("false" if kind is near_copies.Sketches else "true"))
    rng, docs = random.Random(4), []
    for k in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:-1], "changed"]))]
    words = [f"w{rng.randrange(5000)}" for _ in range(30)]
    loop = " ".join(words * 40)  # shingles repeat: alike to SimHash with 8 of 44 distinct ones beside them
    docs += [(100, loop), (101, loop + " " + " ".join(f"y{i}" for i in range(10)))]

    def linked(a, b):
        return (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() <= simhash.RADIUS

    pairs = list(zip(docs[::2], docs[1::2]))
    near = [b[0] for a, b in pairs if linked(a[1], b[1]) and similar(a[1], b[1])]
    assert len(near) > 8 and linked(*[t for _, t in docs[-2:]]) and 101 not in near
    got = one_of_each_group(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()
    assert sorted(r["doc_id"] for r in got) == sorted({i for i, _ in docs} - set(near))
