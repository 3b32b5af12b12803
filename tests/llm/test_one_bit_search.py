from collections import defaultdict

import numpy as np
import pytest

from defgrain.llm import one_bit_search as s


def slow(rows, k, every=20):
    found = defaultdict(dict)  # rows that repeat an id are one query
    for q, x in rows:
        if q % every == 0:
            scores = found[q]
            for v, y in rows:
                if v != q and len(x) == len(y):
                    scores[v] = max(scores.get(v, -np.inf), float(np.dot(np.float64(x), np.float64(y))))
    return {q: sorted(scores.items(), key=lambda p: (-p[1], p[0]))[:k] for q, scores in found.items()}


def search(spark, rows, k=20, **more):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = defaultdict(list)
    for r in s.search(df.repartition(3), k=k, **more).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r["query_id"]]) + 1
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    return got


@pytest.mark.parametrize("kind", ["plain", "clustered", "scaled"])
def test_recall(spark, kind, monkeypatch):
    monkeypatch.setattr(s, "CHUNK", 700)
    monkeypatch.setattr(s, "QUERY_BLOCK", 40)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((2000, 24)).astype(np.float32)
    if kind == "clustered":
        x = (x * 0.2 + rng.standard_normal((20, 24)).astype(np.float32)[rng.integers(0, 20, 2000)]).astype(np.float32)
    if kind == "scaled":
        x *= rng.lognormal(0, 1, (2000, 1)).astype(np.float32)
    rows = list(enumerate(x.tolist()))
    got, want = search(spark, rows), slow(rows, 20)
    assert set(got) == set(want)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) > 0.99
    for q, best in got.items():
        for v, score in best:
            assert abs(score - float(np.dot(np.float64(x[q]), np.float64(x[v])))) < 1e-9


def test_ties_copies_and_few_rows(spark):
    rows = [(i, [1.0, 2.0]) for i in range(100)]
    got = search(spark, rows, k=5)
    assert [v for v, _ in got[0]] == [1, 2, 3, 4, 5] and [v for v, _ in got[40]] == [0, 1, 2, 3, 4]
    assert [v for v, _ in search(spark, [(0, [1.0]), (3, [2.0]), (3, [2.0]), (-20, [1.0])])[0]] == [3, -20]


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [float("inf"), 1.0]), (6, []), (7, [1.0]), (8, [-1.0, 0.0]), (None, [1.0, 1.0]), (20, [0.0, 0.0])]
    got = search(spark, rows)
    assert dict(got) == {0: [(8, -1.0)]}
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert s.search(df).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(8)
    x, q = rng.standard_normal((3000, 32)), rng.standard_normal(32)
    turn = s.rotation(32)
    bits = turn.shape[0]
    assert np.allclose(turn.T @ turn, np.eye(32))
    codes, c = s.encode(x, turn)
    signs = np.unpackbits(codes, axis=1, count=bits) * 2.0 - 1
    norms = np.linalg.norm(x, axis=1)
    estimate = signs @ (turn @ q) / np.sqrt(bits) / c * norms
    slack = norms * np.linalg.norm(q) * np.sqrt(1 - c * c) / c * s.EPSILON / np.sqrt(bits - 1)
    assert (np.abs(estimate - x @ q) <= slack).mean() > 0.99


def test_an_id_in_a_third_of_the_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((900, 16)).astype(np.float32)
    hot = x[0] * 2
    rows = list(enumerate(x[:600].tolist())) + [(777, (hot + 0.01 * rng.standard_normal(16).astype(np.float32)).tolist()) for _ in range(300)]
    got, want = search(spark, rows), slow(rows, 20)
    assert set(got) == set(want) and all(len(best) == 20 for best in got.values())
    assert [v for v, _ in got[0]] == [v for v, _ in want[0]]
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) > 0.99


def test_chunks_and_blocks_are_even_whatever_the_ids(spark, monkeypatch):
    """An id divisible by 20 in a third of the rows, with equal and with different vectors."""
    seen, deal = {}, s.blocked
    monkeypatch.setattr(s, "CHUNK", 500)
    monkeypatch.setattr(s, "QUERY_BLOCK", 100)
    monkeypatch.setattr(s, "blocked", lambda *a: seen.setdefault("dealt", deal(*a)))
    rng = np.random.default_rng(7)
    x = rng.standard_normal((3000, 8)).astype(np.float32)
    rows = list(enumerate(x[:2000].tolist())) + [(40, v) for v in x[2000:2500].tolist()] + [(40, x[2500].tolist())] * 500
    got, want = search(spark, rows), slow(rows, 20)
    queries, targets = seen["dealt"]
    per_chunk = [r["count"] for r in targets.where("block = 0").groupBy("chunk").count().collect()]
    per_block = [r["count"] for r in queries.where("chunk = 0").groupBy("block").count().collect()]
    assert sum(per_chunk) == 3000 and len(per_chunk) >= 6 and max(per_chunk) < 1.5 * 3000 / len(per_chunk)
    assert sum(per_block) == 601 and len(per_block) == 7 and max(per_block) < 2 * 601 / 7
    assert set(got) == set(want)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) > 0.99
    assert len({v for v, _ in got[40]} & {v for v, _ in want[40]}) > 17
