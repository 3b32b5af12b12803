import math
from fractions import Fraction

import numpy as np
import pytest

from defgrain.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, n int, x string"


def exact_polynomial(m):
    """det(tI - m), constant first, by the traces of exact powers."""
    d, out, b = len(m), [1], [[0] * len(m) for _ in m]
    for k in range(1, d + 1):
        for i in range(d):
            b[i][i] += out[-1]
        b = [[sum(m[i][t] * b[t][j] for t in range(d)) for j in range(d)] for i in range(d)]
        out.append(-sum(b[i][i] for i in range(d)) // k)
    return out[::-1]


def scatter(rng, d, rank, size):
    x = rng.integers(-size, size, (rank, d)).astype(object)
    return (x.T @ x).tolist()


@pytest.mark.parametrize("d, rank, size", [(1, 1, 9), (2, 1, 5), (5, 9, 300), (6, 3, 50), (12, 40, 10**9)])
def test_polynomial(spark, d, rank, size):
    m = scatter(np.random.default_rng(d), d, rank, size)
    assert wh.polynomial(spark, m) == exact_polynomial(m)


def test_hessenberg_form():
    a = np.random.default_rng(0).integers(0, 97, (9, 9))
    a[3:, 2] = 0
    h = wh.hessenberg(a.copy(), 97)
    assert not np.tril(h, -2).any() and (np.trace(h) - np.trace(a)) % 97 == 0


@pytest.mark.parametrize("roots", [[3], [7, 7, 2, 0], [10, 9, 9, 9, 1], [0, 0], [5, 4, 3, 2, 1, 0], [10**12, 10**12 - 1, 3]])
def test_roots(roots):
    c = [1]
    for r in roots:
        c = [a - r * b for a, b in zip([0, *c], [*c, 0])]
    got = wh.largest_roots(c, 4, sum(roots))
    flat = [r for r, times in got for _ in range(times)]
    want = sorted(roots, reverse=True)
    assert len(flat) >= min(4, len(roots))
    assert all(abs(a - b) * 2**100 <= max(1, sum(roots)) for a, b in zip(flat, want))
    assert [t for _, t in got] == [want.count(r) for r in sorted(set(want), reverse=True)][: len(got)]


def brute_force(rows):
    """Whitening in floating point, of rows that take part."""
    own = [(i, np.floor(256 * np.array(v, np.float64))) for i, v in rows]
    fit = np.array(sorted({tuple(x) for _, x in own}))
    n, mean = len(fit), fit.mean(axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(len(mean), -1))
    out = {}
    for i, x in own:
        deviation = sum((n * int(c) - int(s)) ** 2 for c, s in zip(x, fit.sum(axis=0)))
        out[i] = (n, deviation, [(x - mean) @ vectors[:, -k] / math.sqrt(values[-k]) for k in range(1, min(4, len(mean)) + 1)])
    return out, values[::-1] / values.sum()


@pytest.mark.parametrize("d", [1, 3, 16])
def test_equals_floating_point(spark, d):
    rng = np.random.default_rng(d)
    rows = [(i, (rng.normal(size=d) * np.linspace(1, 0.2, d)).astype(np.float32).tolist()) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(60)]
    odd = [(500, None), (501, [None] * d), (502, [float("nan")] * d), (503, [float("inf")] * d), (504, [1.0] * (d + 1)), (505, [])]
    df = spark.createDataFrame([(i, v, 3, "y") for i, v in rows + odd], SCHEMA).repartition(3)
    got = wh.whiten(df).collect()
    want, shares = brute_force(rows)
    assert len(got) == len(rows) * min(4, d)
    signs = {}
    for r in got:
        n, deviation, w = want[r["vec_id"]]
        k = r["component"]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["explained"] - shares[k - 1]) < 1e-9
        assert r["identity_error"] < 1e-9
        signs.setdefault(k, round(r["whitened"] / w[k - 1]))
        assert abs(r["whitened"] * signs[k] - w[k - 1]) < 1e-7
    assert len({r["identity_error"] for r in got}) == 1


def test_close_eigenvalues_are_told_apart(spark):
    """A gap of 10^-12 of the trace, where doubles lose the components."""
    big = 10**13
    m = [[big + 1, 3, 0], [3, big, 5], [0, 5, big - 2]]
    roots = wh.largest_roots(wh.polynomial(spark, m), 3, 3 * big - 1)
    vectors = wh.null_vectors(m, roots, 3)
    for (root, times), v in zip(roots, vectors):
        assert times == 1
        off = [sum(Fraction(a) * Fraction(x) for a, x in zip(row, v)) - root * Fraction(x) for row, x in zip(m, v)]
        assert max(map(abs, off)) < Fraction(big, 2**52)  # the rounding of v to doubles
        assert abs(math.fsum(x * x for x in v) - 1) < 1e-14
    small = np.linalg.eigh(np.array([[1.0, 3, 0], [3, 0, 5], [0, 5, -2]]))[1][:, ::-1].T
    assert all(abs(abs(np.dot(a, b)) - 1) < 1e-13 for a, b in zip(vectors, small))


def test_no_variance_and_empty(spark):
    assert wh.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert wh.whiten(spark.createDataFrame([(1, None, 0, "")], SCHEMA)).count() == 0
    one = wh.whiten(spark.createDataFrame([(1, [0.5, 1.0], 0, ""), (None, [0.5, 1.0], 0, "")], SCHEMA)).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [
        (1, 1, 0, None, None, None),
        (2, 1, 0, None, None, None),
    ] * 2
    flat = wh.whiten(spark.createDataFrame([(i, [float(i), 2.0], 0, "") for i in range(4)], SCHEMA)).collect()
    assert {(r["component"], r["explained"], r["whitened"] is None) for r in flat} == {(1, 1.0, False), (2, 0.0, True)}
    assert flat[0]["identity_error"] < 1e-12


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(3**i), float(-(2 ** (3 * i)))], 0, "") for i in range(12)]
    want = [[int(math.floor(256 * np.float32(c))) for c in r[1]] for r in rows]
    s = [sum(c) for c in zip(*want)]
    got = {r["vec_id"]: r["deviation"] for r in wh.whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    for (i, *_), x in zip(rows, want):
        exact = sum((12 * a - b) ** 2 for a, b in zip(x, s))
        assert got[i] == (exact if exact < 2**63 else None)
