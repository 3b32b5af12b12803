import random

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from defgrain.llm import simhash
from defgrain.llm.components import components


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(links, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_force(rows):
    known = [(i, slow_fingerprint(t)) for i, t in rows if i is not None]
    links = [(i, j) for i, a in known for j, b in known if (a ^ b).bit_count() <= 4]
    return classes(links, {i for i, _ in known})


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 63), max_size=4))
def test_some_mask_ignores_any_four_positions(places):
    changed = sum(1 << p for p in places)
    for level in (0, 1):
        assert any(m & changed == 0 for m in simhash.masks(level))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab \t\n\x0b éZ", max_size=80))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_fingerprint_of_a_long_text():
    text = " ".join(f"w{i % 977}" for i in range(70_000))
    assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for k in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(150, 400))]
        for c in range(rng.randrange(1, 7)):
            edited = list(words)
            for _ in range(c):
                edited[rng.randrange(len(edited))] = f"x{rng.randrange(100)}"
            out.append((10 * k + c, " ".join(edited)))
    out += [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "one"), (505, "One")]
    out += [(600, out[0][1]), (600, out[0][1]), (601, out[9][1]), (601, out[20][1])]  # repeated rows, two texts
    return out


@pytest.mark.parametrize("max_bucket", [8192, 3])
def test_components_equal_brute_force(spark, rows, max_bucket):
    df = spark.createDataFrame([(i, t, 0, 0, 0, "x") for i, t in rows], "doc_id long, text string, fp int, key int, node int, row_key string")
    got = simhash.near_duplicates(df, max_bucket=max_bucket).collect()
    want = brute_force(rows)
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in got} == set(want.items())
    assert {(r["doc_id"], int(r["fingerprint"], 16)) for r in got} == {(i, slow_fingerprint(t)) for i, t in rows}


def test_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b"), (3, "a b"), (None, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    assert got == {(None, None), (3, 3)}
    assert simhash.near_duplicates(df.where("false")).count() == 0
    assert sorted((r["doc_id"] or -1) for r in simhash.keep_one(df).collect()) == [-1, -1, 3]


def test_keep_one(spark, rows):
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, extra long")
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(brute_force(rows).values()))


def test_a_dense_group_is_one_component(spark):
    base = 0x0123456789ABCDEF
    found = [(base ^ (1 << a) ^ (1 << b), 100 + 8 * a + b) for a in range(8) for b in range(a)]
    fps = spark.createDataFrame([(f, n) for f, n in found], "fp long, node long")
    for max_bucket in (8192, 4):
        links = [(r["u"], r["v"]) for r in simhash.links(fps, max_bucket=max_bucket).collect()]
        assert len(set(classes(links, {n for _, n in found}).values())) == 1


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=40))
def test_components(spark, edges):
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    df = spark.createDataFrame([*edges, (None, 3)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == classes(edges, {n for e in edges for n in e} | nodes) or got == {
        n: r for n, r in classes(edges, {x for e in edges for x in e}).items() if n in nodes
    }


def test_components_of_a_chain(spark):
    df = spark.range(1, 300).selectExpr("id as u", "id - 1 as v")
    got = components(df).collect()
    assert len(got) == 300 and {r["root"] for r in got} == {0}
