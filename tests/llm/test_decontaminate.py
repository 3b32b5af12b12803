import hashlib
import random

import pytest

from defgrain.llm import decontaminate as d
from defgrain.llm.common import alnum_words


def slow(text, items, width=13):
    words = alnum_words(text)
    hit, found = set(), set()
    for item, item_text in items:
        own = alnum_words(item_text)
        n = min(width, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(item)
    ids = ",".join(sorted(map(str, found)))
    return len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(3)
    word = lambda: rng.choice("the a of red Blue green".split()) + str(rng.randrange(3))
    items = [(i, " ".join(word() for _ in range(rng.randrange(3, 30)))) for i in range(30)]
    items += [(40, None), (41, " .,"), (42, items[0][1]), (43, "É é É"), (9, items[1][1])]
    docs = []
    for i in range(80):
        parts = [word() for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(parts) + 1)
            own = (rng.choice(items)[1] or "").upper().split()
            parts[at:at] = own[rng.randrange(3) : len(own) - rng.randrange(3)]
        docs.append((i, rng.choice([" ", "\n", ", "]).join(parts)))
    docs += [(100, None), (101, ""), (102, "É É é É"), (3, docs[3][1]), (None, items[2][1])]
    return docs, items


@pytest.mark.parametrize("max_part", [500_000, 40])
def test_report_equals_brute_force(spark, tables, max_part):
    docs, items = tables
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, n_hit int, row_key int").repartition(5)
    bench = spark.createDataFrame([*items, (None, "the a of")], "item_id long, text string")
    got = d.report(df, bench, max_part=max_part).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(((i, *slow(t, items)) for i, t in docs), key=key)


def test_clean(spark, tables):
    docs, items = tables
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    bad = {i for i, t in docs if slow(t, items)[4]}
    assert sorted(str(r["doc_id"]) for r in d.clean(df, bench).collect()) == sorted(str(i) for i, t in docs if i not in bad)
    cut = d.clean(df, bench, remove="spans").collect()
    assert len(cut) == len(docs)
    for r in cut:
        if r["doc_id"] not in bad:
            assert (r["doc_id"], r["text"]) in docs
    with pytest.raises(ValueError):
        d.clean(df, bench, remove="all")


def test_spans():
    assert d.remove_spans("A b, c! D e", [1], [3]) == "A ! D e"
    assert d.remove_spans("É b", [0], [2]) == ""
    assert d.remove_spans(None, [0], [1]) is None
    assert d.covered([(5, 7), (0, 2), (2, 3), (6, 9)]) == [(0, 3), (5, 9)]


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.report(df, none).first()["contaminated"] is False
    assert d.report(df.where("false"), none).count() == 0


@pytest.mark.parametrize("max_part", [500_000, 1])
def test_words_of_an_item_without_id_are_hit(spark, max_part):
    bench = spark.createDataFrame([(None, "some secret question here"), (1, "another one")], "item_id long, text string")
    df = spark.createDataFrame([(1, "x some secret question here"), (2, "nothing"), (3, "another one")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in d.report(df, bench, max_part=max_part).collect()}
    assert [(got[i]["n_hit"], got[i]["n_items"], got[i]["contaminated"]) for i in (1, 2, 3)] == [(4, 0, True), (0, 0, False), (2, 1, True)]
    assert got[1]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    assert sorted(r["doc_id"] for r in d.clean(df, bench, max_part=max_part).collect()) == [2]
