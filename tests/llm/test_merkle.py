import hashlib
import random
import zlib

import pytest

from defgrain.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, g int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, more=0):
    doc_id, source, lang, n_chars, text = row[:5]
    return digest(*map(field, (doc_id, source, lang, None if n_chars is None else n_chars + more, text)))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, k):
    out = []
    for level in levels[:-1]:
        out.append((k & 1, level[k ^ 1] if k ^ 1 < len(level) else None))
        k >>= 1
    return out


def brute_force(rows):
    groups = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in groups:
        own = sorted((r[0] is not None, r[0] or 0, leaf(r), r) for r in rows if r[2] == g)
        trees[g] = (own, tree([x[2] for x in own]))
    top = tree([trees[g][1][-1][0] for g in groups])
    out = []
    for at, g in enumerate(groups):
        own, levels = trees[g]
        for k, (_, _, node, row) in enumerate(own):
            steps = path(levels, k) + path(top, at)
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            folded = leaf(row, 1) if bad else node
            for right, other in steps:
                folded = digest(folded) if other is None else digest(other, folded) if right else digest(folded, other)
            proof = digest(*[o for _, o in steps if o is not None])
            out.append((row[0], node, levels[-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=str)


def rows(n, langs, rng):
    out = []
    for i in rng.sample(range(-3 * n, 50 * n), n):
        out.append((i, rng.choice(["a", None, "bß"]), rng.choice(langs), rng.choice([None, 5, 2**63 - 1]), rng.choice([None, "", "text", "漢"]), "x", 1))
    return out


def got(spark, data, **more):
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    return sorted((tuple(r) for r in merkle.report(df, **more).collect()), key=str)


@pytest.mark.parametrize("n, langs", [(1, ["en"]), (2, ["en"]), (3, [None, "de"]), (65, ["en", "en", "en", "é", "z", None, ""]), (300, [chr(97 + k) for k in range(20)])])
def test_equals_brute_force(spark, n, langs):
    data = rows(n, langs, random.Random(n))
    want = brute_force(data)
    assert got(spark, data, most=3) == want
    if n > 50:
        assert {r[6] for r in want} == {True, False}


def test_repeated_ids_and_rows(spark):
    """One id in a third of the rows, equal rows, several null ids."""
    rng = random.Random(9)
    data = rows(90, ["en", "de"], rng)
    data += [(77, "s", "en", k, f"text {k % 30}", "x", 1) for k in range(40)]
    data += [(77, "s", "en", 1, "same", "x", 1)] * 20 + [(None, None, "en", 3, f"t{k}", "x", 1) for k in range(5)]
    data += [(-1, None, None, None, None, "x", 1)] * 3
    assert got(spark, data) == brute_force(data)


def test_more_than_a_block(spark):
    data = rows(2500, ["en"], random.Random(4))
    assert got(spark, data) == brute_force(data)


def test_empty_and_long(spark):
    assert merkle.report(spark.createDataFrame([], SCHEMA)).count() == 0
    data = [(7, "s", "en", 1, "ä" * 3_000_000, "x", 1)]
    assert got(spark, data) == brute_force(data)
