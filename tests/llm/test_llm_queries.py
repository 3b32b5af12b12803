"""Registered queries on the given tables, and the pipeline stage by stage."""

import random
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from catalog.check import compare, connect
from defgrain.llm import decontaminate, line_dedup, quality
from defgrain.llm.queries import CATALOG
from test_near_copies import brute_force

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in CATALOG)
    assert numbers == list(range(1, 14))
    assert set(CATALOG) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", [n for n, (_, sql) in CATALOG.items() if sql])
def test_query_equals_sql(spark, name):
    assert compare(CATALOG[name][0](spark, SF), connect(SF), CATALOG[name][1]) == ""


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query_runs(spark, name):
    assert CATALOG[name][0](spark, SF).count() > 0


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents whose fate is known: copies, junk, shared passages, benchmark text, odd rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rng = random.Random(1)
    line = lambda n: " ".join(rng.choice("the quiet river ran past an old mill toward town".split()) + rng.choice("abcdefgh") for _ in range(n)) + "."
    shared = line(70)
    extra = [(10_000 + i, line(120) + "\n" + shared, "en", "s", 0) for i in range(4)]
    extra += [(10_010, extra[0][1].replace("the", "the"), "en", "s", 0), (10_011, items[0], "en", "s", 0), (10_012, None, None, None, None), (None, line(60), "en", "s", 1)]
    return docs.unionByName(spark.createDataFrame(extra, docs.schema))


def test_stages(spark, corpus):
    docs = corpus
    for name, function in corpus_pipeline.STAGES:
        before = docs.collect()
        out = function(spark, docs, SF)
        after = out.collect()
        texts = Counter((r["doc_id"], r["text"]) for r in before)
        if name != "packing":
            assert out.columns == corpus.columns
        if name == "quality":
            model = quality.fit(docs)
            want = Counter((r["doc_id"], r["text"]) for r in before if quality.judge(model, r["text"])[3])
        elif name == "near_dups":
            ids = brute_force(list(texts))
            want = Counter({k: n if k[0] is None else 1 for k, n in texts.items() if k[0] in ids or k[0] is None})
        elif name == "passages":
            cut = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs).collect()}
            want = Counter((i, cut[i]) for i, _ in texts if cut[i].strip())
        elif name == "benchmark":
            bad = {r["doc_id"] for r in decontaminate.report(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").collect()}
            want = Counter({k: n for k, n in texts.items() if k[0] not in bad})
            assert 10_011 not in {r["doc_id"] for r in after}
        else:
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
            return
        assert Counter((r["doc_id"], r["text"]) for r in after) == want
        docs = spark.createDataFrame(after, corpus.schema)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dups", "passages", "benchmark", "packing"]
