import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from defgrain.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return np.array(TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")


TRICKY = [
    None,
    "",
    " \t\n ",
    "Don't I'LL 'S we've",
    "a\x0bb\x0cc\x1cd\x85e f g",
    "é ́x İ ΣΑΣ ﬁ ½ ²³ ١٢ 漢字 🙂🙂",
    "x" * 3000,
    "<|endoftext|> y<|startoftext|>z",
    "a.b,c\r\n%%%$$ 12 345",
    "'tis l'été d'ou rock'n'roll 's's ''s .'s x'",
    "it'llama they've'd 're're'm MÖ'VE ª1º² ×÷ µß'",
    "'",
    "'s",
    "x'l",
]


def test_ids_equal_the_tokenizer_on_whole_texts():
    got = packing.token_ids(TRICKY, PATH, "<u2")
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [ids_of(t).tolist() for t in TRICKY]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="stmdrevlaB '.,19²é×\n\xa0Σ<|", max_size=25), max_size=4))
def test_ids_of_any_text(texts):
    got = packing.token_ids(texts, PATH, "<u2")
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [ids_of(t).tolist() for t in texts]


@pytest.mark.parametrize("shard_tokens", [1_000_000, 3000])
def test_every_id_lies_in_one_piece(spark, shard_tokens):
    rng = random.Random(5)
    texts = TRICKY + [" ".join(rng.choice("red green blue sky sea".split()) for _ in range(rng.randrange(1500))) for _ in range(40)]
    rows = [(i, t, i, "x") for i, t in enumerate(texts)] + [(None, "no id", 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset int, ids string").repartition(3)
    got = packing.pack(df, window=256, shard_tokens=shard_tokens).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == {r[0] for r in rows}
    for doc_id, text, *_ in rows:
        ids, at = ids_of(text), 0
        for r in sorted(pieces[doc_id], key=lambda r: r["start"]):
            raw = ids[at : at + r["length"]].tobytes()
            assert (r["start"], r["doc_tokens"], r["ids"], r["ids_crc32"]) == (at, len(ids), raw, zlib.crc32(raw))
            at += r["length"]
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256 and at & (at - 1) == 0


def test_neighbours_follow_bm25():
    rng = np.random.default_rng(1)
    docs = [(k, 0, rng.integers(0, 60, rng.integers(5, 90)).astype("<u2")) for k in range(50)]
    idf = rng.random(60).astype(np.float32) + 0.1
    shard = packing.Shard(docs, idf, 64)
    mean = np.mean([len(d[2]) for d in docs])
    for seed in range(50):
        query, scores = set(docs[seed][2].tolist()), []
        for _, _, ids in docs:
            tf = {t: int((ids == t).sum()) for t in query}
            norm = packing.K1 * (1 - packing.B + packing.B * len(ids) / mean)
            scores.append(sum(idf[t] * f * (packing.K1 + 1) / (f + norm) for t, f in tf.items()))
        order = shard.neighbours(seed)
        assert sorted(order.tolist()) == list(range(50))
        ranked = np.array(scores)[order]
        assert (ranked[:-1] >= ranked[1:] - 1e-3).all()


def test_document_counts_cover_all_documents(spark):
    df = spark.createDataFrame([(i, f"sky {'sea' if i % 2 else ''} sky") for i in range(20)], "doc_id long, text string").repartition(4)
    counts, total = packing.token_documents(packing.tokenised(df, PATH, "<u2"), "<u2")
    sky, sea = ids_of("sky")[0], ids_of("sea")[0]
    assert (total, counts[sky], counts[sea], counts[2]) == (20, 20, 10, 20)


def test_empty_table_and_bad_window(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(df).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, window=100)
