import math

from hypothesis import given, settings
from hypothesis import strategies as st

from defgrain.llm import license_scan as scan
from defgrain.llm.common import alnum_words

WORDS = sorted({w.decode() for _, ws in scan.template_words() for w in ws})


def slow_match(words, templates, threshold=scan.THRESHOLD):
    out = {}
    for label, wanted in templates:
        share = len(wanted & set(words)) / len(wanted)
        if len(wanted & set(words)) >= math.ceil(threshold * len(wanted) - 1e-9):
            out[label] = max(share, out.get(label, 0))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(WORDS + ["zzz"]), max_size=60), st.integers(0, 5))
def test_matcher_finds_every_template(words, seed):
    templates = scan.template_words()
    frequencies = {w.encode(): hash((w, seed)) % 50 for w in WORDS}
    matcher = scan.Matcher(templates, frequencies, scan.THRESHOLD)
    got = {}
    for label, share in matcher.match([w.encode() for w in words]):
        got[label] = max(share, got.get(label, 0))
    assert got == slow_match([w.encode() for w in words], templates)


def test_every_template_matches_itself():
    matcher = scan.Matcher(scan.template_words(), {}, scan.THRESHOLD)
    for label, text in scan.TEMPLATES:
        assert (label, 1.0) in matcher.match(alnum_words(text))


def test_places():
    words = alnum_words("The MIT-license; mit  LICENSE, GNU General Public License: apache license mit license")
    assert scan.phrase_places(words) == [(1, "mit"), (3, "mit"), (6, "gpl"), (9, "apache"), (11, "mit")]
    assert scan.phrase_places([]) == []


def test_scan(spark):
    rows = [
        (1, "Released under the MIT License.\nmore text"),
        (2, "some text\nAll rights\n\nreserved. x"),
        (3, "All rights reserved"),
        (4, None),
        (5, ""),
        (6, "This program is free software: you can redistribute it\nand/or modify it under the terms of the GNU\nGeneral Public License as published\nby the Free Software Foundation\n\nbye"),
        (None, "apache license"),
        (3, "All rights reserved"),
    ]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, labels string, score int")
    got = sorted((tuple(r) for r in scan.scan(df).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert got[0] == (1, 7, 1, 3, 3, "mit", "mit", 1.0)
    assert got[1] == (2, 6, 0, None, None, "", "", 0.0)  # the words stand in different blocks
    assert got[2] == got[3] == (3, 3, 0, None, None, "", "all-rights-reserved", 1.0)
    assert got[4] == (4, 0, 0, None, None, "", "", 0.0) and got[5] == (5, 0, 0, None, None, "", "", 0.0)
    assert got[6][5:] == ("gpl", "agpl,gpl,lgpl", 1.0)
    assert got[7][1:] == (2, 1, 0, 0, "apache", "apache", 1.0)
    assert scan.scan(df.where("false")).count() == 0


def test_frequencies_count_blocks(spark):
    df = spark.createDataFrame([("mit mit\nlicense mit",), ("none",), (None,)], "text string")
    got = scan.word_frequencies(df, frozenset([b"mit", b"license", b"absent"]))
    assert (got[b"mit"], got[b"license"], got[b"absent"]) == (3, 2, 0)  # two lines and their paragraph
