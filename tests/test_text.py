"""Column expressions against plain Python."""

import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from defgrain.functions import numbers, text
from defgrain.operators.tags import is_placeholder, is_repetitive

BLANKS = "".join(chr(i) for i in range(0x110000) if chr(i).isspace())


def evaluate(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("t"))).collect()]


def test_whitespace_is_what_python_strips():
    assert sorted(text.WS) == sorted(BLANKS)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=st.sampled_from(BLANKS + "ab\u200b\ufeffé\U0001f600_"), max_size=12), min_size=50, max_size=80))
def test_strip_matches_python(spark, values):
    assert evaluate(spark, values, text.strip) == [v.strip() for v in values]


def expected_docstring(value):
    value = value.strip()
    match = re.fullmatch(r'"""(.*)"""|\'\'\'(.*)\'\'\'', value, re.DOTALL)
    if match:
        value = next(g for g in match.groups() if g is not None).strip()
    return re.sub("[ \t]+", " ", value).strip()


def test_normalize_docstring(spark):
    values = [
        '"""Doc."""',
        "'''Doc.'''",
        '"""""',
        '""""""',
        '"""',
        '""" a  b\t\tc\n  d """',
        "'''a\"\"\"",
        '"""a"""b"""',
        '\u3000"""x"""\u3000',
        '""""""""',
        "plain",
        "",
        '"""\'\'\'x\'\'\'"""',
    ]
    assert evaluate(spark, values, text.normalize_docstring) == [expected_docstring(v) for v in values]


def test_normalize_code(spark):
    values = ["a\r\nb\rc\n", "\tx\t=\t1", "\xa0def f():\r\n\tpass\u3000", "\x85", None]
    expected = ["a\nb\nc", "x    =    1", "def f():\n    pass", "", None]
    assert evaluate(spark, values, text.normalize_code) == expected


def test_blank_present_length_hash(spark):
    values = [None, "", " \u2003", "x", "\U0001f600é"]
    assert evaluate(spark, values, text.is_blank) == [True, True, True, False, False]
    assert evaluate(spark, values, text.is_present) == [False, False, True, True, True]
    assert evaluate(spark, values, text.char_length) == [None, 0, 2, 1, 2]
    import hashlib

    assert evaluate(spark, ["é"], text.sha256_hex) == [hashlib.sha256("é".encode()).hexdigest()]


def test_substring_match(spark):
    values = ["Why FILTERED", "ast", None, ""]
    assert evaluate(spark, values, lambda c: text.substring_match(c, ["filter", "ast"])) == [True, True, False, False]


def test_placeholder_words(spark):
    values = [" ToDo ", "fixme", "N/A", "todo later", "", None]
    assert evaluate(spark, values, is_placeholder) == [True, True, True, False, False, False]


def test_repetitive(spark):
    rows = [
        ("get_user", "get_user", True),
        ("Get_User Function", "get_user", True),
        ("get_usermethod", "get_user", True),
        ("getuser", "get_user", True),
        ("g_e_t_user", "get_user", True),
        ("get user", "get_user", False),
        ("anything", "", False),
        ("anything", None, False),
    ]
    df = spark.createDataFrame(rows, "d string, n string, want boolean")
    got = df.select(is_repetitive("d", "n").alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_ratio_rounds_like_python(spark):
    rng = random.Random(7)
    pairs = [(n, d) for d in range(1, 161) for n in range(d + 1)]
    pairs += [(rng.randrange(10**9), rng.randrange(1, 10**9)) for _ in range(2000)]
    df = spark.createDataFrame(pairs, "n long, d long")
    r4, r2 = (numbers.safe_ratio(F.col("n"), F.col("d"), k) for k in (4, 2))
    for row in df.select("n", "d", r4.alias("r4"), r2.alias("r2")).collect():
        assert row.r4 == round(row.n / row.d, 4) and row.r2 == round(row.n / row.d, 2), row


def test_ratio_of_nothing(spark):
    df = spark.createDataFrame([(3, 0), (None, 2), (1, None)], "n long, d long")
    assert [r[0] for r in df.select(numbers.safe_ratio(F.col("n"), F.col("d"))).collect()] == [0.0] * 3


def test_exact_round_signs_and_ties(spark):
    df = spark.createDataFrame([(-0.03125,), (0.03125,), (0.0,), (None,)], "x double")
    even = [r[0] for r in df.select(numbers.exact_round(F.col("x"), 4)).collect()]
    away = [r[0] for r in df.select(numbers.exact_round(F.col("x"), 4, "away")).collect()]
    assert even == [-0.0312, 0.0312, 0.0, None] and away == [-0.0313, 0.0313, 0.0, None]
