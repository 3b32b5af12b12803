"""Extraction: what counts as a function, what fails, and that both forms agree."""

import pytest
from pyspark.sql import functions as F

from defgrain.config import ColumnRoles
from defgrain.functions import pysource
from defgrain.operators.extract import extract_functions, function_inventory, parse_counts
from defgrain.operators.normalize import normalize_samples

ROLES = ColumnRoles("code")

SOURCES = {
    "plain": "def f(x):\n    return x  # kept",
    "two": "def f(x): return x\ndef g(y):\n    # gone\n    return y",
    "broken": "def f(:",
    "none": "x = 1",
    "methods": "class A:\n    def m(self): pass",
    "lambda": "f = lambda x: x",
    "nested": "def outer(a):\n    def inner(b):\n        return b\n    return inner",
    "async": "async def k(a: int, b=2) -> int:\n    'Doc.'\n    return a + b",
    "decorated": "@cache\ndef f():\n    pass",
    "doc_only": 'def f():\n    """Only."""',
    "nul": "def f():\n    return '\0'",
    "blank": "   ",
    "empty": "",
    "null": None,
    "imports": "import os\n\ndef f():\n    return os",
    "args": "def f(a, /, b, *c, d=1, **k): pass",
    "surrogate": "def f():\n    '\\ud800'",
    "indent": "  def f(): pass",
}


@pytest.fixture(scope="module")
def extracted(samples):
    names = list(SOURCES)
    rows = extract_functions(samples([(i, SOURCES[n]) for i, n in enumerate(names)]), ROLES).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r._row_id, r._fn_ord)):
        found.setdefault(names[r._row_id], []).append(r)
    return found


def test_every_row_survives(extracted):
    assert set(extracted) == set(SOURCES)
    assert sum(map(len, extracted.values())) == len(SOURCES) + 1


def test_single_function_keeps_text(extracted):
    (row,) = extracted["plain"]
    assert row.code == SOURCES["plain"] and row.parse_ok and row.function_name == "f"


def test_several_functions_are_printed(extracted):
    first, second = extracted["two"]
    assert first.code == "def f(x):\n    return x" and second.code == "def g(y):\n    return y"
    assert (first._fn_ord, second._fn_ord) == (0, 1)


@pytest.mark.parametrize("name", ["broken", "none", "methods", "lambda", "nul", "blank", "empty", "null", "indent"])
def test_failures_are_rows(extracted, name):
    (row,) = extracted[name]
    assert row.parse_ok is False and row.error_message and row.function_name is None
    assert row.parameters == [] and row.ast_hash is None and row.code == SOURCES[name]


def test_nested_functions_are_ignored(extracted):
    assert [r.function_name for r in extracted["nested"]] == ["outer"]


def test_async_facts(extracted):
    (row,) = extracted["async"]
    assert row.is_async and row.return_annotation == "int" and row.docstring_in_code == "Doc."
    assert row.body_without_docstring == "return a + b"
    assert row.signature == "async def k(a: int, b=2) -> int:"


def test_parameters_are_positional_only_in_part(extracted):
    assert extracted["args"][0].parameters == ["b"]
    assert extracted["args"][0].signature == "def f(a, /, b, *c, d=1, **k):"


def test_docstring_only_body(extracted):
    assert extracted["doc_only"][0].body_without_docstring == "pass"


def test_lone_surrogates_do_not_fail(extracted):
    assert extracted["surrogate"][0].docstring_in_code == "?"


def test_tree_ignores_comments_but_not_docstrings(extracted):
    one = pysource.read_text("def f():\n    # c\n    return 1")[0].ast_hash
    assert one == pysource.read_text("def f():  return 1")[0].ast_hash
    assert one != pysource.read_text("def f():\n    'd'\n    return 1")[0].ast_hash


def test_deep_sources_become_failed_rows_or_results(samples):
    deep = "def f():\n    return " + "(" * 5000 + "1" + ")" * 5000
    chain = "def f():\n    return " + "+".join(["1"] * 20000)
    rows = extract_functions(samples([(1, deep), (2, chain)]), ROLES).orderBy("_row_id").collect()
    assert rows[0].parse_ok is False
    # The chain may parse and yet be too deep to print; neither may fail the task.
    assert rows[1].parse_ok is False or rows[1].function_name == "f"


def test_distinct_form_equals_direct_form(samples):
    rows = [(i, list(SOURCES.values())[i % len(SOURCES)]) for i in range(200)]
    direct = extract_functions(samples(rows), ROLES)
    once = extract_functions(samples(rows), ROLES, parse_distinct=True)
    assert once.columns == direct.columns
    assert direct.exceptAll(once).isEmpty() and once.exceptAll(direct).isEmpty()


def test_hot_texts_and_blank_rows_are_spread(spark, samples):
    # A third of the rows is blank, one text holds 30 percent.
    code = lambda i: None if i % 10 < 3 else "def hot(): pass" if i % 10 < 6 else f"def f{i % 997}(): pass\ndef g(): pass"
    rows = samples([(i, code(i)) for i in range(20_000)], 8)
    direct = extract_functions(rows, ROLES)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        once = extract_functions(rows, ROLES, parse_distinct=True)
        sizes = [r.n for r in once.where("_fn_ord = 0").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert max(sizes) < 2 * sum(sizes) / len(sizes)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert direct.exceptAll(once).isEmpty() and once.exceptAll(direct).isEmpty()


def test_user_columns_of_derived_names_are_kept(samples):
    df = samples([(1, "def f(): pass")]).withColumns({"signature": F.lit("mine"), "user_signature": F.lit(2), "parse_ok": F.lit("yes")})
    row = extract_functions(df, ROLES).first()
    assert (row.signature, row.user_user_signature, row.user_signature, row.user_parse_ok, row.parse_ok) == ("def f():", "mine", 2, "yes", True)
    with pytest.raises(ValueError):
        extract_functions(df, ColumnRoles("signature"))


def test_toggle_adds_typed_nulls(samples):
    on = extract_functions(samples([(1, "x")]), ROLES)
    off = extract_functions(samples([(1, "x")]), ROLES, enabled=False)
    assert [f.dataType for f in on.schema] == [f.dataType for f in off.schema]
    assert off.first().parse_ok is None


def test_counts_and_inventory(samples):
    rows = extract_functions(samples([(i, c) for i, c in enumerate(SOURCES.values())]), ROLES)
    counts = parse_counts(rows).first()
    assert counts.ast_parse_success_count + counts.parse_failed_rows == len(SOURCES) + 1
    assert function_inventory(rows).count() == counts.ast_parse_success_count


def test_user_columns_stay(samples):
    df = samples([(1, "def f(): pass\ndef g(): pass")]).withColumn("extra", F.array(F.lit(1)))
    assert {tuple(r.extra) for r in extract_functions(df, ROLES).collect()} == {(1,)}


def test_udf_runs_once(samples):
    rows = extract_functions(normalize_samples(samples([(1, "def f(): pass")]), ROLES), ROLES)
    plan = rows.where("parse_ok")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1


def test_code_role_is_required():
    with pytest.raises(ValueError):
        ColumnRoles("")


def test_memo_is_bounded():
    memo = pysource.Memo()
    for i in range(3 * pysource.MEMO_ENTRIES):
        memo.get(str(i), str(i), lambda: [i])
    memo.get("long", "x" * (pysource.MEMO_TEXT_CHARS + 1), lambda: ["y"])
    assert len(memo.entries) <= pysource.MEMO_ENTRIES and "long" not in memo.entries


def test_outline_tells_apart_exactly_what_the_dump_tells_apart():
    import ast
    import itertools

    sources = [
        "def f(): return 1",
        "def f():\n    return (1)",
        "def f(): return 1.0",
        "def f(): return True",
        "def f(): return '1'",
        "def f(): return b'1'",
        "def f(): return u'1'",
        "def f(): return None",
        "def f(): return",
        "def f(): pass",
        "def f(a): pass",
        "def f(*a): pass",
        "def f(a, /): pass",
        "def f(*, a): pass",
        "def f(*, a=1): pass",
        "def f(a=1): pass",
        "def f() -> None: pass",
        "async def f(): pass",
        "@d\ndef f(): pass",
        "def f(): x = [1, 2]",
        "def f(): x = [1], 2",
        "def f(): x = [(1, 2)]",
        "def f(): x: int",
        "def f(): x: int = 1",
        "def f(): return f'{a}' 'b'",
        "def f(): return f'{a!r}b'",
        "def f(): return a < b < c",
        "def f(): return {**a, 'b': c}",
        "def f(): return {'b': c, **a}",
        "def f(): '[a],b'",
        "def f(): '[a', ']b'",
    ]
    trees = [ast.parse(s).body[0] for s in sources]
    for a, b in itertools.combinations(trees, 2):
        same_dump = ast.dump(a) == ast.dump(b)
        assert (pysource._outline(a, []) == pysource._outline(b, [])) == same_dump, (ast.unparse(a), ast.unparse(b))
