"""Renaming keeps meaning or is skipped; pairs follow the fall-through rules."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from defgrain.config import ColumnRoles
from defgrain.functions import pysource
from defgrain.operators import augment as aug
from defgrain.operators import pairs as pr
from defgrain.operators.extract import extract_functions

CODE = ColumnRoles("code")
BOTH = ColumnRoles("code", "doc")


def rename(source):
    names = pysource.read_text(source)[0].local_names
    entries = [(n, f"var_{i}") for i, n in enumerate(names, 1) if not (n.startswith("var_") and n[4:].isdigit())]
    return pysource.rename_one(source, [o for o, _ in entries], [n for _, n in entries])


@pytest.mark.parametrize(
    "source, names",
    [
        ("def f(a, *b, **c):\n    a = 1; b = 2; c = 3; d = 4", ["d"]),
        ("def f(a, /, *, k):\n    k = 1; a = 2", ["a", "k"]),
        ("def f():\n    for i in x:\n        pass\n    for j, k in x:\n        pass", ["i"]),
        ("def f():\n    with o as w, p as (q, r):\n        n += 1", ["n", "w"]),
        ("async def f():\n    async for i in x:\n        pass\n    async with o as w:\n        pass", []),
        ("def f():\n    a.b = 1\n    c[0] = 2\n    d: int = 3\n    if (e := 4):\n        pass", []),
        ("def f():\n    def g():\n        inner = 1", ["inner"]),
        ("def f():\n    x = y = 1", ["x", "y"]),
    ],
)
def test_local_names(source, names):
    assert pysource.read_text(source)[0].local_names == names


@pytest.mark.parametrize(
    "source, status",
    [
        ("def f(a):\n    t = a\n    return t", "renamed"),
        ("def f(a):\n    return a", "no_locals"),
        ("def f():\n    var_1 = 1\n    return var_1", "no_locals"),
        ("def f():\n    var_2 = 1\n    x = 2\n    return var_2 + x", "unsafe"),
        ("def f():\n    global g\n    g = 1", "unsafe"),
        ("def f():\n    x = 1\n    def h(x):\n        return x\n    return h(x)", "unsafe"),
        ("def f(*, k):\n    k = k + 1\n    return k", "unsafe"),
        ("import x\ndef f():\n    x = 1\n    return x", "unsafe"),
        ("def f():\n    e = 1\n    try:\n        pass\n    except E as e:\n        pass", "unsafe"),
        ("def f(v):\n    match v:\n        case [x]:\n            x = 2\n    return x", "unsafe"),
        ("def f():\n    x = 1\n    return var_1", "unsafe"),
    ],
)
def test_rename_status(source, status):
    assert rename(source)[0] == status


@pytest.mark.parametrize(
    "source, args",
    [
        ("def f(a, b):\n    total = a + b\n    tmp = total * 2\n    return tmp", (2, 3)),
        ("def f(a, b):\n    out = []\n    for i in range(a):\n        out += [i * b]\n    return out", (4, 5)),
        ("def f(a, b):\n    k = 0\n    g = lambda: k + b\n    for j in [a]:\n        k += j\n    return g()", (4, 5)),
        ("def f(a, b):\n    def h():\n        z = a\n        return z\n    y = h()\n    return dict(y=y, b=b)", (1, 2)),
    ],
)
def test_renamed_code_behaves_the_same(source, args):
    result = rename(source)
    assert result[0] == "renamed" and result[1].code != source
    before, after = {}, {}
    exec(source, before)
    exec(result[1].code, after)
    assert before["f"](*args) == after["f"](*args)


def test_rename_map_numbers_skip_generated_names(samples):
    df = extract_functions(samples([(1, "def f():\n    a = 1\n    var_7 = 2\n    z = 3")]), CODE)
    assert {(r.name, r.new_name) for r in aug.rename_map(df).collect()} == {("a", "var_1"), ("z", "var_3")}


def augmented(samples):
    body = "    total = a\n    return total"
    df = samples(
        [
            (1, f"def f(a):\n{body}"),
            (2, f"def f(a):\n{body}"),
            (3, "def f(a):\n    var_1 = a\n    return var_1"),
            (4, f"def g(a):\n{body}"),
            (5, "def h(a): return a"),
            (6, "broken("),
            (7, f"def g(a):  # c\n{body}"),
        ]
    )
    base = extract_functions(df, CODE)
    return base, aug.augment_rename(base, CODE)


def test_new_rows_carry_facts_of_the_new_text(samples):
    _, new = augmented(samples)
    row = new.where("_row_id = 4").first()
    assert row.is_augmented and row.local_names == ["var_1"] and "var_1 = a" in row.body_without_docstring
    assert row.code == "def g(a):\n    var_1 = a\n    return var_1"
    assert row.ast_hash == pysource.read_text(row.code)[0].ast_hash


def test_copies_of_originals_and_of_new_rows_are_dropped(samples):
    base, new = augmented(samples)
    tagged = aug.tag_augmented(base, new, CODE)
    got = {r._row_id: r.drop_reason for r in tagged.collect()}
    # 1 and 2 become text 3, which exists; 7 becomes what 4 became.
    assert got == {1: aug.AUGMENT_DUPLICATE, 2: aug.AUGMENT_DUPLICATE, 4: None, 7: aug.AUGMENT_DUPLICATE}
    counts = aug.augment_counts(base, tagged).first().asDict()
    assert counts == {
        "augmentation_attempt_count": 7,
        "augmentation_success_count": 1,
        "augmentation_failed_count": 3,
        "augmentation_duplicate_dropped_count": 3,
    }


def test_union_flags_new_rows(samples):
    base, new = augmented(samples)
    both = aug.augment_union(base, aug.augment_antijoin(base, new, CODE))
    assert both.count() == 8 and both.where("is_augmented").count() == 1


def test_null_groups_are_compared(samples):
    base, new = augmented(samples)
    add = lambda d: d.withColumn("run", F.lit(None).cast("string"))
    assert aug.augment_antijoin(add(base), add(new), CODE, by="run").count() == 1


def test_rename_runs_once(samples):
    _, new = augmented(samples)
    assert new._jdf.queryExecution().executedPlan().toString().count("rename_batches(") == 1


DOCUMENTED = "def f(a):\n    '''In code.'''\n    return a"


def pairs_of(samples, code, doc):
    df = extract_functions(samples([(1, code, doc)]), BOTH)
    return pr.build_pairs(df, BOTH).orderBy("pair_ord").collect()


def test_three_pairs_in_order(samples):
    first, second, third = pairs_of(samples, DOCUMENTED, " Doc. ")
    assert (first.pair_type, first.input, first.output) == (pr.DOC_TO_CODE, "Doc.", DOCUMENTED)
    assert (second.pair_type, second.input, second.output) == (pr.SIGNATURE_TO_BODY, "def f(a):", "return a")
    assert (third.pair_type, third.input, third.output) == (pr.CODE_TO_DOC, DOCUMENTED, "Doc.")
    assert first.source_function_name == "f" and first.instruction == pr.INSTRUCTIONS[pr.DOC_TO_CODE]


def test_docstring_fall_through(samples):
    assert pairs_of(samples, DOCUMENTED, "")[0].input == "In code."
    assert pairs_of(samples, DOCUMENTED, None)[0].input == "In code."
    assert [p.pair_type for p in pairs_of(samples, DOCUMENTED, "  ")] == [pr.SIGNATURE_TO_BODY]


def test_no_pairs_without_a_function(samples):
    assert pairs_of(samples, "x = 1", "Doc.") == []


def test_without_docstring_role(samples):
    df = extract_functions(samples([(1, DOCUMENTED, "Doc.")]), CODE)
    assert [p.pair_type for p in pr.build_pairs(df, CODE).collect()] == [pr.SIGNATURE_TO_BODY]
    with pytest.raises(ValueError):
        pr.pair_doc_to_code(df, CODE)


def test_counts_equal_built_pairs(samples):
    rows = [(i, [DOCUMENTED, "def g(): pass", "x = 1", "bad("][i % 4], ["Doc.", "", " ", None][i // 4 % 4]) for i in range(16)]
    df = extract_functions(samples(rows), BOTH)
    counts = pr.pair_counts(df, BOTH).first().asDict()
    built = {r.pair_type: r["count"] for r in pr.build_pairs(df, BOTH).groupBy("pair_type").count().collect()}
    assert {t: counts[f"{t}_count"] for t in pr.PAIR_TYPES} == built
    assert counts["instruction_pair_count"] == sum(built.values())
    assert counts["skipped_instruction_pair_count"] == 8


FRESH = {
    "def f():\n    var_2 = 1\n    x = 2\n    return var_2 + x": "var_1",
    "def f(var_1=5):\n    x = var_1 + 1\n    return x * var_1": "var_2",
    "def f(a=3):\n    var_1 = a; y = 2; var_3 = 4; z = 8\n    return var_1 - y * var_3 + z": "var_2,var_4",
    "def f(a=3):\n    b = a\n    return b": "var_1",
}


def test_fresh_names_pass_over_taken_ones_and_run_alike(samples):
    texts = [*FRESH, "def f():\n    var_1 = 1\n    return var_1", "def f(): pass", "def broken(:", "", None]
    rows = extract_functions(samples(list(enumerate(texts))), CODE)
    got = {r["_row_id"]: r for r in aug.augment_rename(rows, CODE, fresh=True).collect()}
    assert sorted(got) == list(range(len(FRESH)))
    for i, (source, names) in enumerate(FRESH.items()):
        before, after = {}, {}
        exec(source, before)
        exec(got[i]["code"], after)
        assert before["f"]() == after["f"]()
        made = set(got[i]["local_names"]) - {n for n in ("var_1", "var_2", "var_3") if f"{n} =" in source}
        assert ",".join(sorted(made)) == names
    plain = {r["_row_id"] for r in aug.augment_rename(rows, CODE).collect()}
    assert plain < set(got)


def test_fresh_names_still_skip_what_stands_outside(samples):
    texts = ["def f():\n    global g\n    g = 1", "def f():\n    x = 1\n    return x + var_1"]
    attempts = aug.augment_attempts(extract_functions(samples(list(enumerate(texts))), CODE), CODE, fresh=True)
    assert {r["aug_status"] for r in attempts.select("aug_status").collect()} == {"unsafe"}


def test_few_rows_are_objects_at_once(monkeypatch):
    """A worker makes objects of a slice of a batch at a time, with the results of whole batches."""
    n = 2 * pysource.SLICE_ROWS + 7
    codes = [[f"def f{i}(a):\n    t = a\n    return t", f"x{i} = 1", None][i % 3] for i in range(n)]
    old, new = ([[name] if i % 3 == 0 else None for i in range(n)] for name in ("t", "var_1"))
    columns = pa.array(codes), pa.array(old, pa.list_(pa.string())), pa.array(new, pa.list_(pa.string()))
    sizes, make = [], pysource._struct_array
    monkeypatch.setattr(pysource, "_struct_array", lambda entries: sizes.append(len(out := make(entries))) or out)
    parsed, renamed = next(pysource.parse_batches(iter([columns[0]]))), next(pysource.rename_batches(iter([columns])))
    assert max(sizes) <= pysource.SLICE_ROWS and len(parsed) == len(renamed) == n
    assert [r["status"] for r in renamed.to_pylist()] == ["renamed" if i % 3 == 0 else "no_locals" for i in range(n)]
    assert [[f["function_name"] for f in r] for r in parsed.to_pylist()] == [[f"f{i}"] if i % 3 == 0 else [None] for i in range(n)]
    empty = [c.slice(0, 0) for c in columns]
    assert len(next(pysource.parse_batches(iter(empty[:1])))) == len(next(pysource.rename_batches(iter([empty])))) == 0
