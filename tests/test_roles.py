"""Role detection, sample observation and recommendations."""

from defgrain.config import ColumnRoles, PrepOptions
from defgrain.operators import roles as rl


def decide(spark, columns, roles=None):
    df = spark.createDataFrame([tuple("x" for _ in columns)], ", ".join(f"`{c}` string" for c in columns))
    rows = rl.role_decision(rl.role_candidates(rl.column_role_profile(df)), roles).collect()
    return {r.role: (r.chosen, r.recommended, r.confidence) for r in rows}


def test_one_code_column_is_certain(spark):
    got = decide(spark, ["doc", "code", "lang", "docstring"])
    assert got == {
        "code": ("code", "code", "high"),
        "docstring": ("docstring", "docstring", "medium"),
        "language": ("lang", "lang", "high"),
    }


def test_several_code_columns_ask(spark):
    got = decide(spark, ["source", "content", "doc", "nl"])
    assert got["code"] == (None, "content", "medium")
    assert got["docstring"] == (None, "nl", "medium")


def test_fallback_is_recommended_but_not_chosen(spark):
    got = decide(spark, ["zeta", "alpha"])
    assert got == {r: (None, "alpha", "low") for r in ("code", "docstring", "language")}
    certain = decide(spark, ["code", "alpha"])
    assert certain["docstring"] == (None, "alpha", "low")


def test_human_answer_wins(spark):
    got = decide(spark, ["source", "content"], ColumnRoles("source"))
    assert got["code"][0] == "source" and got["docstring"][0] is None


def test_candidate_order(spark):
    df = spark.createDataFrame([("a", "b", "c")], "source string, code string, zz string")
    rows = rl.role_candidates(rl.column_role_profile(df)).orderBy("role", "ord").collect()
    assert [(r.column, r.standard) for r in rows if r.role == "code"] == [("code", True), ("source", True)]
    assert [r.column for r in rows if r.role == "language"] == ["code", "source", "zz"]


def test_profile_values(spark):
    df = spark.createDataFrame([("def f", 1, [1]), ("  ", None, None), (None, 3, [2])], "code string, n int, a array<int>")
    got = {r.column: r for r in rl.column_role_profile(df).collect()}
    assert (got["code"].fill, got["code"].mean_len, got["code"].fn_share) == (0.3333, 3.5, 0.3333)
    assert (got["n"].fill, got["a"].fill, got["a"].mean_len) == (0.6667, 0.6667, 0.0)


ROLES = ColumnRoles("code", "doc", "lang")


def sample(spark, rows):
    return spark.createDataFrame(rows, "_row_id long, code string, doc string, lang string").repartition(4)


def test_observation_of_the_first_rows(spark):
    rows = [(i, "x" * 10, "d" if i % 3 else None, ["Go", "go ", "Py", " "][i % 4]) for i in range(60)]
    rows[20] = (20, "def f", "d", "Go")  # the 21st row is outside the first 20
    obs = rl.observe_sample(sample(spark, rows), ROLES).first()
    assert obs.sample_count == 50 and obs.docstring_coverage_estimate == 0.66
    assert obs.avg_code_length == 9 and obs.code_looks_like_functions is False
    assert obs.detected_languages == "go,py"
    rows[19] = (19, "class A", "d", "Go")
    assert rl.observe_sample(sample(spark, rows), ROLES).first().code_looks_like_functions is True


def test_nulls_are_empty(spark):
    obs = rl.observe_sample(sample(spark, [(1, None, None, None), (2, "xxxx", "d", "py")]), ROLES).first()
    assert (obs.avg_code_length, obs.docstring_coverage_estimate) == (2, 0.5)


def test_empty_input(spark):
    obs = rl.observe_sample(sample(spark, [(1, "x", "d", "l")]).where("false"), ROLES).first()
    assert (obs.sample_count, obs.avg_code_length, obs.docstring_coverage_estimate) == (0, 0, 0.0)


def test_top_languages_drop_blanks_after_the_cut(spark):
    langs = ["b", "a", "  ", "  ", "  ", "A", "c"]
    df = sample(spark, [(i, "", "", v) for i, v in enumerate(langs)])
    assert [(r.language, r.n) for r in rl.top_languages(df, "lang").collect()] == [("a", 2), ("b", 1)]


def observed(spark, **values):
    base = {
        "sample_count": 50,
        "docstring_coverage_estimate": 0.9,
        "avg_code_length": 100,
        "code_looks_like_functions": True,
        "non_standard_fields": False,
        "detected_languages": "python",
    }
    return spark.createDataFrame([{**base, **values}])


def risks(spark, roles=ROLES, opts=PrepOptions(), candidates=1, **values):
    return {r.risk for r in rl.dataset_risks(observed(spark, **values), roles, opts, candidates).collect()}


def test_risks(spark):
    assert risks(spark) == set()
    assert risks(spark, roles=ColumnRoles("code")) == {"no_docstring_column"}
    assert risks(spark, candidates=2) == {"ambiguous_code_column"}
    assert risks(spark, opts=PrepOptions(enable_augmentation=True)) == {"augmentation_needs_parsable_code"}
    assert risks(spark, docstring_coverage_estimate=0.29) == {"low_docstring_coverage"}
    assert risks(spark, docstring_coverage_estimate=0.3, avg_code_length=50) == set()
    assert risks(spark, avg_code_length=49) == {"short_code"}
    assert risks(spark, detected_languages="go,rust") == {"no_python_language"}
    assert risks(spark, detected_languages="go,py") == risks(spark, detected_languages="") == set()
    assert risks(spark, code_looks_like_functions=False) == {"no_functions_found"}


def test_traits(spark):
    got = {r.trait: r.value for r in rl.dataset_traits(observed(spark, docstring_coverage_estimate=0.29), ColumnRoles("code"), 2, "csv").collect()}
    assert got == {
        "sampled_rows": "50",
        "code_column": "code",
        "functions_found": "true",
        "docstring_coverage_percent": "28",  # truncated from the stored double, 28.999...
        "mean_code_length": "100",
        "languages": "python",
        "code_candidates": "2",
        "docstring_missing": "true",
    }


def test_recommendations(spark):
    on = PrepOptions(enable_augmentation=True)
    small = rl.recommend_options(observed(spark), ROLES, on).first()
    assert small.enable_augmentation and small.enable_ast_dedup and small.enable_instruction_pairs
    assert rl.recommend_options(observed(spark, sample_count=10**9), ROLES, on).first() == small
    assert not rl.recommend_options(observed(spark, docstring_coverage_estimate=0.09), ROLES, on).first().enable_instruction_pairs
    assert not rl.recommend_options(observed(spark), ColumnRoles("code"), on).first().enable_instruction_pairs
    mode = lambda o, r=ROLES: rl.recommend_mode(rl.recommend_options(observed(spark), r, o)).first()[0]
    assert mode(on) == "enhanced_construction"
    assert mode(PrepOptions()) == "training_data_construction"
    assert mode(on, ColumnRoles("code")) == "cleaning_analysis"


def test_samples_search_the_keys_alone(spark, tmp_path):
    spark.range(5000).selectExpr("(id * 7919) % 5000 as _row_id", "repeat('x', 50) as code").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    head = rl.sample_head(df, 50)
    assert [r._row_id for r in head.collect()] == list(range(50))
    scans = [line for line in head._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in line]
    assert len(scans) == 1 and "LessThanOrEqual(_row_id,49)" in scans[0]
    # The filter follows from the n-th least key, which a scan of the key alone has found.
    wide = rl.sample_head(df.withColumn("more", rl.F.upper("code")), 50)
    assert "LessThanOrEqual(_row_id,49)" in wide._jdf.queryExecution().executedPlan().toString()


def test_samples_under_odd_keys(spark):
    rows = spark.createDataFrame([(None, "n"), (5, "b"), (3, "a"), (9, "c")], "k int, code string")
    assert [r.code for r in rl.sample_head(rows, 2, "k").collect()] == ["n", "a"]
    assert [r.code for r in rl.sample_head(rows, 9, "k").collect()] == ["n", "a", "b", "c"]
    assert rl.sample_head(rows.where("k is null"), 2, "k").count() == 1
    assert rl.sample_head(rows.where("false"), 2, "k").count() == 0
    text = rows.selectExpr("struct(k, code) as s", "cast(k as string) as t", "code")
    assert [r.code for r in rl.sample_head(text, 3, "s").collect()] == ["n", "a", "b"]
    assert [r.code for r in rl.sample_head(text, 3, "t").collect()] == ["n", "a", "b"]


def test_samples_with_equal_keys_are_cut(spark):
    df = spark.createDataFrame([(1, "a")] * 9 + [(None, "b")], "_row_id long, code string")
    assert rl.sample_head(df, 3).count() == 3
