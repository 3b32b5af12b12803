"""Which column holds what, and what a data set looks like.

Names and types come from the schema, contents from one aggregate over the columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..config import INTERNAL, ROW_ID, ColumnRoles, PrepOptions, as_list
from ..functions.numbers import safe_ratio
from ..functions.text import char_length, is_blank, is_present, looks_like_functions, strip
from ..sources.readers import first_rows

# Known column names per role, in order of preference.
ROLE_NAMES = {
    "code": [
        "code",
        "original_string",
        "content",
        "source",
        "code_text",
        "func_code",
        "function_code",
        "source_code",
        "code_snippet",
    ],
    "docstring": ["docstring", "description", "comment", "nl", "func_doc", "doc", "documentation"],
    "language": ["language", "lang", "programming_language"],
}

# Sample sizes and the thresholds of risks and recommendations.
SAMPLE_ROWS = 50
FUNCTION_SAMPLE_ROWS = 20
TOP_LANGUAGES = 3
LOW_COVERAGE = 0.3
SHORT_CODE = 50
PAIRS_MIN_COVERAGE = 0.1
PYTHON_NAMES = ["python", "py"]


def _role_of(name: str) -> tuple[str | None, int | None]:
    for role, names in ROLE_NAMES.items():
        if name in names:
            return role, names.index(name) + 1
    return None, None


def _user_columns(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema if f.name not in INTERNAL]


def column_role_profile(df: DataFrame) -> DataFrame:
    """One row per column: role by name and rank in that role's list, share of filled rows,
    mean text length, share of values that look like functions. One pass over all columns;
    nested columns are profiled on fill alone."""
    aggregates, rows = [], []
    for i, field in enumerate(_user_columns(df)):
        c = F.col(f"`{field.name}`")
        nested = isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))
        text = F.lit(None).cast("string") if nested else c.cast("string")
        filled = c.isNotNull() if nested else ~is_blank(text)
        aggregates += [
            F.count_if(filled).alias(f"filled_{i}"),
            F.sum(char_length(text)).alias(f"chars_{i}"),
            F.count(text).alias(f"texts_{i}"),
            F.count_if(looks_like_functions(text)).alias(f"fn_{i}"),
        ]
        role, rank = _role_of(field.name)
        rows.append(
            F.struct(
                F.lit(field.name).alias("column"),
                F.lit(role).cast("string").alias("role"),
                F.lit(rank).cast("int").alias("name_rank"),
                F.col("n"),
                F.col(f"filled_{i}").alias("filled"),
                F.col(f"chars_{i}").alias("chars"),
                F.col(f"texts_{i}").alias("texts"),
                F.col(f"fn_{i}").alias("fn"),
            )
        )
    counts = df.agg(F.count(F.lit(1)).alias("n"), *aggregates).select(F.inline(F.array(*rows)))
    return counts.select(
        "column",
        "role",
        "name_rank",
        safe_ratio(F.col("filled"), F.col("n")).alias("fill"),
        safe_ratio(F.col("chars"), F.col("texts"), 2).alias("mean_len"),
        safe_ratio(F.col("fn"), F.col("n")).alias("fn_share"),
    )


def role_candidates(profile: DataFrame) -> DataFrame:
    """Per role the columns with a known name in list order; if there are none, all columns
    by name with ``standard = false``. Input is one row per column, so windows stay tiny."""
    roles = F.explode(F.array(*[F.lit(r) for r in ROLE_NAMES])).alias("role")
    offered = profile.select("column", F.col("role").alias("named_role"), "name_rank", roles)
    standard = F.coalesce(F.col("named_role") == F.col("role"), F.lit(False))
    ranked = offered.withColumn("standard", standard)
    per_role = Window.partitionBy("role")
    usable = ranked.withColumn("any_standard", F.max("standard").over(per_role)).where("standard or not any_standard")
    order = per_role.orderBy(F.when(F.col("standard"), F.col("name_rank")), "column")
    return usable.select("role", F.row_number().over(order).alias("ord"), "column", "standard")


def role_decision(candidates: DataFrame, roles: ColumnRoles | None = None) -> DataFrame:
    """Chosen and recommended column and confidence per role.

    Confidence is high for one known name, medium for several, low for fallback candidates.
    Code is chosen when it is certain; the other roles take their first known name once code
    is certain, otherwise only a single one. Fallback candidates are recommended but never
    chosen. An explicit ``roles`` argument is the human's answer and wins."""
    per_role = candidates.groupBy("role").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("column", "ord").alias("first"), F.bool_and("standard").alias("known")
    )

    def of(role: str, what: str) -> Column:
        return F.max(F.when(F.col("role") == role, F.col(what)))

    wide = per_role.agg(
        *[of(r, w).alias(f"{r}_{w}") for r in ROLE_NAMES for w in ("n", "first", "known")]
    )
    certain = F.col("code_known") & (F.col("code_n") == 1)
    rows = []
    for role in ROLE_NAMES:
        first, known, n = (F.col(f"{role}_{w}") for w in ("first", "known", "n"))
        sure = known & ((n == 1) if role == "code" else (certain | (n == 1)))
        override = getattr(roles, role) if roles else None
        rows.append(
            F.struct(
                F.lit(role).alias("role"),
                (F.lit(override) if roles else F.when(sure, first)).cast("string").alias("chosen"),
                first.alias("recommended"),
                F.when(~known, "low").when(n == 1, "high").otherwise("medium").alias("confidence"),
            )
        )
    return wide.select(F.inline(F.array(*rows)))


def sample_head(df: DataFrame, n: int = SAMPLE_ROWS, key: str = ROW_ID) -> DataFrame:
    """The first rows in key order: the narrow key is searched for the n-th least, and a filter up to
    it is pushed into the wide scan."""
    return first_rows(df, n, key)


preview = sample_head


def top_languages(df: DataFrame, column: str, k: int = TOP_LANGUAGES, key: str = ROW_ID) -> DataFrame:
    """The most frequent languages, ties by first appearance. Blank names compete for a
    place and are removed afterwards."""
    named = df.where(is_present(column)).select(F.lower(strip(column)).alias("language"), key)
    counted = named.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("_seen"))
    best = counted.orderBy(F.desc("n"), "_seen").limit(k)
    return best.where("language != ''").select("language", "n")


def _observation(df: DataFrame, roles: ColumnRoles, by: list[str], function_like: Column, **more: Column) -> DataFrame:
    documented = F.count_if(~is_blank(roles.docstring)) if roles.docstring else F.lit(0).cast("long")
    totals = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sample_count"),
        documented.alias("_documented"),
        F.coalesce(F.sum(char_length(roles.code)), F.lit(0)).alias("_chars"),
        F.bool_or(function_like).alias("_fn_like"),
        *[c.alias(name) for name, c in more.items()],
    )
    mean = F.try_divide(F.col("_chars").cast("double"), F.col("sample_count"))
    return totals.select(
        *by,
        "sample_count",
        safe_ratio(F.col("_documented"), F.col("sample_count"), 2).alias("docstring_coverage_estimate"),
        F.floor(F.coalesce(mean, F.lit(0.0))).cast("long").alias("avg_code_length"),
        F.coalesce("_fn_like", F.lit(False)).alias("code_looks_like_functions"),
        F.lit(roles.code not in ROLE_NAMES["code"]).alias("non_standard_fields"),
        *more,
    )


def observe_sample(df: DataFrame, roles: ColumnRoles, n: int = SAMPLE_ROWS, key: str = ROW_ID) -> DataFrame:
    """One row about the first ``n`` rows; functions are looked for in the first 20 of them.
    Only the role columns and the key are read."""
    columns = list(dict.fromkeys(c for c in (key, roles.code, roles.docstring, roles.language) if c))
    head = sample_head(df.select(*columns), n, key)
    place = F.row_number().over(Window.orderBy(key))  # at most n rows
    flagged = head.withColumn("_fn_like", looks_like_functions(roles.code) & (place <= FUNCTION_SAMPLE_ROWS))
    languages = F.lit(None).cast("string")
    if roles.language:
        name = F.when(is_present(roles.language), F.lower(strip(roles.language)))
        flagged = flagged.withColumn("_language", name)
        seen = F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col("_language").alias("l"))))
        # The sample is bounded, so its languages may be gathered and ranked in place.
        names = F.filter(F.transform(seen, lambda e: e["l"]), lambda x: x.isNotNull())
        ranked = F.transform(
            F.array_distinct(names),
            lambda x: F.struct(
                (-F.size(F.filter(names, lambda y: y == x))).alias("n"), F.array_position(names, x).alias("p"), x.alias("l")
            ),
        )
        top = F.slice(F.array_sort(ranked), 1, TOP_LANGUAGES)
        languages = F.array_join(F.filter(F.transform(top, lambda e: e["l"]), lambda x: x != ""), ",")
    return _observation(flagged, roles, [], F.col("_fn_like"), detected_languages=languages)


def observe(df: DataFrame, roles: ColumnRoles, by: list[str] | str, key: str = ROW_ID) -> DataFrame:
    """The same observation over all rows, one row per data set, so that counts are true
    counts. Languages are reduced to (data set, language) counts before they are ranked."""
    by = as_list(by)
    facts = _observation(df, roles, by, looks_like_functions(roles.code))
    if not roles.language:
        return facts.withColumn("detected_languages", F.lit(None).cast("string"))
    named = df.where(is_present(roles.language)).select(*by, F.lower(strip(roles.language)).alias("l"), key)
    counted = named.groupBy(*by, "l").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("seen"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "seen"))
    top = counted.withColumn("place", place).where(F.col("place") <= TOP_LANGUAGES)
    joined = F.array_join(
        F.transform(
            F.sort_array(F.collect_list(F.when(F.col("l") != "", F.struct("place", "l")))), lambda e: e["l"]
        ),
        ",",
    )
    languages = top.groupBy(*by).agg(joined.alias("detected_languages"))
    return facts.join(languages, by, "left").withColumn(
        "detected_languages", F.coalesce("detected_languages", F.lit(""))
    )


def _coverage_percent() -> Column:
    return F.floor(F.col("docstring_coverage_estimate") * 100).cast("string")


def dataset_traits(
    obs: DataFrame, roles: ColumnRoles, n_code_candidates: int = 1, file_type: str | None = None, by: list[str] | str = ()
) -> DataFrame:
    """(trait, value) rows per observation; traits without a value are left out."""
    sampled = F.col("sample_count") > 0
    looks = F.col("code_looks_like_functions")
    traits = {
        "sampled_rows": F.when(sampled, F.col("sample_count").cast("string")),
        "code_column": F.lit(roles.code),
        "docstring_column": F.lit(roles.docstring),
        "language_column": F.lit(roles.language),
        "functions_found": F.when(sampled | looks, looks.cast("string")),
        "docstring_coverage_percent": _coverage_percent(),
        "mean_code_length": F.when(F.col("avg_code_length") > 0, F.col("avg_code_length").cast("string")),
        "languages": F.when(F.col("detected_languages") != "", F.col("detected_languages")),
        "non_standard_names": F.when(F.col("non_standard_fields"), "true"),
        "code_candidates": F.lit(str(n_code_candidates) if n_code_candidates > 1 else None),
        "docstring_missing": F.lit(None if roles.docstring else "true"),
        "parquet_input": F.lit("true" if file_type == "parquet" else None),
    }
    rows = F.array(
        *[F.struct(F.lit(t).alias("trait"), v.cast("string").alias("value")) for t, v in traits.items()]
    )
    return obs.select(*as_list(by), F.inline(F.filter(rows, lambda e: e["value"].isNotNull())))


def dataset_risks(
    obs: DataFrame,
    roles: ColumnRoles,
    opts: PrepOptions = PrepOptions(),
    n_code_candidates: int = 1,
    by: list[str] | str = (),
) -> DataFrame:
    """One row per risk that applies to a data set."""
    languages = F.col("detected_languages")
    python = F.arrays_overlap(F.split(languages, ","), F.array(*[F.lit(p) for p in PYTHON_NAMES]))
    length = F.col("avg_code_length")
    rules = {
        "no_docstring_column": F.lit(roles.docstring is None),
        "ambiguous_code_column": F.lit(n_code_candidates > 1),
        "augmentation_needs_parsable_code": F.lit(opts.enable_augmentation),
        "low_docstring_coverage": F.col("docstring_coverage_estimate") < LOW_COVERAGE,
        "short_code": (length > 0) & (length < SHORT_CODE),
        "no_python_language": F.coalesce((languages != "") & ~python, F.lit(False)),
        "no_functions_found": (F.col("sample_count") > 0) & ~F.col("code_looks_like_functions"),
    }
    found = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return obs.select(*as_list(by), F.explode(found).alias("risk"))


def recommend_options(obs: DataFrame, roles: ColumnRoles, opts: PrepOptions = PrepOptions(), by: list[str] | str = ()) -> DataFrame:
    """Option columns per data set: pairs need a docstring column and some coverage. Size changes
    nothing, since every step is distributed. ``obs`` should carry true counts."""
    covered = F.col("docstring_coverage_estimate") >= PAIRS_MIN_COVERAGE
    return obs.select(
        *as_list(by),
        F.lit(opts.enable_dedup).alias("enable_dedup"),
        F.lit(opts.enable_ast_dedup).alias("enable_ast_dedup"),
        F.lit(opts.enable_ast_extract).alias("enable_ast_extract"),
        F.lit(opts.enable_augmentation).alias("enable_augmentation"),
        (F.lit(opts.enable_instruction_pairs and roles.docstring is not None) & covered).alias(
            "enable_instruction_pairs"
        ),
    )


def recommend_mode(options: DataFrame, by: list[str] | str = ()) -> DataFrame:
    pairs, augmented = F.col("enable_instruction_pairs"), F.col("enable_augmentation")
    mode = (
        F.when(pairs & augmented, "enhanced_construction")
        .when(pairs, "training_data_construction")
        .otherwise("cleaning_analysis")
    )
    return options.select(*as_list(by), mode.alias("recommended_mode"))
