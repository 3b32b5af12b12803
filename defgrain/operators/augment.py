"""Augmentation by renaming local variables.

Names come from the extraction, so the rename map is plain array arithmetic on the row; the
Arrow UDF receives code and map and returns new text together with its new facts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FN_ORD, IS_AUGMENTED, ROW_ID, ColumnRoles, as_list, engine, key_columns
from ..functions import pysource
from ..functions.text import is_present
from .dedup import TEXT_HASH, first_key, text_hash
from .extract import derived_columns
from .tags import add_tag, survivors

AUGMENT_STAGE = "augment_rename"
AUGMENT_DUPLICATE = "augmented_duplicate"

# The shape of generated names.
NAME_PREFIX = "var_"
GENERATED_NAME = "^var_[0-9]+$"


def local_names(extracted: DataFrame) -> DataFrame:
    """One row per (function, local name)."""
    return extracted.select(*key_columns(extracted), F.explode("local_names").alias("name"))


def rename_entries(names: str | Column = "local_names") -> Column:
    """array<struct<name, new_name>> from the sorted names: the n-th becomes ``var_n``; names
    that already look generated keep theirs but still use up their number."""
    ordered = F.array_sort(F.col(names) if isinstance(names, str) else names)
    numbered = F.transform(
        ordered, lambda x, i: F.struct(x.alias("name"), F.concat(F.lit(NAME_PREFIX), i + 1).alias("new_name"))
    )
    return F.filter(numbered, lambda e: ~F.rlike(e["name"], F.lit(GENERATED_NAME)))


def fresh_entries(names: str | Column = "local_names", parameters: str | Column = "parameters") -> Column:
    """As ``rename_entries``, but the n-th name gets the n-th generated name that is free: names that the
    function has as locals or parameters are passed over, so that none of them is merged with another."""
    names, parameters = (F.col(c) if isinstance(c, str) else c for c in (names, parameters))
    used = F.array_union(names, F.coalesce(parameters, F.array().cast("array<string>")))
    numbers = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(names) + F.size(used)))
    free = F.array_except(F.transform(numbers, lambda n: F.concat(F.lit(NAME_PREFIX), n)), used)
    own = F.filter(F.array_sort(names), lambda x: ~F.rlike(x, F.lit(GENERATED_NAME)))
    return F.transform(own, lambda x, i: F.struct(x.alias("name"), F.get(free, i).alias("new_name")))


def rename_map(extracted: DataFrame) -> DataFrame:
    return extracted.select(*key_columns(extracted), F.inline(rename_entries()))


def augment_attempts(df: DataFrame, roles: ColumnRoles, fresh: bool = False) -> DataFrame:
    """Every row with ``aug_status``: renamed, no_locals, unsafe, failed or not_applicable,
    and the rewritten function in ``_renamed``. Renames that would merge two variables or
    reach names bound outside plain Name nodes are ``unsafe`` and give no new row. ``fresh`` numbers
    past the names that are taken (``fresh_entries``), so that fewer are."""
    applicable = F.col("parse_ok").eqNullSafe(True) & is_present("function_name") & is_present(roles.code)
    entries = F.when(applicable, fresh_entries() if fresh else rename_entries())
    # Marked so that a filter on the status is not pushed below the projection, where it would
    # rename every row a second time.
    udf = F.arrow_udf(pysource.rename_batches, pysource.RENAME_DDL).asNondeterministic()
    mapped = df.withColumn("_entries", entries)
    attempted = mapped.withColumn(
        "_attempt",
        udf(F.when(F.size("_entries") > 0, F.col(roles.code)), F.col("_entries.name"), F.col("_entries.new_name")),
    )
    return attempted.select(
        *[F.col(c) for c in df.columns],
        F.when(F.col("_entries").isNull(), "not_applicable").otherwise(F.col("_attempt.status")).alias("aug_status"),
        F.col("_attempt.function").alias("_renamed"),
    )


def renamed_rows(attempts: DataFrame, roles: ColumnRoles) -> DataFrame:
    """The new rows of the attempts, with code and derived columns of the new text."""
    new_values = {roles.code: F.col("_renamed.code"), **derived_columns("_renamed")}
    skipped = ("aug_status", "_renamed", IS_AUGMENTED, TEXT_HASH)
    return attempts.where(F.col("aug_status") == "renamed").select(
        *[
            (new_values[c].alias(c) if c == roles.code else engine(new_values[c], c)) if c in new_values else F.col(f"`{c}`")
            for c in attempts.columns
            if c not in skipped
        ],
        engine(F.lit(True), IS_AUGMENTED),
    )


def augment_rename(df: DataFrame, roles: ColumnRoles, fresh: bool = False) -> DataFrame:
    return renamed_rows(augment_attempts(df, roles, fresh), roles)


def tag_augmented(base: DataFrame, new: DataFrame, roles: ColumnRoles, by: list[str] | str = ()) -> DataFrame:
    """Tag new rows whose text equals an original's or an earlier new row's.

    Both sides are first reduced to distinct hashes on the map side, so neither the anti
    join nor the choice of the first copy meets a hot key; the tag joins on the row key."""
    by, keys = as_list(by), [c for c in (ROW_ID, FN_ORD) if c in new.columns]
    known = base.where(is_present(roles.code)).select(*by, text_hash(base, roles.code)).distinct()
    first = first_key(new.select(*by, *keys, text_hash(new, roles.code)), [*by, TEXT_HASH], keys)
    known = known.select(*[F.col(c).alias(f"_k_{c}") for c in (*by, TEXT_HASH)])
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (*by, TEXT_HASH)])
    fresh = first.join(known, match, "left_anti").select(*keys, F.lit(True).alias("_fresh"))
    marked = new.join(fresh, keys, "left")
    return add_tag(marked, AUGMENT_STAGE, F.when(F.col("_fresh").isNull(), AUGMENT_DUPLICATE)).drop("_fresh")


def augment_antijoin(base: DataFrame, new: DataFrame, roles: ColumnRoles, by: list[str] | str = ()) -> DataFrame:
    return survivors(tag_augmented(base, new, roles, by))


def augment_union(base: DataFrame, accepted: DataFrame) -> DataFrame:
    """Originals and accepted rows; ``is_augmented`` tells them apart."""
    if IS_AUGMENTED not in base.columns:
        base = base.select("*", engine(F.lit(False), IS_AUGMENTED))
    return base.unionByName(accepted)


def augment_counts(base: DataFrame, tagged_new: DataFrame, by: list[str] | str = ()) -> DataFrame:
    """Attempts, successes, failures and dropped copies, one row per data set."""
    by = as_list(by)
    both = base.select(*by, F.lit(True).alias("_base"), F.lit(None).cast("string").alias("_reason")).unionByName(
        tagged_new.select(*by, F.lit(False).alias("_base"), F.col("drop_reason").alias("_reason"))
    )
    attempts = F.count_if("_base")
    success = F.count_if(~F.col("_base") & F.col("_reason").isNull())
    dropped = F.count_if(~F.col("_base") & F.col("_reason").isNotNull())
    return both.groupBy(*by).agg(
        attempts.alias("augmentation_attempt_count"),
        success.alias("augmentation_success_count"),
        (attempts - success - dropped).alias("augmentation_failed_count"),
        dropped.alias("augmentation_duplicate_dropped_count"),
    )
