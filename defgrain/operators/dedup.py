"""First-wins deduplication on code text and on syntax tree.

Who wins is decided on (key, hash) pairs alone: a plain ``min`` per hash, combined on the
map side, so a text that makes up a third of the corpus reaches the reducer as one pair per
task. Keys of whole numbers are packed into one decimal, whose minimum aggregates by hash; others
fall back to a sorted minimum. Only the keys of later copies are joined to the wide rows: on the row
key, which is unique, so no join partition can be hot. There is no window over the rows of a group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DROP_REASON, ColumnRoles, as_list, engine, is_engine, key_columns
from ..functions.text import is_present, sha256_bin, sha256_hex
from .tags import add_tag, alive, survivors

DEDUP_STAGE = "deduplicate"
EXACT = "exact_duplicate"
AST = "ast_duplicate"

TEXT_HASH = "_text_hash"
TREE_HASH = "_tree_hash"


def text_hash(df: DataFrame, code: str) -> Column:
    """The stored hash of the code if the frame has it, else a computed one."""
    return F.col(TEXT_HASH) if is_engine(df, TEXT_HASH) else sha256_bin(code).alias(TEXT_HASH)


def tree_hash(df: DataFrame) -> Column:
    if is_engine(df, TREE_HASH):
        return F.col(TREE_HASH)
    return F.when(F.col("parse_ok"), F.unhex("ast_hash")).alias(TREE_HASH)


def with_hashes(df: DataFrame, code: str) -> DataFrame:
    """Hashes stored beside the rows, so that no later step reads a text only to hash it."""
    hashes = [engine(F.when(is_present(code), sha256_bin(code)), TEXT_HASH)]
    if "parse_ok" in df.columns:
        hashes.append(engine(F.when(F.col("parse_ok"), F.unhex("ast_hash")), TREE_HASH))
    return df.select("*", *hashes)


def _packed(df: DataFrame, keys: list[str]) -> Column | None:
    """Row id, function and augmentation as one ordered number, if the id is a whole number."""
    whole = (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)
    if not all(isinstance(df.schema[k].dataType, whole) for k in keys):
        return None
    number = F.col(keys[0]).cast("decimal(19,0)").cast("decimal(38,0)")
    for key in keys[1:]:
        number = (number * F.lit(1 << 31) + F.col(key).cast("int")).cast("decimal(38,0)")
    return number


def first_key(rows: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    """The least key of each group, with the group's columns."""
    packed = _packed(rows, keys)
    if packed is None:
        first = rows.groupBy(*group).agg(F.min(F.struct(*keys)).alias("_first"))
        return first.select(*group, "_first.*")
    first = rows.groupBy(*group).agg(F.min(packed).alias("_first"))
    columns, rest = [], F.col("_first")
    for key in reversed(keys[1:]):
        low = F.pmod(rest, F.lit(1 << 31).cast("decimal(38,0)"))
        columns.append(low.cast("int").cast(rows.schema[key].dataType).alias(key))
        rest = F.floor((rest - low) / F.lit(1 << 31)).cast("decimal(38,0)")
    columns.append(rest.cast(rows.schema[keys[0]].dataType).alias(keys[0]))
    return first.select(*group, *reversed(columns))


def _live(df: DataFrame) -> DataFrame:
    return df.where(alive()) if is_engine(df, DROP_REASON) else df


def later_copies(df: DataFrame, code: str, exact: bool, ast: bool, by: list[str]) -> DataFrame:
    """(keys, _copy) of the live rows that are later copies: of a text, or, among the rows whose
    text is the first of its kind, of a tree. Equal texts have equal trees, so the tree can be part
    of the group of a text."""
    keys = key_columns(df)
    trees = [tree_hash(df)] if ast else []
    rows = _live(df).select(*by, *keys, text_hash(df, code), *trees, is_present(code).alias("_has"))
    copies = []
    if exact:
        texts = rows.where("_has").drop("_has")
        group = [*by, TEXT_HASH, *([TREE_HASH] if ast else [])]
        first = first_key(texts, group, keys)
        copies.append(texts.select(*keys).join(first.select(*keys), keys, "left_anti").withColumn("_copy", F.lit(EXACT)))
        rows = first
    if ast:
        known = rows.where(F.col(TREE_HASH).isNotNull()).select(*by, TREE_HASH, *keys)
        first = first_key(known, [*by, TREE_HASH], keys)
        copies.append(known.select(*keys).join(first.select(*keys), keys, "left_anti").withColumn("_copy", F.lit(AST)))
    return copies[0] if len(copies) == 1 else copies[0].unionByName(copies[1])


def tag_duplicates(
    df: DataFrame,
    roles: ColumnRoles,
    exact: bool = True,
    ast: bool = True,
    by: list[str] | str = (),
    save: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """Tag later copies among rows still alive: same text first, then same tree among the
    survivors. Rows without code always stay; rows that did not parse skip the tree rule.
    ``by`` names columns (a data set or run id) within which copies are searched.

    ``save`` writes the narrow table of later copies first. Its size is then known when the wide
    rows are joined, so that few copies are broadcast and no wide row is shuffled."""
    roles.check(df)
    by = as_list(by)
    ast = ast and "parse_ok" in df.columns
    if not exact and not ast:
        return add_tag(df, DEDUP_STAGE, F.lit(None).cast("string"))
    copies = later_copies(df, roles.code, exact, ast, by)
    if save:
        copies = save(copies, "later_copies")
    return add_tag(df.join(copies, key_columns(df), "left"), DEDUP_STAGE, F.col("_copy")).drop("_copy")


def dedup_exact(df: DataFrame, roles: ColumnRoles, by: list[str] | str = ()) -> DataFrame:
    return survivors(tag_duplicates(df, roles, exact=True, ast=False, by=by))


def dedup_ast(df: DataFrame, roles: ColumnRoles, by: list[str] | str = ()) -> DataFrame:
    """Tree rule alone; without extraction it removes nothing."""
    return survivors(tag_duplicates(df, roles, exact=False, ast=True, by=by))


def dedup_samples(
    df: DataFrame, roles: ColumnRoles, enabled: bool = True, ast: bool = True, by: list[str] | str = ()
) -> DataFrame:
    return survivors(tag_duplicates(df, roles, exact=enabled, ast=enabled and ast, by=by))


def dedup_counts(tagged: DataFrame, by: list[str] | str = ()) -> DataFrame:
    exact, tree = (F.count_if(F.col(DROP_REASON) == r) for r in (EXACT, AST))
    return tagged.groupBy(*as_list(by)).agg(
        (exact + tree).alias("dedup_removed_count"),
        exact.alias("exact_dedup_removed_count"),
        tree.alias("ast_dedup_removed_count"),
    )


def dup_groups(df: DataFrame, roles: ColumnRoles, by: list[str] | str = ()) -> DataFrame:
    """Texts that occur more than once, with their size and first key."""
    by, keys = as_list(by), key_columns(df)
    key = F.col(keys[0]) if len(keys) == 1 else F.struct(*keys)
    narrow = _live(df).where(is_present(roles.code)).select(*by, *keys, sha256_hex(roles.code).alias("code_hash"))
    groups = narrow.groupBy(*by, "code_hash").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_key"))
    return groups.where("n > 1")
