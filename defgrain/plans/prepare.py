"""The whole preparation: raw rows to cleaned rows, pairs, metrics and log."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import (
    DROP_REASON,
    DROP_STAGE,
    FACTS,
    FN_ORD,
    IS_AUGMENTED,
    ROW_ID,
    VERDICT,
    ColumnRoles,
    PrepOptions,
    as_list,
    engine,
    is_engine,
    set_aside,
)
from ..operators import augment as aug
from ..operators import metrics as met
from ..operators.dedup import DEDUP_STAGE, TEXT_HASH, TREE_HASH, tag_duplicates, with_hashes
from ..operators.extract import DERIVED, extract_functions
from ..operators.normalize import normalize_samples
from ..operators.pairs import build_pairs
from ..operators.tags import (
    INVALID_STAGE,
    apply_verdicts,
    badcases,
    border_candidates,
    survivors,
    tag_invalid,
    tag_low_quality,
)
from ..sources.readers import with_row_id
from ..sources.staging import remove, stage


@dataclass
class Prepared:
    """Views of the tagged table; nothing is computed until it is used."""

    parsed: DataFrame
    tagged: DataFrame
    roles: ColumnRoles
    opts: PrepOptions
    by: list[str]
    durations_ms: dict[str, int] = field(default_factory=dict)
    save: Callable[[DataFrame, str], DataFrame] = stage
    written: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Delete the tables this preparation wrote. Its views, and rounds refined from it, cannot be
        read afterwards."""
        for frame in self.written:
            remove(frame)
        self.written.clear()

    @property
    def cleaned(self) -> DataFrame:
        return survivors(self.tagged).drop(*_NARROW)

    @property
    def badcases(self) -> DataFrame:
        return badcases(self.tagged).drop(*_NARROW)

    @property
    def border(self) -> DataFrame:
        """Rows worth an outside verdict, from the rows that entered the docstring filter."""
        entered = self.parsed.where(F.coalesce(F.col(DROP_STAGE) != INVALID_STAGE, F.lit(True)))
        return border_candidates(
            entered.drop(DROP_STAGE, DROP_REASON), self.roles, self.opts.docstring_min_len, self.by
        )

    @property
    def pairs(self) -> DataFrame | None:
        if not (self.opts.enable_instruction_pairs and self.opts.enable_ast_extract):
            return None
        return build_pairs(self.cleaned, self.roles)

    @cached_property
    def metrics(self) -> DataFrame:
        """One row per data set, written on first use: every report starts from it, and none
        should scan the tagged rows again."""
        saved = self.save(met.tag_metrics(self.tagged, self.roles, self.opts, self.by), "metrics")
        self.written.append(saved)
        return saved

    @property
    def log(self) -> DataFrame:
        return met.stage_log(self.metrics, self.by, self.durations_ms, self.opts)


# Columns that serve the library's own passes and are no part of an output.
_NARROW = (FACTS, TEXT_HASH, TREE_HASH)

# Names the library gives columns; a user's columns of these names are kept as ``user_<name>``.
_NAMES = (*DERIVED, FN_ORD, IS_AUGMENTED, DROP_STAGE, DROP_REASON, VERDICT, *_NARROW)


def _freed(df: DataFrame, roles: ColumnRoles, by: list[str]) -> DataFrame:
    clash = [c for c in by if c in _NAMES]
    if clash:
        raise ValueError(f"rename the columns {clash} first; the library gives columns these names")
    return set_aside(df, _NAMES, roles)


def tag_rows(df: DataFrame, roles: ColumnRoles, opts: PrepOptions = PrepOptions()) -> DataFrame:
    """The row-wise part: normalise, extract, tag. One scan, no shuffle, also on streams."""
    df = _freed(df, roles, [])
    return _tag(extract_functions(normalize_samples(df, roles), roles, opts.enable_ast_extract), roles, opts)


def prepare(
    df: DataFrame,
    roles: ColumnRoles,
    opts: PrepOptions = PrepOptions(),
    by: list[str] | str = (),
    verdicts: DataFrame | None = None,
    save: Callable[[DataFrame, str], DataFrame] = stage,
) -> Prepared:
    """Prepare one or, with ``by``, many data sets in one go.

    Two wide tables are written: the parsed rows with the hashes of text and tree, because parsing
    is the dear step and the duplicate search reads keys and hashes of them alone, and the tagged
    rows, because cleaned rows, bad cases, pairs and metrics are all scans of them. They carry a
    narrow struct of facts, so metrics and log read no text column. ``save`` does the writing
    and returns a scan of what it wrote; ``Prepared.release`` deletes it.

    A user's columns keep their values. Those whose names the library needs (``signature``,
    ``verdict``, ``drop_reason`` and the like) come out as ``user_<name>``."""
    by = as_list(by)
    df = _freed(df, roles, by)
    if ROW_ID not in df.columns:
        df = with_row_id(df)
    rows = extract_functions(normalize_samples(df, roles), roles, opts.enable_ast_extract)
    return _finish(rows, roles, opts, by, verdicts, save)


def refine(previous: Prepared, opts: PrepOptions, verdicts: DataFrame | None = None) -> Prepared:
    """Another round over the same rows with other options or new verdicts. The parsed rows of
    the previous round are used again, so nothing is parsed a second time."""
    if opts.enable_ast_extract != previous.opts.enable_ast_extract:
        raise ValueError("extraction cannot be switched between rounds; prepare the rows again")
    parsed = previous.parsed
    rows = parsed.drop(*[c for c in (DROP_STAGE, DROP_REASON, VERDICT) if is_engine(parsed, c)])
    return _finish(rows, previous.roles, opts, previous.by, verdicts, previous.save)


def _tag(rows: DataFrame, roles: ColumnRoles, opts: PrepOptions) -> DataFrame:
    return tag_low_quality(tag_invalid(rows, roles, opts), roles, opts.docstring_min_len)


def _finish(
    rows: DataFrame,
    roles: ColumnRoles,
    opts: PrepOptions,
    by: list[str],
    verdicts: DataFrame | None,
    save: Callable[[DataFrame, str], DataFrame],
) -> Prepared:
    clock: dict[str, int] = {}
    written: list[DataFrame] = []

    def write(frame: DataFrame, name: str) -> DataFrame:
        written.append(save(frame, name))
        return written[-1]

    def timed(name: str, frame: DataFrame) -> DataFrame:
        start = time.monotonic()
        saved = write(frame, name)
        clock[name] = int((time.monotonic() - start) * 1000)
        return saved

    if not is_engine(rows, TEXT_HASH):
        rows = with_hashes(rows, roles.code)
    rows = _tag(rows, roles, opts)
    if verdicts is not None:
        rows = apply_verdicts(rows, verdicts)
    parsed = timed("extract_functions", rows)
    tagged = tag_duplicates(parsed, roles, opts.enable_dedup, opts.enable_dedup and opts.enable_ast_dedup, by, write)
    tagged = tagged.select("*", engine(F.lit(False), IS_AUGMENTED), engine(met.row_facts(tagged, roles), FACTS))
    tagged = timed(DEDUP_STAGE, tagged)
    if opts.enable_augmentation:
        kept = survivors(tagged)
        renamed = with_hashes(aug.augment_rename(kept.drop(TREE_HASH, FACTS), roles), roles.code)
        new = timed(aug.AUGMENT_STAGE, renamed.select("*", engine(met.row_facts(renamed, roles), FACTS)))
        tagged = tagged.unionByName(timed("augment_tags", aug.tag_augmented(kept, new, roles, by)))
    return Prepared(parsed, tagged, roles, opts, by, clock, save, written)
