"""Metrics of a data set that grows: counts per part are stored and added up, earlier parts are never
read again.

Each part is a commit, so a part that is counted again replaces its counts. Later copies are found
against the index of hashes (``kept_index``); how many rows each rule removes does not depend on the
order of the parts, while averages over kept rows depend on which copy came first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..config import ColumnRoles, PrepOptions
from ..sources.commits import compact, read_commits, write_commit
from . import kept_index
from .metrics import metric_counts, metrics_of_counts


def add_part(
    tagged: DataFrame,
    roles: ColumnRoles,
    root: str,
    part: str,
    opts: PrepOptions = PrepOptions(),
    by: list[str] | str = (),
) -> None:
    """Store the counts of a part, a row per data set, in one pass over its tagged rows."""
    write_commit(metric_counts(tagged, roles, opts, by), root, part)


def merged_metrics(spark: SparkSession, root: str, by: list[str] | str = ()) -> DataFrame:
    """What ``tag_metrics`` gives for all parts together; reads the stored counts alone."""
    return metrics_of_counts(read_commits(spark, root), by)


def compact_parts(spark: SparkSession, root: str) -> None:
    """Merge the small files of many parts."""
    compact(spark, root)


def counting_sink(
    roles: ColumnRoles,
    root: str,
    index: str,
    save: Callable[[DataFrame, str], DataFrame],
    opts: PrepOptions = PrepOptions(),
    by: list[str] | str = (),
) -> Callable[[DataFrame, int], None]:
    """A sink for streams of tagged rows: each batch loses its later copies and is counted as a part. A
    batch that is run again writes the same parts, so nothing is counted twice."""

    def count(batch: DataFrame, batch_id: int) -> None:
        part = f"batch-{batch_id}"
        rows = save(batch, "batch")
        tagged = kept_index.tag_load(rows, roles, index, part, save, by=by) if opts.enable_dedup else rows
        add_part(tagged, roles, root, part, opts, by)

    return count
