"""Run history: stage logs, metric records and output lists of all runs, as tables of commits
partitioned by run so that reading one run touches its files only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import compact, read_commits, write_commit

STAGE_LOG = "stage_log"
RUN_REPORT = "run_report"
RUN_FILES = "run_files"


def append_run(
    root: str,
    log: DataFrame,
    report: DataFrame,
    files: DataFrame | None = None,
    run_id: str = "run_id",
    commit: str | None = None,
) -> None:
    """Append one or many runs. All tables carry the run column; the report also gets the time
    of writing, by which the latest report of a run is found. Appending again under the same ``commit``
    replaces what was appended, so a retry adds nothing twice; without a name every call is new."""
    commit = commit or uuid.uuid4().hex
    parts = {STAGE_LOG: log, RUN_REPORT: report.withColumn("written_at", F.current_timestamp()), RUN_FILES: files}
    for name, df in parts.items():
        if df is not None:
            write_commit(df, f"{root}/{name}", commit, run_id)


def read_all(spark: SparkSession, root: str, name: str, run_id: str = "run_id") -> DataFrame:
    """The rows of all runs of one of the three tables."""
    return read_commits(spark, f"{root}/{name}", run_id)


def compact_runs(spark: SparkSession, root: str, run_id: str = "run_id") -> None:
    """Merge the many small files of a long history into few, ordered by run so that their statistics
    still keep a run's readers from the others."""
    for name in (STAGE_LOG, RUN_REPORT, RUN_FILES):
        compact(spark, f"{root}/{name}", run_id)


def read_log(spark: SparkSession, root: str, run: str, run_id: str = "run_id") -> DataFrame:
    """Steps of one run in order; the filter prunes to the run's folder."""
    return read_all(spark, root, STAGE_LOG, run_id).where(F.col(run_id) == run).orderBy("ord")


def read_files(spark: SparkSession, root: str, run: str, run_id: str = "run_id") -> DataFrame:
    """Outputs of one run without its raw input."""
    files = read_all(spark, root, RUN_FILES, run_id)
    return files.where((F.col(run_id) == run) & (F.col("file_role") != "raw"))


def read_report(spark: SparkSession, root: str, run: str, run_id: str = "run_id") -> DataFrame:
    """Latest report of one run."""
    reports = read_all(spark, root, RUN_REPORT, run_id).where(F.col(run_id) == run)
    return reports.orderBy(F.desc("written_at")).limit(1)


def read_reports(spark: SparkSession, root: str, run_id: str = "run_id") -> DataFrame:
    """The latest report of every run, from the whole history: what comparisons, alerts and trends
    start from. One map-side combined ``max_by`` over the narrow reports."""
    reports = read_all(spark, root, RUN_REPORT, run_id)
    rest = [c for c in reports.columns if c not in (run_id, "written_at")]
    latest = reports.groupBy(run_id).agg(
        F.max_by(F.struct(*rest), "written_at").alias("_report"), F.max("written_at").alias("written_at")
    )
    return latest.select(run_id, "_report.*", "written_at")
