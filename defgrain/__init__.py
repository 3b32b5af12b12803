"""Preparation of Python code and docstring corpora as Spark DataFrame operators."""

from .config import ColumnRoles, PrepOptions
from .plans.prepare import Prepared, prepare, refine, tag_rows
from .sources.readers import read_csv, read_head, read_jsonl, read_parquet, with_row_id

__all__ = [
    "ColumnRoles",
    "PrepOptions",
    "Prepared",
    "prepare",
    "refine",
    "tag_rows",
    "read_csv",
    "read_head",
    "read_jsonl",
    "read_parquet",
    "with_row_id",
]
