"""Plain configuration objects: which columns play which role, and which steps run."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

ROW_ID = "_row_id"
FN_ORD = "_fn_ord"
IS_AUGMENTED = "is_augmented"
FACTS = "_facts"
CORRUPT = "_corrupt_record"
VERDICT = "verdict"
DROP_STAGE = "drop_stage"
DROP_REASON = "drop_reason"


@dataclass(frozen=True)
class ColumnRoles:
    """Names of the columns that hold code, documentation and language."""

    code: str
    docstring: str | None = None
    language: str | None = None

    def __post_init__(self) -> None:
        # A missing code role would make every step a silent no-op, so it is refused.
        if not self.code:
            raise ValueError("a code column is required; pass ColumnRoles(code=...)")

    def check(self, df: DataFrame) -> None:
        missing = [c for c in (self.code, self.docstring, self.language) if c and c not in df.columns]
        if missing:
            raise ValueError(f"columns not found: {missing}; have {df.columns}")


@dataclass(frozen=True)
class PrepOptions:
    """Step switches and the thresholds of the filters, in characters."""

    enable_dedup: bool = True
    enable_ast_dedup: bool = True
    enable_ast_extract: bool = True
    enable_augmentation: bool = False
    enable_instruction_pairs: bool = True
    docstring_min_len: int = 5
    code_min_len: int = 10
    code_max_len: int = 8000
    docstring_max_len: int = 2000


def key_columns(df: DataFrame) -> list[str]:
    """Columns that identify a row: the row id, refined by function and augmentation."""
    return [c for c in (ROW_ID, FN_ORD, IS_AUGMENTED) if c in df.columns]


def as_list(names: str | Iterable[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


# Columns of the library's own that never reach an output.
INTERNAL = (ROW_ID, FN_ORD, FACTS, CORRUPT, "_text_hash", "_tree_hash")

_MARK = {"defgrain": True}


def engine(column: Column, name: str) -> Column:
    """``column`` under a name that the library gives it. The mark in the column's metadata tells it
    from a user's column of the same name; it survives selection and writing."""
    return column.alias(name, metadata=_MARK)


def is_engine(df: DataFrame, name: str) -> bool:
    return name in df.columns and bool(df.schema[name].metadata.get("defgrain"))


def set_aside(df: DataFrame, names: Iterable[str], roles: ColumnRoles | None = None) -> DataFrame:
    """Free the names for the library's columns: earlier ones of its own go, a user's column stays
    as ``user_<name>``. Columns with a role cannot be renamed under the caller's feet."""
    taken = [n for n in names if n in df.columns]
    own = [n for n in taken if is_engine(df, n)]
    renamed = {}
    for name in (n for n in taken if n not in own):
        if roles and name in (roles.code, roles.docstring, roles.language):
            raise ValueError(f"rename the column {name!r} first; its name is that of a derived column")
        new = f"user_{name}"
        while new in df.columns or new in renamed.values():
            new = f"user_{new}"
        renamed[name] = new
    return df.drop(*own).withColumnsRenamed(renamed)
