"""Row-wise normalisation of the code and docstring columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import ColumnRoles
from ..functions.text import normalize_code, normalize_docstring


def normalize_samples(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    """Normalise the role columns in place; NULL stays NULL and other types become strings."""
    roles.check(df)
    changed = {roles.code: normalize_code(roles.code)}
    if roles.docstring:
        changed[roles.docstring] = normalize_docstring(roles.docstring)
    return df.withColumns(changed)
