"""Registered queries: name -> (Spark query, equivalent SQL or None)."""

from .reports import CATALOG as _REPORTS
from .rows import CATALOG as _ROWS
from .sources import CATALOG as _SOURCES

CATALOG = {**_SOURCES, **_ROWS, **_REPORTS}
