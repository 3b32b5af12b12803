"""Column expressions over text. Everything here stays inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 code points that count as whitespace when stripping.
WS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Strip Unicode whitespace on both sides; ``trim`` alone only knows U+0020."""
    return F.btrim(_col(c), F.lit(WS))


def normalize_code(c: str | Column) -> Column:
    """Unix line ends, four-space tabs, no surrounding whitespace."""
    text = F.replace(_col(c).cast("string"), F.lit("\r\n"), F.lit("\n"))
    text = F.replace(text, F.lit("\r"), F.lit("\n"))
    return strip(F.replace(text, F.lit("\t"), F.lit("    ")))


def normalize_docstring(c: str | Column) -> Column:
    """Strip, peel one pair of triple quotes, squeeze runs of blanks but keep newlines."""
    text = strip(_col(c).cast("string"))
    long_enough = F.length(text) >= 6

    def quoted(q: str) -> Column:
        return long_enough & F.startswith(text, F.lit(q)) & F.endswith(text, F.lit(q))

    inner = F.substring(text, F.lit(4), F.length(text) - 6)
    peeled = F.when(quoted('"""') | quoted("'''"), strip(inner)).otherwise(text)
    return strip(F.regexp_replace(peeled, "[ \\t]+", " "))


def is_blank(c: str | Column) -> Column:
    """True for NULL, empty and whitespace-only text."""
    c = _col(c)
    return c.isNull() | (strip(c) == "")


def is_present(c: str | Column) -> Column:
    """True for text that is neither NULL nor the empty string (blanks count as present)."""
    return F.coalesce(_col(c) != "", F.lit(False))


def sha256_hex(c: str | Column) -> Column:
    """Hex SHA-256 of the UTF-8 bytes."""
    return F.sha2(_col(c), 256)


def sha256_bin(c: str | Column) -> Column:
    """Same digest as 32 raw bytes: half the size of the hex form in a shuffle."""
    return F.unhex(sha256_hex(c))


def char_length(c: str | Column) -> Column:
    """Length in code points."""
    return F.length(_col(c))


def substring_match(c: str | Column, keywords: Iterable[str]) -> Column:
    """True when the lower-cased text contains any keyword; NULL text never matches."""
    text = F.lower(_col(c))
    hit = F.lit(False)
    for word in keywords:
        hit = hit | F.contains(text, F.lit(word))
    return F.coalesce(hit, F.lit(False))


def looks_like_functions(c: str | Column) -> Column:
    c = _col(c)
    return F.coalesce(F.contains(c, F.lit("def ")) | F.contains(c, F.lit("class ")), F.lit(False))
