"""Scalar functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(col: str) -> Column:
    """Distinct Unicode words."""
    return F.array_distinct(F.regexp_extract_all(F.col(col), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def tokens(col: str) -> Column:
    """Distinct white-space tokens."""
    return F.array_distinct(F.filter(F.split(F.trim(F.col(col)), r"\s+"), lambda x: x != ""))


def ngrams(col: str, n: int) -> Column:
    """All character n-grams; none in a shorter text (F8)."""
    c = F.col(col)
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def canonical_id(col: str) -> Column:
    """GO:ddddddd in upper case, or null."""
    c = F.upper(F.trim(F.col(col)))
    return F.when(c.rlike(r"^GO:[0-9]{7}$"), c)


def unescape(c: Column) -> Column:
    """Backslash escapes: n, t, r for themselves, any other character for itself (F1). Pieces between backslashes are
    taken in pairs, so that an escaped backslash never starts another escape."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)\\.|[^\\]+|\\$"), F.lit(0))
    one = lambda p: F.when(p == "\\n", "\n").when(p == "\\t", "\t").when(p == "\\r", "\r").when(p.startswith("\\"), F.substring(p, 2, 1)).otherwise(p)
    return F.array_join(F.transform(parts, one), "")


def quoted(c: Column) -> tuple[Column, Column]:
    """A leading quoted string, unescaped, and what follows (F2); null if unterminated."""
    pattern = r'(?s)^"((?:\\.|[^"\\])*)"(.*)$'
    ok = c.rlike(pattern)
    return F.when(ok, unescape(F.regexp_extract(c, pattern, 1))), F.when(ok, F.trim(F.regexp_extract(c, pattern, 2)))


def mentions(col: str, pattern: str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.col(col), F.lit(pattern), F.lit(0))))


def host(col: str) -> Column:
    """The host of a URL in lower case, a bracketed address without its brackets; '' where there is none."""
    c = F.regexp_extract(F.lower(F.col(col)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.regexp_replace(c, r"[\[\]]", "")


def is_loopback(col: str) -> Column:
    """Whether a URL leads to this machine."""
    return host(col).isin("localhost", "127.0.0.1", "::1")
