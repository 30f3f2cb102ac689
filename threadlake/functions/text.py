"""Scalar text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(col: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(F.col(col) if isinstance(col, str) else col, r"^\s+|\s+$", "")


def is_blank(col: Column | str) -> Column:
    """True where the text is null, empty or only white space."""
    c = F.col(col) if isinstance(col, str) else col
    return c.isNull() | ~c.rlike(r"\S")


def folded(col: Column | str) -> Column:
    """Lower case without outer white space."""
    return F.lower(strip(col))


def utf8_size(col: Column | str) -> Column:
    """Tokens of a byte-level vocabulary: one per UTF-8 byte; null counts as 0."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint")
