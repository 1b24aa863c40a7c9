"""Comma lists as written in configuration sheets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_comma_list(text: str | None) -> list[str]:
    """'a, b,, c ' -> ['a', 'b', 'c'] (driver side, for small config values)."""
    if not text:
        return []
    return [part.strip() for part in text.split(",") if part and part.strip()]


def comma_list(c: Column | str) -> Column:
    """Column version of :func:`parse_comma_list`: trimmed, blanks dropped."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def split_tags(c: Column | str) -> Column:
    """Tag list: split on a comma plus optional blanks, blank entries dropped.

    A blank cell gives an empty array rather than ``['']``.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(c, r",\s*"), lambda x: x != "")
