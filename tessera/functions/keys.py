"""Evidence keys: primary-key text, failed-value text and evidence ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.lists import parse_comma_list

# Marker for a NULL part inside a composite key or an id hash.
NULL_TAG = "\\N"


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def as_text(c) -> Column:
    """Any value flattened to STRING, as evidence stores it."""
    return _col(c).cast("string")


def pk_columns(primary_key: str | list[str]) -> list[str]:
    return parse_comma_list(primary_key) if isinstance(primary_key, str) else list(primary_key)


def _parts(cols: list, mark: str) -> Column:
    """Values joined by ``mark``, reversibly: the mark and the backslash are
    escaped inside values, and a NULL is a tag no value can spell."""
    def part(c) -> Column:
        text = F.replace(as_text(c), F.lit("\\"), F.lit("\\\\"))
        return F.coalesce(F.replace(text, F.lit(mark), F.lit("\\" + mark)), F.lit(NULL_TAG))
    return F.concat_ws(mark, *[part(c) for c in cols])


def pk_text(primary_key: str | list[str]) -> Column:
    """One column -> its text; several -> parts joined by '|' (escaped, NULL tagged)."""
    cols = pk_columns(primary_key)
    if len(cols) == 1:
        return as_text(F.col(cols[0]))
    return _parts([F.col(c) for c in cols], "|")


def evidence_id(execution_id, validation_id, table_pk, failed_value) -> Column:
    """Deterministic evidence id: a rerun of the same execution yields the
    same ids, so duplicates can be detected instead of being random."""
    return F.sha2(_parts([execution_id, validation_id, table_pk, failed_value], "#"), 256)
