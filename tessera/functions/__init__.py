"""Scalar Column builders shared by rules, config shaping and the ledger."""

from tessera.functions.keys import as_text, evidence_id, pk_text
from tessera.functions.lists import comma_list, parse_comma_list, split_tags
from tessera.functions.national_id import (
    national_id_ok_strict,
    register_sql_function,
)

__all__ = [
    "as_text", "evidence_id", "pk_text", "comma_list",
    "parse_comma_list", "split_tags",
    "national_id_ok_strict", "register_sql_function",
]
