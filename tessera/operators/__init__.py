"""Rule operators (row and dataset level), custom rules and DataFrame upserts."""

from tessera.operators.context import RuleContext
from tessera.operators.custom import CustomRules, default_custom_rules
from tessera.operators.dataset_rules import DATASET_RULES
from tessera.operators.row_rules import ROW_RULES

BUILT_IN_RULES = sorted(set(ROW_RULES) | set(DATASET_RULES))


def rule_level(name: str) -> str | None:
    if name in ROW_RULES:
        return "ROW"
    if name in DATASET_RULES:
        return "DATASET"
    return None


__all__ = [
    "RuleContext", "CustomRules", "default_custom_rules", "DATASET_RULES",
    "ROW_RULES", "BUILT_IN_RULES", "rule_level",
]
