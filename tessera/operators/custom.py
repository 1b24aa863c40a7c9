"""Custom rules: user functions over named columns.

Three kinds, looked up by the rule's technical name:

* column rules -- ``fn(columns) -> Column`` giving TRUE for a valid row
  (FALSE fails, NULL passes); they join the shared single-pass scan;
* SQL functions -- any function a user created in the session or its catalog
  (temporary or persistent), called as ``name(`c1`, `c2`, ...)``; FALSE fails, NULL passes;
* frame rules -- ``fn(df, columns) -> failing DataFrame`` for logic that needs
  the whole frame. Python callables registered here run as Spark plans;
  they must not collect data.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.national_id import (
    SQL_FUNCTION_NAME,
    national_id_ok_strict,
    register_sql_function,
)


class CustomRules:
    def __init__(self):
        self.column_rules: dict[str, Callable[[list[str]], Column]] = {}
        self.frame_rules: dict[str, Callable[[DataFrame, list[str]], DataFrame]] = {}
        self.sql_functions: set[str] = set()

    def register_column_rule(self, name: str, fn: Callable[[list[str]], Column]) -> None:
        self.column_rules[name] = fn

    def register_frame_rule(self, name: str, fn: Callable[[DataFrame, list[str]], DataFrame]) -> None:
        self.frame_rules[name] = fn

    def register_sql_function(self, name: str) -> None:
        self.sql_functions.add(name)

    def kind(self, spark: SparkSession, name: str) -> str | None:
        if name in self.column_rules:
            return "column"
        if name in self.frame_rules:
            return "frame"
        if name in self.sql_functions or self._user_defined(spark, name):
            return "sql"
        return None

    @staticmethod
    def _user_defined(spark: SparkSession, name: str) -> bool:
        """Functions that users created, temporary or in the catalog; Spark's
        own functions are not rules."""
        last = name.split(".")[-1].strip("`").lower()
        if not last.isidentifier():
            return False
        shown = [r[0].lower() for r in spark.sql(f"SHOW USER FUNCTIONS LIKE '{last}'").collect()]
        return any(f == name.lower() or f.endswith("." + name.lower()) for f in shown)

    def ok_expression(self, spark: SparkSession, name: str, columns: list[str]) -> Column:
        """The rule's verdict: TRUE valid, FALSE failing, NULL passes."""
        if not columns:
            raise ValueError(f"custom rule '{name}' has no columns")
        kind = self.kind(spark, name)
        if kind == "column":
            return self.column_rules[name](columns)
        if kind == "sql":
            args = ", ".join(f"`{c}`" for c in columns)
            return F.expr(f"{name}({args})")
        raise KeyError(f"custom rule '{name}' is not registered")

    def failing_condition(self, spark: SparkSession, name: str, columns: list[str]) -> Column:
        """TRUE for a failing row (column and SQL-function rules)."""
        return ~self.ok_expression(spark, name, columns)

    def failing_frame(self, name: str, df: DataFrame, columns: list[str]) -> DataFrame:
        if not columns:
            raise ValueError(f"custom rule '{name}' has no columns")
        return self.frame_rules[name](df, columns)


def default_custom_rules(spark: SparkSession | None = None) -> CustomRules:
    """Registry with the national-id checks: the strict column rule under
    ``custom_validate_dni`` and the SQL function ``is_valid_nif_es``."""
    rules = CustomRules()
    rules.register_column_rule("custom_validate_dni", lambda cols: national_id_ok_strict(F.col(cols[0])))
    if spark is not None:
        register_sql_function(spark, SQL_FUNCTION_NAME)
        rules.register_sql_function(SQL_FUNCTION_NAME)
    return rules
