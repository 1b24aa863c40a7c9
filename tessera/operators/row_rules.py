"""Row-level built-in rules.

Each builder takes ``(df, params, ctx)`` and returns a boolean Column that is
TRUE for a failing row. A NULL verdict passes: a row fails only when the
check is definitely false, unless the rule's name says NULL is a failure
(``is_not_null``...). Builders only analyse ``df`` (no Spark job), so many
rules can be folded into one scan.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DateType,
    StringType,
    TimestampNTZType,
    TimestampType,
)

from tessera.operators.context import RuleContext, col_of, operand, type_of


def _column(params: dict) -> Column:
    name = params.get("column")
    if not name:
        raise ValueError("rule needs a 'column' parameter")
    return col_of(name)


def _as_text(c: Column) -> Column:
    return c.cast("string")


def is_not_null(df: DataFrame, params: dict, ctx: RuleContext) -> Column:
    return _column(params).isNull()


def is_not_empty(df: DataFrame, params: dict, ctx: RuleContext) -> Column:
    return _as_text(_column(params)) == F.lit("")


def is_not_null_and_not_empty(df: DataFrame, params: dict, ctx: RuleContext) -> Column:
    c = _column(params)
    return c.isNull() | (_as_text(c) == F.lit(""))


def is_not_in_future(df: DataFrame, params: dict, ctx: RuleContext) -> Column:
    c = _column(params)
    dtype = type_of(df, params["column"])
    as_of = params.get("as_of", ctx.as_of)
    if as_of is None:
        now = F.current_timestamp()
    elif isinstance(as_of, (datetime, date)):
        now = F.lit(as_of)
    else:
        now = F.lit(str(as_of))
    if isinstance(dtype, (TimestampNTZType, TimestampType, DateType)):
        now = now.cast(TimestampNTZType()) if isinstance(dtype, TimestampNTZType) else now.cast(TimestampType())
        return c > now
    return c.cast(TimestampType()) > now.cast(TimestampType())


def _allowed_literals(df: DataFrame, name: str, allowed: list) -> list[Column]:
    """Allowed values typed like the column, from their text, so that a
    decimal keeps all its digits; a value that cannot take the column's type
    is NULL and never equal."""
    dtype = type_of(df, name)
    return [F.lit(str(v)) if isinstance(dtype, StringType) else F.lit(str(v).strip()).try_cast(dtype) for v in allowed]


def _not_in_list(df: DataFrame, params: dict) -> Column:
    c = _column(params)
    allowed = params.get("allowed")
    if not allowed:
        raise ValueError("rule needs a non-empty 'allowed' list")
    values = _allowed_literals(df, params["column"], allowed)
    # isin with a NULL-valued literal would turn misses into NULL (= pass)
    return ~F.coalesce(c.isin(*values), F.lit(False)) & c.isNotNull()


def is_in_list(df: DataFrame, params: dict, ctx: RuleContext) -> Column:
    return _not_in_list(df, params)


def is_not_null_and_is_in_list(df: DataFrame, params: dict, ctx: RuleContext) -> Column:
    return _column(params).isNull() | _not_in_list(df, params)


def regex_match(df: DataFrame, params: dict, ctx: RuleContext) -> Column:
    regex = params.get("regex")
    if regex is None:
        raise ValueError("regex_match needs a 'regex' parameter")
    # find semantics: the pattern may match anywhere unless anchored
    return ~_as_text(_column(params)).rlike(regex)


def _value(df: DataFrame, params: dict, ctx: RuleContext, key: str, rule: str) -> Column:
    if key not in params:
        raise ValueError(f"{rule} needs a '{key}' parameter")
    return operand(params[key], literal=rule in ctx.literal_rules, dtype=type_of(df, params["column"]))


def is_equal_to(df: DataFrame, params: dict, ctx: RuleContext) -> Column:
    return _column(params) != _value(df, params, ctx, "value", "is_equal_to")


def is_not_equal_to(df: DataFrame, params: dict, ctx: RuleContext) -> Column:
    return _column(params) == _value(df, params, ctx, "value", "is_not_equal_to")


def is_valid_date(df: DataFrame, params: dict, ctx: RuleContext) -> Column:
    c = _column(params)
    fmt = params.get("date_format")
    parsed = F.try_to_timestamp(_as_text(c), F.lit(fmt)) if fmt else c.try_cast(DateType())
    return c.isNotNull() & parsed.isNull()


def is_valid_timestamp(df: DataFrame, params: dict, ctx: RuleContext) -> Column:
    c = _column(params)
    fmt = params.get("timestamp_format")
    parsed = F.try_to_timestamp(_as_text(c), F.lit(fmt)) if fmt else c.try_cast(TimestampType())
    return c.isNotNull() & parsed.isNull()


def _limits(df: DataFrame, params: dict, ctx: RuleContext, rule: str):
    c = _column(params)
    dtype = type_of(df, params["column"])
    lo = params.get("min_limit")
    hi = params.get("max_limit")
    if lo is None and hi is None:
        raise ValueError(f"{rule} needs 'min_limit' and/or 'max_limit'")
    lo = None if lo is None else operand(lo, dtype=dtype)
    hi = None if hi is None else operand(hi, dtype=dtype)
    return c, lo, hi


def is_in_range(df: DataFrame, params: dict, ctx: RuleContext) -> Column:
    c, lo, hi = _limits(df, params, ctx, "is_in_range")
    below = F.lit(False) if lo is None else c < lo
    above = F.lit(False) if hi is None else c > hi
    return below | above


def is_not_in_range(df: DataFrame, params: dict, ctx: RuleContext) -> Column:
    c, lo, hi = _limits(df, params, ctx, "is_not_in_range")
    ge = F.lit(True) if lo is None else c >= lo
    le = F.lit(True) if hi is None else c <= hi
    return ge & le


def is_not_less_than(df: DataFrame, params: dict, ctx: RuleContext) -> Column:
    return _column(params) < _value(df, params, ctx, "limit", "is_not_less_than")


def is_not_greater_than(df: DataFrame, params: dict, ctx: RuleContext) -> Column:
    return _column(params) > _value(df, params, ctx, "limit", "is_not_greater_than")


def sql_expression(df: DataFrame, params: dict, ctx: RuleContext) -> Column:
    expression = params.get("expression")
    if not expression:
        raise ValueError("sql_expression needs an 'expression' parameter")
    return ~F.expr(expression)


ROW_RULES = {
    "is_not_null": is_not_null,
    "is_not_empty": is_not_empty,
    "is_not_null_and_not_empty": is_not_null_and_not_empty,
    "is_not_in_future": is_not_in_future,
    "is_in_list": is_in_list,
    "is_not_null_and_is_in_list": is_not_null_and_is_in_list,
    "regex_match": regex_match,
    "is_equal_to": is_equal_to,
    "is_not_equal_to": is_not_equal_to,
    "is_valid_date": is_valid_date,
    "is_valid_timestamp": is_valid_timestamp,
    "is_in_range": is_in_range,
    "is_not_in_range": is_not_in_range,
    "is_not_less_than": is_not_less_than,
    "is_not_greater_than": is_not_greater_than,
    "sql_expression": sql_expression,
}


def failing(df: DataFrame, rule: str, params: dict, ctx: RuleContext) -> DataFrame:
    """Rows of ``df`` failing one row rule (the single-rule filter form)."""
    cond = ROW_RULES[rule](df, params, ctx)
    return df.filter(F.coalesce(cond, F.lit(False)))
