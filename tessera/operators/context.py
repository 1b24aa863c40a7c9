"""What a rule needs besides its parameters."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, TimestampNTZType, TimestampType

_ISO_DATE = re.compile(r"^\d{4}-\d{2}-\d{2}$")
_ISO_TIMESTAMP = re.compile(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$")


@dataclass
class RuleContext:
    spark: SparkSession
    # table name -> DataFrame, used by rules that read a second table
    resolve: Callable[[str], DataFrame] | None = None
    # rule names whose string 'value' / 'limit' are literals, not expressions
    literal_rules: frozenset = field(default_factory=frozenset)
    # reference time for 'is_not_in_future'; None = current_timestamp()
    as_of: datetime | str | None = None
    # 'rows': a failing dataset rule flags every perimeter row (as the
    # original engine does); 'summary': one evidence row with the aggregate
    aggregate_evidence: str = "rows"
    # writes a DataFrame that a rule reads more than once and returns it as
    # read back; None: it is planned again where it is read
    stage: Callable[[DataFrame], DataFrame] | None = None

    def table(self, name: str) -> DataFrame:
        if self.resolve is not None:
            return self.resolve(name)
        return self.spark.table(name)


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def type_of(df: DataFrame, c) -> DataType:
    """Data type of a column: from the (cached) schema for a plain column
    name, else by analysing a projection (no job)."""
    if isinstance(c, str):
        for f in df.schema.fields:
            if f.name == c:
                return f.dataType
    return df.select(col_of(c)).schema.fields[0].dataType


def operand(value, literal: bool = False, dtype: DataType | None = None) -> Column:
    """A rule parameter as a Column.

    Numbers and booleans are literals. A string is a literal when the rule
    asks for literal conversion; otherwise an ISO date / timestamp becomes a
    typed literal (as an expression ``2024-01-01`` would be arithmetic) and
    any other string is a SQL expression, e.g. a column name.
    """
    if isinstance(value, Column):
        return value
    if value is None or isinstance(value, (bool, int, float)):
        return F.lit(value)
    if isinstance(value, str):
        if literal:
            return F.lit(value)
        if _ISO_DATE.match(value):
            if isinstance(dtype, (TimestampType, TimestampNTZType)):
                return F.lit(value).cast(dtype)
            return F.lit(value).cast(DateType())
        if _ISO_TIMESTAMP.match(value):
            target = dtype if isinstance(dtype, (TimestampType, TimestampNTZType)) else TimestampType()
            return F.lit(value).cast(target)
        return F.expr(value)
    return F.lit(value)
