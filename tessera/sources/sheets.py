"""Configuration sheets: CSV / JSON exports of a spreadsheet, or any
DataFrame, read as all-string with blanks as ''."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class MissingColumnsError(ValueError):
    pass


def load_sheet(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Read one sheet export. Every column is read as STRING (no inference)
    and NULL becomes ''. Excel workbooks must be exported first."""
    if fmt == "csv":
        df = (spark.read.option("header", True).option("multiLine", True)
              .option("escape", '"').option("inferSchema", False).csv(path))
    elif fmt == "json":
        df = spark.read.option("primitivesAsString", True).json(path)
    else:
        raise ValueError(f"unsupported sheet format '{fmt}'")
    return as_sheet(df)


def as_sheet(df: DataFrame) -> DataFrame:
    """Any DataFrame as a sheet: all columns STRING, NULL -> ''."""
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def require_columns(df: DataFrame, required: list[str], sheet: str) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"sheet '{sheet}' lacks required columns: {missing}")
