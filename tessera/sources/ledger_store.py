"""Storage of the configuration and ledger tables as parquet datasets.

Ledger tables are append-only and partitioned by ``execution_date``, so
readers that filter on the date prune partitions. Every append is a leaf of its
own, ``<table>/execution_date=<day>/<leaf>``: it is written to a hidden folder
that no other job uses and then moved into place, so appends of several runs do
not meet, a killed one leaves nothing that readers see, and a repeated one
replaces its leaf. Configuration tables are small and replaced whole on every
sync: the new contents are complete before the old ones go.
"""

from __future__ import annotations

import re
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.upsert import conform
from tessera.schemas import CONFIG_SCHEMAS, LEDGER_SCHEMAS
from tessera.sources.catalog import path_exists

EXECUTIONS = "dq_execution_traceability"
RESULTS = "dq_validations_traceability"
EVIDENCES = "dq_evidences"
EVENTS = "dq_execution_events"
TABLES = "dq_tables_config"
RULES = "dq_rules_library"
VALIDATIONS = "dq_validations_catalog"


def leaf_name(*parts: str) -> str:
    """A folder name for one append, made of ids; ids with other characters
    than letters, digits, ``.`` and ``-`` are told apart by a checksum."""
    text = "-".join(parts)
    plain = re.sub(r"[^A-Za-z0-9.-]", "-", text)
    return f"run-{plain}" if plain == text else f"run-{plain}-{zlib.crc32(text.encode()):08x}"


class Store:
    """Config and ledger tables under one base path (local, HDFS or object
    store -- anything the Hadoop filesystem layer resolves)."""

    def __init__(self, spark: SparkSession, base_path: str):
        self.spark = spark
        self.base = base_path.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def exists(self, name: str) -> bool:
        return path_exists(self.spark, self.path(name))

    def schema(self, name: str):
        return LEDGER_SCHEMAS.get(name) or CONFIG_SCHEMAS[name]

    def read(self, name: str) -> DataFrame:
        """Whole table. The fixed schema is given, so no footer is read for
        inference; columns missing in older files read as NULL."""
        schema = self.schema(name)
        if self.exists(name):
            return self.spark.read.schema(schema).parquet(self.path(name))
        if name in CONFIG_SCHEMAS and path_exists(self.spark, f"{self._new(name)}/_SUCCESS"):
            return self.spark.read.schema(schema).parquet(self._new(name))      # a replace cut short
        return self.spark.createDataFrame([], schema)

    def read_days(self, name: str, days) -> DataFrame:
        """Some ``execution_date`` partitions of a ledger table in one scan,
        listing only their folders (not the whole history)."""
        schema = self.schema(name)
        parts = [p for d in sorted({str(d) for d in days}) if path_exists(self.spark, p := f"{self.path(name)}/execution_date={d}")]
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path(name)).parquet(*parts)

    def read_day(self, name: str, day) -> DataFrame:
        """One ``execution_date`` partition of a ledger table, listing only
        that folder (not the whole history)."""
        return self.read_days(name, [day])

    def create_tables(self) -> list[str]:
        """Set-up step: create the six config and ledger tables (empty, with
        their fixed schemas and partitioning) where they do not exist yet."""
        created = []
        for name in list(CONFIG_SCHEMAS) + list(LEDGER_SCHEMAS):
            if name == EVENTS or self.exists(name):     # the event log begins with the first run
                continue
            empty = self.spark.createDataFrame([], self.schema(name))
            writer = empty.write.mode("overwrite")
            if name in LEDGER_SCHEMAS:
                writer = writer.partitionBy("execution_date")
            writer.parquet(self.path(name))
            created.append(name)
        return created

    def append(self, name: str, df: DataFrame, leaf: str | None = None, day=None) -> None:
        """Append rows conformed to the fixed schema (missing columns NULL).
        An append with the ``leaf`` of an earlier one replaces its rows of the
        same days, and of ``day`` even if there are none now."""
        out = conform(df, self.schema(name))
        if name not in LEDGER_SCHEMAS:
            out.write.mode("append").parquet(self.path(name))
            return
        leaf = leaf or f"add-{uuid.uuid4().hex}"
        root, hidden = self.path(name), f"{self.path(name)}/_{leaf}-{uuid.uuid4().hex}"
        out.write.partitionBy("execution_date").parquet(hidden)
        fs, at = self._fs(root)
        written = {s.getPath().getName() for s in fs.listStatus(at(hidden)) if s.isDirectory()}
        if day is not None:
            fs.delete(at(f"{root}/execution_date={day}/{leaf}"), True)
        for part in sorted(written):
            fs.mkdirs(at(f"{root}/{part}"))
            fs.delete(at(f"{root}/{part}/{leaf}"), True)
            if not fs.rename(at(f"{hidden}/{part}"), at(f"{root}/{part}/{leaf}")):
                raise OSError(f"{hidden}/{part} cannot be moved to {root}/{part}/{leaf}")
        fs.delete(at(hidden), True)

    def rewrite_days(self, name: str, df: DataFrame) -> None:
        """Replace the ``execution_date`` partitions that ``df`` has rows of;
        the files of other partitions stay. ``df`` must not read the table."""
        (conform(df, self.schema(name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("execution_date").parquet(self.path(name)))

    def replace(self, name: str, df: DataFrame) -> None:
        """Replace a config table. The new contents are written beside the old
        ones first; should the job end between the two moves, ``read`` finds
        them there."""
        root, new = self.path(name), self._new(name)
        conform(df, self.schema(name)).write.mode("overwrite").parquet(new)
        fs, at = self._fs(root)
        fs.delete(at(root), True)
        if not fs.rename(at(new), at(root)):
            raise OSError(f"{new} cannot be moved to {root}")

    def _new(self, name: str) -> str:
        return f"{self.base}/_new-{name}"

    def _fs(self, path: str):
        """The filesystem of a path, and the constructor of its paths."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path
        return at(path).getFileSystem(self.spark._jsc.hadoopConfiguration()), at
