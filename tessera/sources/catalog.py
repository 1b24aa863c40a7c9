"""Resolve table names to DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def path_exists(spark: SparkSession, path: str) -> bool:
    """Through the Hadoop filesystem layer: local paths and any URI."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath)


class TableResolver:
    """Name -> DataFrame. Looks in, in order: DataFrames registered by name,
    a folder of ``<name>.parquet`` datasets, the session catalog."""

    def __init__(self, spark: SparkSession, parquet_dir: str | None = None,
                 frames: dict[str, DataFrame] | None = None):
        self.spark = spark
        self.parquet_dir = parquet_dir
        self.frames = dict(frames or {})

    def register(self, name: str, df: DataFrame) -> "TableResolver":
        self.frames[name] = df
        return self

    def exists(self, name: str) -> bool:
        if name in self.frames:
            return True
        if self.parquet_dir and path_exists(self.spark, self._path(name)):
            return True
        return self.spark.catalog.tableExists(name)

    def _path(self, name: str) -> str:
        return f"{self.parquet_dir.rstrip('/')}/{name}.parquet"

    def drop(self, name: str) -> None:
        """Remove a table of the folder or of the session catalog; registered
        DataFrames are the caller's."""
        if name in self.frames:
            return
        if self.parquet_dir and path_exists(self.spark, self._path(name)):
            hpath = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
            hpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hpath, True)
        elif self.spark.catalog.tableExists(name):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def __call__(self, name: str) -> DataFrame:
        if name in self.frames:
            return self.frames[name]
        if self.parquet_dir and path_exists(self.spark, self._path(name)):
            return self.spark.read.parquet(self._path(name))
        return self.spark.table(name)
