"""Versioned snapshots of a table in a folder: readers see the last complete version, a writer adds the next one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Snapshots:
    """Version N is the folder v=N; it counts once Spark's commit has left _SUCCESS in it, so that a crash leaves the version before."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def versions(self) -> list[int]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v=*/_SUCCESS"))
        return sorted(int(f.getPath().getParent().getName()[2:]) for f in found or [])

    def read(self, version: int | None = None) -> DataFrame:
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={known[-1] if version is None else version}")

    def update(self, change: Callable[[DataFrame], DataFrame], keep: int = 2) -> int:
        """Writes change(last version) as the next version; older ones than `keep` go."""
        known = self.versions()
        number = known[-1] + 1 if known else 0
        change(self.read()).write.mode("overwrite").parquet(f"{self.path}/v={number}")
        for old in known[: max(0, len(known) + 1 - keep)]:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={old}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        return number
