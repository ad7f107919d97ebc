"""Tables kept in versions: readers see whole versions only, writers replace the last one.

A version is a folder; it counts once its job has committed, which Spark marks by a file of
its own. So a write that fails half-way leaves the last version as it was, and readers
that began before go on reading theirs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class VersionedTable:
    """A keyed table under `path`: one writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], keep: int = 2):
        self.spark, self.path, self.schema, self.keys, self.keep = spark, path, schema, keys, keep

    def versions(self) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(at):
            return []
        names = [s.getPath() for s in files.listStatus(at)]
        done = [p for p in names if re.fullmatch(r"version-\d+", p.getName()) and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().rpartition("-")[2]) for p in done)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, the last one by default; empty before any write."""
        known = self.versions()
        if version is None and not known:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/version-{known[-1] if version is None else version}")

    def _publish(self, rows: DataFrame) -> None:
        known = self.versions()
        number = known[-1] + 1 if known else 0
        rows.write.mode("overwrite").parquet(f"{self.path}/version-{number}")  # over what a failed write left
        for old in known[: len(known) + 1 - self.keep]:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/version-{old}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def get(self, **key) -> DataFrame:
        """The row of one key; its filter reaches the files."""
        found = self.read()
        for name, value in key.items():
            found = found.where(F.col(name) == F.lit(value))
        return found

    def upsert(self, rows: DataFrame) -> None:
        """Rows of known keys replace them, others are added; of rows of one key any one counts."""
        fresh = rows.dropDuplicates(self.keys)
        self._publish(self.read().join(fresh.select(*self.keys), self.keys, "left_anti").unionByName(fresh))

    def delete(self, condition: Column | None = None) -> None:
        """Rows for which the condition holds go; all of them without one."""
        rows = self.read()
        self._publish(rows.where(~F.coalesce(condition, F.lit(False))) if condition is not None else rows.limit(0))

    def apply(self, log: DataFrame, order: str, deleted: Column) -> None:
        """A log of upserts and deletes at once: the last entry of every key decides."""
        last = F.row_number().over(Window.partitionBy(*self.keys).orderBy(F.col(order).desc()))
        final = log.withColumn("_gone", F.coalesce(deleted, F.lit(False))).withColumn("_last", last).where("_last = 1").drop("_last")
        kept = self.read().join(final.select(*self.keys), self.keys, "left_anti")
        self._publish(kept.unionByName(final.where("not _gone").select(*kept.columns)))
