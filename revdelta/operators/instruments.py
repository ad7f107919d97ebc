"""Metrics of a job's stages as rows: what each counted, how long it took, how it ended."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from revdelta.operators.selection import nearest_ranks
from revdelta.sources.scratch import stored

SCHEMA = "name string, duration_ms double, status string, rows long, attributes string"


class Sink:
    """Gathers a row for each measured stage; a stage that fails is recorded and raises."""

    def __init__(self):
        self.rows: list[tuple] = []

    def measure(self, name: str, stage: Callable[[], DataFrame], counts: dict[str, Column] | None = None, **attributes) -> DataFrame:
        """Compute stage() once, written to the shared folder, and hand it on.

        counts: aggregates over its rows. Spark observes them while the rows are written,
        so measuring reads nothing again. attributes: what else is told of the stage.
        """
        began = time.perf_counter()
        seen, status = {}, "error"
        try:
            watched = Observation(name)
            result = stored(stage().observe(watched, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in (counts or {}).items()]))
            seen, status = watched.get, "ok"
            return result
        finally:
            told = attributes | {k: v for k, v in seen.items() if k != "rows"}
            self.rows.append((name, (time.perf_counter() - began) * 1000, status, seen.get("rows"), json.dumps(told, sort_keys=True, default=str)))

    def table(self, spark: SparkSession) -> DataFrame:
        """(name, duration_ms, status, rows, attributes), a row for each stage that ran."""
        return spark.createDataFrame(self.rows, SCHEMA)


def summary(metrics: DataFrame, name: str = "name", value: str = "duration_ms") -> DataFrame:
    """(name, n, max_ms, p50_ms, p95_ms): nearest-rank percentiles of each metric's values."""
    ranks = nearest_ranks(metrics, [name], value, [0.5, 0.95])
    at = lambda share: F.max(F.when(F.col("share") == share, F.col("value")))
    picked = ranks.groupBy(name).agg(at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms"))
    sizes = metrics.where(F.col(value).isNotNull()).groupBy(name).agg(F.count("*").alias("n"), F.max(value).alias("max_ms"))
    return sizes.join(picked, sizes[name].eqNullSafe(picked[name])).select(sizes[name].alias("name"), "n", "max_ms", "p50_ms", "p95_ms")
