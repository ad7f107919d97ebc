"""Exact nearest-rank percentiles without sorting a metric in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revdelta.sources.scratch import stored

#: Buckets into which a pass cuts a range, and rows that a range may hold to be sorted whole.
BUCKETS, WHOLE = 1024, 1000


def nearest_ranks(values: DataFrame, keys: list[str], value: str, shares: list[float], whole: int = WHOLE) -> DataFrame:
    """(keys, share, n, value): the value at rank ceil(n * share), counted from 1.

    Every pass counts the rows of BUCKETS equal parts of the range that still holds the
    wanted rank and goes on with the part in which it lies, from its smallest to its
    largest value, so ranges shrink strictly; equal values end in one. Counts are summed
    before they are shuffled: a pass sends BUCKETS rows a task and key, and a key that
    holds most rows is no heavier than others. Values are finite; nulls take no part.
    """
    base = stored(values.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")))
    sizes = base.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    share = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    now = sizes.select(*keys, "n", "low", "high", share, F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    now = stored(now.withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("share")))))
    at = [*keys, "share"]
    upto = Window.partitionBy(*at).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys], F.lit(True))

    def within(ranges: DataFrame) -> DataFrame:
        own = [F.col(f"r.{c}").alias(c) for c in ranges.columns]
        return base.alias("b").join(ranges.alias("r"), same("b", "r") & F.col("_v").between(F.col("low"), F.col("high"))).select(*own, "_v")

    while True:
        wide = now.where((F.col("low") < F.col("high")) & (F.col("inside") > whole))
        if wide.isEmpty():
            break
        # halves: the whole range of doubles has no finite width; the smallest range has none left
        part = F.try_divide(F.col("_v") / 2 - F.col("low") / 2, F.col("high") / 2 - F.col("low") / 2)
        last = (F.col("_v") == F.col("high")) | (part >= 1)
        bucket = F.when(last, BUCKETS - 1).otherwise(F.floor(F.coalesce(part, F.lit(0.0)) * BUCKETS)).alias("bucket")
        counts = within(wide).groupBy(*at, "n", "rank", "below", bucket).agg(
            F.count("*").alias("inside"), F.min("_v").alias("low"), F.max("_v").alias("high")
        )
        told = counts.withColumn("upto", F.col("below") + F.sum("inside").over(upto))
        held = told.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("inside") < F.col("rank")))
        held = held.withColumn("below", F.col("upto") - F.col("inside")).select(*now.columns)
        now = stored(now.where((F.col("low") == F.col("high")) | (F.col("inside") <= whole)).unionByName(held))
    few = within(now.where("low < high")).groupBy(*at, "n", "rank", "below", F.col("_v").alias("bucket")).agg(F.count("*").alias("inside"))
    told = few.withColumn("upto", F.col("below") + F.sum("inside").over(upto))
    found = told.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("inside") < F.col("rank")))
    return now.where("low = high").select(*at, "n", F.col("low").alias("value")).unionByName(found.select(*at, "n", F.col("bucket").alias("value")))
