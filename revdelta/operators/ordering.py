"""Dense row numbers over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revdelta.sources.scratch import stored

#: monotonically_increasing_id() keeps the row's place within its partition in these bits.
_PLACE_BITS = 33


def numbered(df: DataFrame, order: list[Column], name: str, part: str = "part", parts: int | None = None) -> DataFrame:
    """df plus `name`, each row's number from 0 in the given order, and `part`, its range.

    Rows are dealt by ranges of the order, written, and counted by range; the counts, one
    row a range, are summed up and broadcast. So a hot key spreads over as many ranges as
    its order columns allow, and nothing but a count of each range meets in one task.
    df is read twice (once to find the ranges), so it should be a table. Rows that tie in
    the order get different numbers in no stated order.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    ranged = stored(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(name, place))
    ranged = ranged.withColumn(part, F.shiftright(name, _PLACE_BITS).cast("int"))
    counts = ranged.groupBy(part).agg(F.count("*").alias("_rows"))
    before = counts.select(part, (F.sum("_rows").over(Window.orderBy(part)) - F.col("_rows")).alias("_before"))
    within = F.col(name).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    joined = ranged.join(F.broadcast(before), part)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + within).alias(name), part)
