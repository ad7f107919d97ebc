"""Incremental delivery: comparison rows arrive as files and are reported as they come.

A stream of page rows is compared page pair by page pair; totals are kept per document.
A replay of the same files gives what a batch over all of them gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from revdelta.functions import text as X
from revdelta.operators.alignment import jaccard

SCHEMA = "pair_id string, idx int, before string, after string"


def source(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Page pairs from Parquet files, in the order in which they appear."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def compared(pairs: DataFrame, *more: str) -> DataFrame:
    """(pair_id, idx, similarity, status) of page pairs and columns `more`, batch or stream alike."""
    words = pairs.withColumn("a", X.fingerprint(F.coalesce("before", F.lit("")))).withColumn("b", X.fingerprint(F.coalesce("after", F.lit(""))))
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed")
    one_sided = F.col("before").isNull() | F.col("after").isNull()
    return words.select(
        "pair_id", "idx", F.when(one_sided, 0.0).otherwise(jaccard("a", "b")).alias("similarity"),
        status.when(F.col("before") == F.col("after"), "same").otherwise("changed").alias("status"), *more,
    )


def progress(rows: DataFrame) -> DataFrame:
    """Running totals of each document: state is one row of counts for each."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return rows.groupBy("pair_id").agg(F.count("*").alias("pages"), count("same"), count("changed"), count("added"), count("removed"))


def deliver(pairs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append compared pairs to `out` exactly once: a batch that runs again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return compared(pairs).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
