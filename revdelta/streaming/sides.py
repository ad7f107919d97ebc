"""Pages of either revision arriving alone: each waits for the other side, for a while.

State is keyed by (document, place): the sides that have come and how often the pair was
told of. A pair is told when its second side comes. A side that waited too long is told
alone, as added or removed; if the other one comes after all, or a page comes again, the
pair is told once more with a higher revision. The last revision of every place, which
latest() takes, is what a batch over all pages gives, in whatever order they came.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from revdelta.streaming.delivery import compared

SCHEMA = "pair_id string, idx int, side string, text string"
TOLD = "pair_id string, idx int, before string, after string, revision int"
#: Keyed state with timers needs this store.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: How long a side waits for the other one, and how long a pair's state is kept, in milliseconds.
WAIT_MS, KEEP_MS = 60_000, 7 * 24 * 3_600_000


class _Meeting(StatefulProcessor):
    def __init__(self, wait_ms: int, keep_ms: int):
        self.wait_ms, self.keep_ms = wait_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "before string, after string, told int", self.keep_ms)

    def _told(self, key: tuple, before: str | None, after: str | None, told: int) -> pd.DataFrame:
        self.seen.update((before, after, told))
        return pd.DataFrame({"pair_id": [key[0]], "idx": pd.array([key[1]], "int32"), "before": [before], "after": [after], "revision": pd.array([told], "int32")})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before, after, told = self.seen.get() if self.seen.exists() else (None, None, 0)
        for batch in rows:
            for side, text in zip(batch["side"], batch["text"]):
                before, after = (text or "", after) if side == "earlier" else (before, text or "")
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if before is not None and after is not None:
            yield self._told(key, before, after, told + 1)
        else:
            self.seen.update((before, after, told))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            before, after, told = self.seen.get()
            yield self._told(key, before, after, told + 1)


def source(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Pages (pair_id, idx, side, text) from Parquet files, in the order in which they appear."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def met(pages: DataFrame, wait_ms: int = WAIT_MS, keep_ms: int = KEEP_MS) -> DataFrame:
    """(pair_id, idx, before, after, revision) of pairs and of sides that waited too long.

    Pages without a document or place are ignored.
    """
    own = pages.where("pair_id is not null and idx is not null")
    return own.groupBy("pair_id", "idx").transformWithStateInPandas(_Meeting(wait_ms, keep_ms), TOLD, "Append", "ProcessingTime")


def deliver(
    pages: DataFrame, out: str, checkpoint: str, wait_ms: int = WAIT_MS, keep_ms: int = KEEP_MS, every: str = "1 second"
) -> StreamingQuery:
    """Append compared pairs, with their revision, to the Parquet table `out`, exactly once.

    The query runs until it is stopped: waiting sides fall due while nothing comes.
    """
    told = compared(met(pages, wait_ms, keep_ms), "revision")
    return told.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(processingTime=every).start(out)


def latest(rows: DataFrame) -> DataFrame:
    """The last revision of every place."""
    rest = [c for c in rows.columns if c not in ("pair_id", "idx", "revision")]
    last = rows.groupBy("pair_id", "idx").agg(F.max_by(F.struct(*rest), "revision").alias("last"))
    return last.select("pair_id", "idx", "last.*")


def batch(pages: DataFrame) -> DataFrame:
    """What latest() comes to once all pages are there and nothing waits."""
    one = lambda s: F.max(F.when(F.col("side") == s, F.coalesce("text", F.lit(""))))
    own = pages.where("pair_id is not null and idx is not null")
    return compared(own.groupBy("pair_id", "idx").agg(one("earlier").alias("before"), one("newer").alias("after")))
