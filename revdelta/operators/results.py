"""Results kept by content: a pair of pages is compared once, whatever documents hold it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revdelta.sources.scratch import stored

KEY = "content_key"


def content_key(settings: dict | None = None, before: str = "before", after: str = "after"):
    """A digest of both texts, null told from empty, and of the settings that results depend on."""
    told = json.dumps(settings or {}, sort_keys=True)
    part = lambda c: F.coalesce(F.sha2(F.col(c), 256), F.lit("-"))
    return F.sha2(F.concat_ws("|", part(before), part(after), F.lit(told)), 256)


class ResultCache:
    """Results under `path`, a folder for each run that computed some.

    A run's folder is read once Spark has committed it. Runs at one time may compute a pair
    twice; equal keys have equal results, of which one is taken.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, f"{KEY} string, {schema}"

    def _known(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        runs = [s.getPath() for s in files.listStatus(at)] if files.exists(at) else []
        done = [p.toString() for p in runs if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        if not done:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*done)

    def results(
        self, pairs: DataFrame, compute: Callable[[DataFrame], DataFrame], settings: dict | None = None,
        before: str = "before", after: str = "after",
    ) -> tuple[DataFrame, int]:
        """pairs with their results, and how many had to be computed.

        compute gets (content_key, before, after) of pairs that are not known, each content
        once, and returns content_key and the columns of the schema. Only keys are joined
        to find them; results are joined back by key, so a pair that many documents hold
        is one row of the cache.
        """
        keyed = pairs.withColumn(KEY, content_key(settings, before, after))
        known = self._known()
        wanted = keyed.select(KEY, F.col(before).alias("before"), F.col(after).alias("after"))
        misses = stored(wanted.join(known.select(KEY), KEY, "left_anti").dropDuplicates([KEY]))
        n = misses.count()
        if n:
            fresh = f"{self.path}/run-{uuid.uuid4().hex}"
            compute(misses).select(*known.columns).write.parquet(fresh)
            known = known.unionByName(self.spark.read.schema(self.schema).parquet(fresh))
        return keyed.join(known.dropDuplicates([KEY]), KEY, "left").drop(KEY), n
