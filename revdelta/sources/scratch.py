"""Tables that a job writes for itself: they cut its lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder serves a session in one local process; a cluster
    must name one, as a machine's own folder would lose rows there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext.getCheckpointDir() is None:
        master = spark.sparkContext.master
        if named is None and not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return named or spark.sparkContext.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that the library wrote, wherever Spark keeps it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Tables that stored() wrote within the innermost scratch(); null outside of any.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end of the block, the tables that stored() wrote in it.

    For callers that write an operator's result before the block ends.
    """
    token = _written.set([])
    try:
        yield
    finally:
        for path in _written.get():
            remove(spark, path)
        _written.reset(token)


def stored(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """df computed now, written as Parquet in the shared folder and read again.

    by: columns (no strings) whose values become folders, so that filters on them skip files.

    That cuts its lineage and outlives executors. The table stays there until the
    surrounding scratch() ends or the folder's owner clears it, as later reads need it.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    if _written.get() is not None:
        _written.get().append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
