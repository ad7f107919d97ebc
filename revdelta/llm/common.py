"""What several corpus operators share: stored tables, Arrow text batches, components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revdelta.operators.components import components
from revdelta.sources.scratch import scratch, shared_folder, stored

__all__ = ["components", "scratch", "shared_folder", "stored"]


#: Bits of a membership bitmap: 8 MB, whatever the data.
MEMBER_BITS = 1 << 26


def possibly_in(df: DataFrame, value: Column, keys: DataFrame, key: str, name: str) -> DataFrame:
    """df plus a boolean column `name`: false only if `value` is not among keys' `key`.

    The keys' hashes are set in a bitmap of fixed size, which is broadcast (at most 2048
    rows of 4 KB). It keeps rows out of a later join; where there are so many keys that
    most bits are set, it merely stops helping. Null values are never among the keys.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(MEMBER_BITS))
    chunk, bits = hidden(df, "chunk"), hidden(df, "bits")
    hashed = keys.select(bit(F.col(key)).alias("bit"))
    bitmap = hashed.groupBy(F.shiftright("bit", 15).cast("int").alias(chunk)).agg(
        F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(32767))).alias(bits)
    )
    at = bit(value).bitwiseAND(F.lit(32767))
    byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.pmod(F.floor(byte / F.pow(F.lit(2), at % 8)), F.lit(2)) == 1
    own = df.withColumn(chunk, F.shiftright(bit(value), 15).cast("int"))
    joined = own.join(F.broadcast(bitmap), chunk, "left")
    flag = F.coalesce(held, F.lit(False)) & value.isNotNull()
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], flag.alias(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hidden(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have yet, for helper columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def free(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that would clash with the result columns `names`."""
    wanted = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in wanted])


#: Bytes of text that become Python objects at once in a worker.
SLICE = 512 << 10


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most SLICE bytes of a binary column, or of one row."""
    if not batch.num_rows:
        yield batch
        return
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + SLICE, "right")))
        yield batch.slice(start, end - start)
        start = end


def give_back() -> None:
    """Return memory that a task used to the system: Spark keeps Python workers for later
    tasks, next to which an executor's JVM needs it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def map_texts(
    df: DataFrame,
    text: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[list[bytes]], list[pa.Array]]],
) -> DataFrame:
    """Append columns computed from the UTF-8 bytes of a text column, batch by batch.

    make() runs once in each task and returns a function from the batch's texts (null
    texts are empty) to one Arrow array for each new field. Other columns pass through.
    """
    df = free(df, *[f.name for f in fields])
    raw = hidden(df, "raw_text")
    schema = T.StructType([*df.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                kept, texts = part.columns[:-1], part.column(part.num_columns - 1)
                made = work(texts.to_pylist())
                yield pa.RecordBatch.from_arrays([*kept, *made], names=schema.names)
        give_back()

    bytes_of = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))
    return df.select(*[F.col(f"`{c}`") for c in df.columns], bytes_of.alias(raw)).mapInArrow(run, schema)
