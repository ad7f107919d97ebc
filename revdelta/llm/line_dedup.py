"""Lines that repeat across documents, as one compressed keep bitmap for each document.

A line's key is the line without white space at its ends, A-Z lower-cased. Keys of enough
code points that stand in enough documents lose their lines everywhere but in the
document with the largest id.

The keys' hashes are dealt by ranges of (hash, document), largest document first, and
sorted by position within; each range is then read as a stream that holds the lines of
a few documents at most. A hot line spreads over many ranges. What a stream cannot
tell, as a hash goes on in the next range, it hands on undecided; the hashes at the ends
of ranges, two a range, decide those. No text is shuffled but that of documents that lose
lines, when bitmaps are applied.

Null texts are empty, and an empty text is one empty line. A document is all rows of one
id: it counts once and its rows lose and keep the same keys. A null id is one document,
smaller than all others. An empty table gives no rows. Columns of the input named like
results are replaced, others pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revdelta.llm.common import free, give_back, hidden, possibly_in, slices, stored

SPACES = b" \t\n\x0b\x0c\r"
#: Production parameters: code points of a key, documents that hold it.
MIN_CHARS, MIN_DOCS = 40, 5
#: The id that stands for a null one.
NO_ID = -(1 << 63)

LINES = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("place", pa.int32())])
LINES_SQL = "high long, low long, doc long, row long, place int"
#: What a stream tells of a line or of a hash at an end of its range.
DROPPED, UNDECIDED, EDGE = 0, 1, 2


def _id(id_col: str) -> Column:
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID).cast("long"))


def _row(text: str) -> Column:
    """Rows that repeat an id are told apart by their text; equal rows share a bitmap."""
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def _long_enough(key: bytes, least: int) -> bool:
    n = len(key)
    return n >= least and (n >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(high, low, doc, row, place): the 128-bit hash of every long enough line's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                hashes, docs_, rows, places = [], [], [], []
                for doc, row, whole in zip(*(c.to_pylist() for c in part.columns)):
                    for place, line in enumerate(whole.split(b"\n")):
                        key = line.strip(SPACES).lower()  # on bytes: A-Z only
                        if _long_enough(key, min_chars):
                            hashes.append(xxhash.xxh3_128_digest(key))
                            docs_.append(doc)
                            rows.append(row)
                            places.append(place)
                both = np.frombuffer(b"".join(hashes), ">i8").reshape(-1, 2).astype(np.int64)
                columns = [both[:, 0], both[:, 1], np.array(docs_, np.int64), np.array(rows, np.int64), np.array(places, np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], schema=LINES)
        give_back()

    raw = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))
    return docs.select(_id(id_col).alias("doc"), _row(text).alias("row"), raw.alias("text")).mapInArrow(run, LINES_SQL)


class _Stream:
    """Lines of one range, by hash, then by document from the largest on."""

    def __init__(self, min_docs: int):
        self.min_docs, self.hash, self.n_groups = min_docs, None, 0

    def _open(self, at: tuple[int, int], doc: int) -> None:
        self.hash, self.top, self.last, self.docs, self.held = at, doc, doc, 1, []
        self.n_groups += 1

    def _told(self, kind: int, lines: np.ndarray) -> np.ndarray:
        out = np.empty((len(lines), 7), np.int64)
        out[:, 0], out[:, 1:6], out[:, 6] = kind, lines, 0
        return out

    def close(self, at_end: bool) -> list[np.ndarray]:
        """What is still to be told of the open hash. That of the range's start may have
        begun, and that of its end may go on, in another range."""
        if self.hash is None:
            return []
        out, edge = [], at_end or self.n_groups == 1
        if edge:
            out.append(np.array([[EDGE, *self.hash, self.top, 0, 0, self.docs]], np.int64))
        if edge and self.held:
            out.append(self._told(UNDECIDED, np.concatenate(self.held)))
        self.hash = None
        return out

    def _piece(self, group: np.ndarray) -> list[np.ndarray]:
        """Lines of one hash, which may have begun before and may go on."""
        out, at, docs = [], (int(group[0, 0]), int(group[0, 1])), group[:, 2]
        if at != self.hash:
            out += self.close(False)
            self._open(at, int(docs[0]))
        self.docs += int(docs[0] != self.last) + int((docs[1:] != docs[:-1]).sum())
        self.last = int(docs[-1])
        if self.n_groups == 1:  # its largest document may stand in an earlier range
            return [*out, self._told(UNDECIDED, group)]
        others = group[docs != self.top]
        if self.docs >= self.min_docs:
            out += [self._told(DROPPED, x) for x in (*self.held, others)]
            self.held = []
        elif len(others):
            self.held.append(others)
        return out

    def feed(self, lines: np.ndarray) -> list[np.ndarray]:
        """lines: columns high, low, doc, row, place in the stream's order."""
        new_hash = (lines[1:, :2] != lines[:-1, :2]).any(axis=1)
        starts = np.concatenate([[0], np.flatnonzero(new_hash) + 1])
        if len(starts) == 1:
            return self._piece(lines)
        out = self._piece(lines[: starts[1]])
        if len(starts) > 2:  # hashes that begin and end within these lines, all at once
            out += self.close(False)
            whole, first = lines[starts[1] : starts[-1]], starts[1:-1] - starts[1]
            new_doc = np.concatenate([[True], (new_hash | (lines[1:, 2] != lines[:-1, 2]))[starts[1] : starts[-1] - 1]])
            sizes = np.diff([*first, len(whole)])
            many = np.repeat(np.add.reduceat(new_doc.astype(np.int64), first) >= self.min_docs, sizes)
            out.append(self._told(DROPPED, whole[many & (whole[:, 2] != np.repeat(whole[first, 2], sizes))]))
            self.n_groups += len(first)
        return out + self._piece(lines[starts[-1] :])


TOLD = "kind int, high long, low long, doc long, row long, place int, n_docs long"


def _streamed(hashes: DataFrame, min_docs: int) -> DataFrame:
    names = [f.split()[0] for f in TOLD.split(", ")]
    types = [pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(min_docs)

        def batch_of(told: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if told:
                rows = np.concatenate(told)
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, i]).cast(t) for i, t in enumerate(types)], names=names)

        for batch in batches:
            if batch.num_rows:
                yield from batch_of(stream.feed(np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])))
        yield from batch_of(stream.close(True))
        give_back()

    parts = int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col("high"), F.col("low"), F.col("doc").desc()]
    return hashes.repartitionByRange(parts, *by).sortWithinPartitions(*by, "place").mapInArrow(run, TOLD)


@F.pandas_udf(T.BinaryType())
def _bitmap(places: pd.Series) -> pd.Series:
    def one(dropped) -> bytes:
        keep = np.ones(int(dropped.max()) // 8 * 8 + 8, bool)
        keep[dropped] = False
        return zlib.compress(np.packbits(keep).tobytes())

    return pd.Series([one(np.asarray(x)) for x in places])


def keep_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """(doc, row, n_dropped, bitmap) of the rows that lose lines.

    doc is the id, or NO_ID for a null one, row a hash of the text. The bitmap is a deflated
    string of bits from the first line on, most significant bit first: 1 keeps a line;
    lines past its end are kept.
    """
    told = stored(_streamed(stored(line_hashes(docs, id_col, text, min_chars)), min_docs))
    # at most two rows for each range of the shuffle
    edges = told.where(F.col("kind") == EDGE).groupBy("high", "low").agg(F.sum("n_docs").alias("docs"), F.max("doc").alias("top"))
    edges = edges.where(F.col("docs") >= min_docs)
    late = told.where(F.col("kind") == UNDECIDED).join(F.broadcast(edges), ["high", "low"]).where(F.col("doc") < F.col("top"))
    places = told.where(F.col("kind") == DROPPED).select("doc", "row", "place").unionByName(late.select("doc", "row", "place"))
    lost = places.groupBy("doc", "row").agg(F.collect_set("place").alias("places"))
    return lost.select("doc", "row", F.size("places").cast("long").alias("n_dropped"), _bitmap("places").alias("bitmap"))


def kept_text(text: Column, bitmap: Column) -> Column:
    """text without the lines whose bit is 0."""

    @F.pandas_udf("string")
    def without(texts: pd.Series, bitmaps: pd.Series) -> pd.Series:
        def one(t: str, packed: bytes) -> str:
            lines = t.split("\n")
            keep = np.ones(len(lines), bool)
            bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8))[: len(lines)]
            keep[: len(bits)] = bits
            return "\n".join([x for x, k in zip(lines, keep) if k])

        return pd.Series([one(t, b) for t, b in zip(texts, bitmaps)], dtype=object)

    return without(text, bitmap)


def dedup(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """docs plus n_lines (before), n_dropped (longs) and kept_text, what stays of the text.

    Documents that lose nothing are not shuffled: a bitmap of fixed size tells most of them
    from the others.
    """
    docs = free(docs, "n_lines", "n_dropped", "kept_text")
    id_key, row, held = (hidden(docs, name) for name in ("doc", "row", "held"))
    lost = stored(keep_bitmaps(docs, id_col, text, min_chars, min_docs))
    lost = lost.toDF(id_key, row, "n_dropped", bitmap := hidden(docs, "bitmap"))
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    n_lines = (F.length(whole) - F.length(F.replace(whole, F.lit("\n"))) + 1).cast("long")
    parted = possibly_in(docs.withColumn(row, _row(text)), F.col(row), lost, row, held)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    joined = parted.where(held).withColumn(id_key, _id(id_col)).join(lost, [id_key, row], "left")
    one = lambda df, n, t: df.select(*columns, n_lines.alias("n_lines"), n.alias("n_dropped"), t.alias("kept_text"))
    none = F.lit(0).cast("long")
    return (
        one(parted.where(~F.col(held)), none, whole)
        .unionByName(one(joined.where(F.col(bitmap).isNull()), none, whole))
        .unionByName(one(joined.where(F.col(bitmap).isNotNull()), F.col("n_dropped"), kept_text(whole, F.col(bitmap))))
    )
