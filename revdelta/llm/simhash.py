"""SimHash near-duplicate detection by multi-index hashing.

A text's fingerprint has a bit set where over half of its word shingles' XXH64 values
(seed 42) have it. Fingerprints at most `radius` bits apart are linked and documents in
one connected component form a group.

The index cuts a 64-bit fingerprint in two halves. Two fingerprints at most three bits
apart differ in at most one bit on one of the halves, so probing the Hamming ball of
radius 1 around each half finds every pair. Of two halves that differ in one bit exactly
one has that bit set; it alone enumerates the ball, by clearing its set bits, which
halves the probes.

Only distinct fingerprints are indexed, so exact copies cost nothing. Near copies that
share a half are linked first to the smallest fingerprint of their half (linear in the
group); candidate pairs are formed only between members that this does not connect yet.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from revdelta.llm.common import components, free, hidden, map_texts, possibly_in, stored

RADIUS = 3
SEED = 42
#: Shingles whose bits are counted at once: bounds memory for very long texts.
BLOCK = 1 << 16


def fingerprint(text: bytes, size: int) -> int:
    """The fingerprint of one text; words are runs of other than space and \\t to \\r."""
    words = text.lower().split()  # on bytes, both treat ASCII only
    if len(words) <= size:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(size)))))
    if not shingles:
        return 0
    total = np.zeros(64, np.int64)
    for at in range(0, len(shingles), BLOCK):
        part = shingles[at : at + BLOCK]
        hashes = np.fromiter(map(xxh64_intdigest, part, repeat(SEED)), "<u8", len(part))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * total > len(shingles)).tolist())


def fingerprints(docs: DataFrame, text: str = "text", size: int = 3) -> DataFrame:
    """docs plus `fp`, the fingerprint as a signed long. Null texts count as empty."""

    def make():
        def work(texts: list[bytes]) -> list[pa.Array]:
            found = np.fromiter((fingerprint(t, size) for t in texts), np.uint64, len(texts))
            return [pa.array(found.view(np.int64))]

        return work

    return map_texts(docs, text, [T.StructField("fp", T.LongType())], make)


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _probes(fps: DataFrame) -> DataFrame:
    """(fp, half, exact): the two halves, tagged in bit 32, and the ball around each."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    tag = {0: F.lit(0).cast("long"), 1: F.lit(1 << 32)}
    exact = [F.struct(h.bitwiseOR(tag[i]).alias("half"), F.lit(True).alias("exact")) for i, h in enumerate((low, high))]
    ball = [
        F.when(
            h.bitwiseAND(F.lit(1 << bit)) != 0,
            F.struct(h.bitwiseXOR(F.lit(1 << bit)).bitwiseOR(tag[i]).alias("half"), F.lit(False).alias("exact")),
        )
        for i, h in enumerate((low, high))
        for bit in range(32)
    ]
    return fps.select("fp", F.explode(F.array_compact(F.array(*exact, *ball))).alias("p")).select("fp", "p.*")


def _hits(fps: DataFrame) -> DataFrame:
    """(half, fp, exact, pivot): the probes that meet others, and their half's smallest fingerprint.

    Spark sizes probes like the fingerprints that they come from, some 30 times too low, and
    would broadcast them; so the join is a merge, whatever it expects.
    """
    probes = _probes(fps)
    buckets = probes.where("exact").groupBy("half").agg(F.min("fp").alias("pivot"), F.count("*").alias("n"))
    return probes.join(buckets.hint("merge"), "half").where("n > 1 or fp != pivot").select("half", "fp", "exact", "pivot")


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v) pairs of distinct fingerprints that connect all that the radius connects.

    The pairs span every component; pairs that others already connect are left out.
    """
    if not 0 <= radius <= 3:
        raise ValueError("two halves with balls of radius 1 reach at most 3 bits")
    # what probes find: nearly nothing but near copies, as a half has 2^32 values
    hits = stored(_hits(fps))
    stars = hits.where((F.col("fp") != F.col("pivot")) & (_apart("fp", "pivot") <= radius))
    stars = stars.select(F.col("pivot").alias("u"), F.col("fp").alias("v"))
    labels = stored(components(stars))
    known = labels.select(F.col("node").alias("fp"), F.col("component").alias("c"))

    def tagged(df: DataFrame) -> DataFrame:
        return df.join(known, "fp", "left").withColumn("c", F.coalesce("c", "fp"))

    # what is left to compare: members of one bucket in different components
    members = hits.where("exact").select("half", "fp").unionByName(hits.select("half", F.col("pivot").alias("fp")))
    members = tagged(members.distinct())
    spread = members.groupBy("half").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    seekers = tagged(hits.select("half", "fp").distinct()).join(spread, "half").where("lo < hi or lo != c")
    rest = (
        seekers.select("half", F.col("fp").alias("u"), F.col("c").alias("cu"))
        .join(members.select("half", F.col("fp").alias("v"), F.col("c").alias("cv")), "half")
        .where((F.col("cu") != F.col("cv")) & (_apart("u", "v") <= radius))
        .select("u", "v")
    )
    return labels.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(rest)


def _labelled(prints: DataFrame, least: Column, radius: int) -> tuple[DataFrame, DataFrame]:
    """(fp, root) of all prints, and (root, first): the smallest `least` of each component."""
    distinct = prints.groupBy("fp").agg(F.min(least).alias("least"))
    labels = components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    labelled = distinct.join(labels, "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    return labelled.select("fp", "root"), labelled.groupBy("root").agg(F.min("least").alias("first"))


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 3, radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint, component_id) for every document.

    fingerprint is 16 lowercase hex digits; component_id is the smallest id that links
    reach, the document's own included. Null texts count as empty; texts without words
    have fingerprint zero and are linked like others. A null id keeps its row and takes
    part in linking, but never names a component unless all ids of it are null. Repeated
    rows stay repeated. An empty table gives no rows.
    """
    own = free(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("words")), "fp")
    prints = stored(fingerprints(own, "words", size).select("id", "fp"))
    labelled, roots = _labelled(prints, F.col("id"), radius)
    by_print = labelled.join(roots, "root").select("fp", F.col("first").alias("component_id"))
    return prints.join(by_print, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def representatives(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 5, radius: int = RADIUS) -> DataFrame:
    """The documents that stay: of each group the row with the smallest id.

    Rows are told apart by id and text: of rows that repeat both one stays, rows that
    repeat an id with other text are documents of their own. Rows whose id is null cannot
    be named and stay. Only rows that go, or might by a bitmap of fixed size, are shuffled
    with their texts.
    """
    row = hidden(docs, "row")
    key = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text}`"))
    own = docs.select(F.col(f"`{id_col}`").alias("id"), key.alias("row"), F.col(f"`{text}`").alias("words"))
    prints = stored(fingerprints(own.where("id is not null"), "words", size).select("id", "row", "fp"))
    labelled, roots = _labelled(prints, F.struct("id", "row"), radius)
    counted = prints.groupBy("id", "row", "fp").count().join(labelled.join(roots, "root"), "fp")
    stays = F.col("first") == F.struct("id", "row")
    touched = stored(counted.where(~stays | (F.col("count") > 1)).select("id", "row", stays.alias("stays")))
    held, known, other = (hidden(docs, n) for n in ("held", "known_id", "known_row"))
    flag = hidden(docs, "stays")
    parted = possibly_in(docs.withColumn(row, key), F.col(row), touched, "row", held)
    named = touched.toDF(known, other, flag)
    same = (F.col(f"`{id_col}`") == F.col(known)) & (F.col(row) == F.col(other))
    joined = parted.where(held).join(named, same, "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = joined.where(flag).dropDuplicates([id_col, row]).select(*columns)
    return parted.where(~F.col(held)).select(*columns).unionByName(joined.where(F.col(flag).isNull()).select(*columns)).unionByName(once)
