"""Phrases of two and three words that stand together more often than their words would.

Texts are lower-cased (A-Z), split into pieces at punctuation and line ends, and into words
at spaces and tabs. All counts are exact, by language (null: `und`), over all occurrences.

Slices of text, a few megabytes each, are tokenized once and kept as numbers that count
within the slice. Words are counted over slices; those frequent enough get dense numbers in
the order of (language, word), and each slice learns the numbers of its own words. Other
words break pieces, as no frequent phrase holds them. Pairs of numbers are packed into
64 bits, triples into 96, counted within a slice by sorting, dealt by ranges, sorted, and
their runs added up.

A range is found without sampling: a key's place in the order is estimated from the words'
shares of all occurrences, so a first word that stands everywhere spreads over many ranges
by its second word. A word's rows, a slice each, are spread the same way: by slice before
they are added up. Triples are made only where both pairs may be frequent, by a bitmap of
fixed size; where it is too full it lets more through, and counting drops them.

Null and empty texts have no words. Equal rows count each for itself. An empty table gives
no rows. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revdelta.llm.common import give_back, slices, stored
from revdelta.operators.ordering import numbered

#: Production parameters: occurrences of a candidate; percent of a phrase's occurrences in a
#: longer one that make it a part of that; phrases of a language.
LEAST, WITHIN, TOP = 10, 50, 2000
#: What separates pieces; spaces and tabs separate words.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
#: Bytes of frequent words up to which they are broadcast.
WORDS_BYTES = 16 << 20
#: Bytes of text in a slice; of all open slices of a task.
SLICE_BYTES, OPEN_BYTES = 8 << 20, 32 << 20
#: Bits of the map of frequent pairs: 8 MB, whatever the data.
PAIR_BITS = 1 << 26
#: Buckets over which a language's phrases are ranked before they meet.
BUCKETS = 256
_END = b"\xff"  # no byte of UTF-8
_TO_ENDS = bytes.maketrans(PIECE_ENDS + b"\t", _END * len(PIECE_ENDS) + b" ")
TOKENS = "slice long, lang string, words array<binary>, counts array<int>, codes binary"


class _Slice:
    """Text of one language as tokens, each by the place where it first stood."""

    def __init__(self):
        self.first: dict[bytes, int] = {_END: 0}
        self.codes: list[np.ndarray] = []
        self.bytes, self.n = 0, 1

    def add(self, text: bytes) -> None:
        tokens = text.lower().translate(_TO_ENDS).replace(_END, b" \xff ").split()
        tokens.append(_END)  # a text's end is a piece's
        self.codes.append(np.fromiter(map(self.first.setdefault, tokens, count(self.n)), np.int64, len(tokens)))
        self.n += len(tokens)
        self.bytes += len(text)

    def row(self) -> tuple[list[bytes], np.ndarray, bytes]:
        """Words, their counts, and the tokens as numbers of words."""
        codes = np.concatenate(self.codes)
        ends = codes == 0
        codes = codes[~(ends & np.concatenate([[False], ends[:-1]]))]
        codes = np.searchsorted(np.fromiter(self.first.values(), np.int64, len(self.first)), codes).astype(np.int32)
        counts = np.bincount(codes, minlength=len(self.first)).astype(np.int32)
        packed = len(codes).to_bytes(8, "little") + pa.compress(pa.py_buffer(codes.tobytes()), "zstd").to_pybytes()
        return list(self.first), counts, packed


def tokens(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """Slices: the distinct words of each, their counts, and its text as numbers of words
    (deflated 32-bit; 0 ends a piece, and is no word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, _Slice] = {}
        numbers, held = count(TaskContext.get().partitionId() << 32), 0

        def closed(name: str) -> pa.RecordBatch:
            words, counts, codes = open_.pop(name).row()
            columns = [
                pa.array([next(numbers)], pa.int64()), pa.array([name]), pa.array([words], pa.list_(pa.binary())),
                pa.array([counts], pa.list_(pa.int32())), pa.array([codes], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["slice", "lang", "words", "counts", "codes"])

        for batch in batches:
            for part in slices(batch, 1):
                for name, whole in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    open_.setdefault(name, _Slice()).add(whole)
                    held += len(whole)
                    while held >= OPEN_BYTES or (name in open_ and open_[name].bytes >= SLICE_BYTES):
                        largest = max(open_, key=lambda k: open_[k].bytes)
                        held -= open_[largest].bytes
                        yield closed(largest)
        for name in list(open_):
            yield closed(name)
        give_back()

    named = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("binary").alias("text"))
    return named.where(F.octet_length("text") > 0).mapInArrow(run, TOKENS)


def _codes(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    return np.frombuffer(pa.decompress(packed[8:], 4 * n, "zstd", asbytes=True), np.int32)


def _dictionary(words: DataFrame, ranges: int) -> DataFrame:
    """(lang, word, f, number, below, share) of words with counts f: dense numbers in order,
    and the share of all occurrences that lies below a word and in it."""
    placed = stored(numbered(words, [F.col("lang"), F.col("word")], "number", parts=ranges))
    totals = placed.groupBy("part").agg(F.sum("f").alias("_sum"))
    before = totals.select("part", (F.sum("_sum").over(Window.orderBy("part")) - F.col("_sum")).alias("_before"), F.sum("_sum").over(Window.partitionBy()).alias("_all"))
    running = F.sum("f").over(Window.partitionBy("part").orderBy("number")) - F.col("f")
    return placed.withColumn("_running", running).join(F.broadcast(before), "part").select(
        "lang", "word", "f", "number", ((F.col("_before") + F.col("_running")) / F.col("_all")).alias("below"), (F.col("f") / F.col("_all")).alias("share")
    )


def _counted(keys: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Sorted distinct keys, their counts, and where each stood; keys: most significant first."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    starts = _starts(keys)
    return [k[starts] for k in keys], np.diff(np.append(starts, len(order))), order[starts]


def _starts(keys: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal keys begin."""
    n = len(keys[0])
    change = np.ones(n, bool)
    if n:
        change[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(change)


def _bit(heads: np.ndarray) -> np.ndarray:
    """A pair's bit in the map of frequent ones."""
    return ((heads.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(38)).astype(np.int64)


KEYS = {2: "range int, head long, n long", 3: "range int, head long, tail long, n long"}


def _grams(sliced: DataFrame, size: int, ranges: int, pairs: Broadcast | None = None) -> DataFrame:
    """Packed phrases of `size` words, counted within each slice, with the range of each.

    head packs the numbers of the first two words, tail is the third's. pairs: the map of
    frequent pairs, without which no triple is left out.
    """
    names = [f.split()[0] for f in KEYS[size].split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes, n_words, *known = (c[i] for c in batch.columns)
                place, number, below, share = (k.values.to_numpy(zero_copy_only=False) for k in known)
                ids, low, wide = np.full(n_words.as_py(), -1, np.int64), np.zeros(n_words.as_py()), np.zeros(n_words.as_py())
                ids[place], low[place], wide[place] = number, below, share
                at = _codes(codes.as_py())
                words = ids[at]
                heads = words[:-1] << 32 | words[1:]
                fit = (words[:-1] >= 0) & (words[1:] >= 0)
                if size == 3:
                    if pairs is not None:
                        bit = _bit(heads)
                        fit &= np.frombuffer(pairs.value, np.uint8)[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1
                    fit = fit[:-1] & fit[1:]
                stand = np.flatnonzero(fit)
                keys, n, first = _counted([heads[stand], *([words[stand + 2]] if size == 3 else [])])
                own = at[stand[first]]
                spot, inner = low[own], wide[own]
                for k in range(1, size):
                    own = at[stand[first] + k]
                    spot, inner = spot + inner * low[own], inner * wide[own]
                where = np.minimum((spot * ranges).astype(np.int32), ranges - 1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (where, *keys, n)], names=names)
        give_back()

    return sliced.mapInArrow(run, KEYS[size])


def _summed(grams: DataFrame, size: int, ranges: int, least: int) -> DataFrame:
    """Keys with their whole counts, if frequent: each range is sorted and its runs added up."""
    keys = ["head", "tail"][: size - 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: list[np.ndarray] | None = None

        def batch_of(columns: list[np.ndarray]) -> pa.RecordBatch:
            often = columns[-1] >= least
            return pa.RecordBatch.from_arrays([pa.array(c[often]) for c in columns], names=[*keys, "a"])

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if carried is not None:
                columns = [np.concatenate([a, b]) for a, b in zip(carried, columns)]
            if not len(columns[0]):
                continue
            starts = _starts(columns[:-1])
            whole = [*(c[starts] for c in columns[:-1]), np.add.reduceat(columns[-1], starts)]
            carried = [c[-1:] for c in whole]  # its run may go on
            yield batch_of([c[:-1] for c in whole])
        if carried is not None:
            yield batch_of(carried)
        give_back()

    dealt = grams.repartitionById(ranges, F.col("range")).sortWithinPartitions(*keys).select(*keys, "n")
    return dealt.mapInArrow(run, ", ".join(f"{k} long" for k in (*keys, "a")))


def _pair_map(pairs: DataFrame) -> Broadcast:
    """The bits of all frequent pairs: at most PAIR_BITS, gathered from 4 KB pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_bit(batch.column(0).to_numpy(zero_copy_only=False)))], names=["bit"])

    bits = pairs.select("head").mapInArrow(run, "bit long")
    rows = bits.groupBy(F.shiftright("bit", 15).cast("int").alias("chunk")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(32767))).alias("bits"))
    whole = bytearray(PAIR_BITS // 8)
    for r in rows.collect():
        whole[r.chunk * 4096 : (r.chunk + 1) * 4096] = r.bits
    return pairs.sparkSession.sparkContext.broadcast(bytes(whole))


def score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)) in whole numbers of up to 38 digits."""
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    return F.expr(f"(1000000BD * ({wide(a)} * {wide(a)})) div ({wide(left)} * {wide(right)})")


def mine(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, within: int = WITHIN, top: int = TOP
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases.

    a, l, r: occurrences of the phrase and of its parts at the lowest-scoring cut (the first
    of equal ones); n: words of the language. Phrases mostly within a longer candidate are
    left out. Ranked by score, then a, both descending, then phrase.
    """
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sliced = stored(tokens(docs, lang, text))
    zipped = F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w")
    held = sliced.select("slice", "lang", zipped).where("place > 0").select("slice", "lang", "place", F.col("w.words").cast("string").alias("word"), F.col("w.counts").alias("n"))
    often = held.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    words = stored(_dictionary(stored(often), ranges))
    size = words.agg(F.sum(F.octet_length("lang") + F.octet_length("word") + 32)).first()[0] or 0
    known = F.broadcast if size <= WORDS_BYTES else lambda df: df
    own = held.join(known(words.drop("f")), ["lang", "word"])
    own = own.groupBy("slice").agg(F.collect_list(F.struct("place", "number", "below", "share")).alias("known"))
    sliced_words = stored(sliced.select("slice", "codes", F.size("words").alias("n_words")).join(own, "slice").select(
        "codes", "n_words", *[F.col(f"known.{c}").alias(c) for c in ("place", "number", "below", "share")]
    ))
    pairs = stored(_summed(_grams(sliced_words, 2, ranges), 2, ranges, least))
    triples = stored(_summed(_grams(sliced_words, 3, ranges, _pair_map(pairs)), 3, ranges, least))
    return _ranked(sliced, words, known, pairs, triples, within, top)


def _ranked(sliced: DataFrame, words: DataFrame, known, pairs: DataFrame, triples: DataFrame, within: int, top: int) -> DataFrame:
    word = lambda c: known(words.select(F.col("number").alias(c), "lang", F.col("word").alias(f"{c}_word"), F.col("f").alias(f"{c}_f")))
    first, second = F.shiftright("head", 32), F.col("head").bitwiseAND(F.lit((1 << 32) - 1))
    after = F.shiftleft(second, 32).bitwiseOR(F.col("tail"))
    # pairs mostly within a triple go
    longer = triples.select(F.explode(F.array(F.col("head"), after)).alias("head"), "a").groupBy("head").agg(F.max("a").alias("longer"))
    alone = pairs.join(longer, "head", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < within * F.col("a")))
    two = alone.select("a", first.alias("x"), second.alias("y")).join(word("x"), "x").join(word("y").drop("lang"), "y")
    two = two.select("lang", F.concat_ws(" ", "x_word", "y_word").alias("phrase"), "a", F.col("x_f").alias("l"), F.col("y_f").alias("r"), score("a", "x_f", "y_f").alias("score"))
    three = triples.select("head", "a", first.alias("x"), second.alias("y"), F.col("tail").alias("z"), after.alias("after"))
    three = three.join(pairs.select("head", F.col("a").alias("xy_f")), "head").join(pairs.select(F.col("head").alias("after"), F.col("a").alias("yz_f")), "after")
    three = three.join(word("x"), "x").join(word("y").drop("lang"), "y").join(word("z").drop("lang"), "z")
    cut = lambda at, l, r: F.struct(score("a", l, r).alias("score"), F.lit(at).alias("at"), F.col(l).alias("l"), F.col(r).alias("r"))
    three = three.withColumn("cut", F.least(cut(1, "x_f", "yz_f"), cut(2, "xy_f", "z_f")))
    three = three.select("lang", F.concat_ws(" ", "x_word", "y_word", "z_word").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    by = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))
    best = two.unionByName(three).withColumn("bucket", bucket)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*by))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).where(F.col("rank") <= top)
    totals = sliced.groupBy("lang").agg(F.sum(F.aggregate(F.slice("counts", 2, F.size("counts")), F.lit(0).cast("long"), lambda s, c: s + c)).alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
