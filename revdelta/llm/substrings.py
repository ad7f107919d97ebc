"""Substring deduplication by paragraph MinHash banding.

Paragraphs are lines of at least `min_words` words; shorter lines that follow each other
without a blank line are one paragraph together, as in hard-wrapped text. Equal ones
(without regard to case of A-Z and to spacing) are one class. Each class has a MinHash
signature over its five-word shingles; bands of it find classes to compare, exact Jaccard
similarity decides, and connected components are the clusters, of which one paragraph stays.

Passages pasted into longer lines hide from paragraphs, whose similarity they hardly move.
So what the clusters leave is compared by runs of RUN words, wherever they stand: of every
RUN neighbouring starts the one with the least hash is taken, so two texts that share
2 * RUN - 1 words in a row share a run that both take. The smallest document with a run
keeps it. Taken runs that follow each other in both documents are one passage, whose ends
are moved outwards word by word as far as both agree, which is less than RUN words. Removed
paragraphs take no part, so a run is never kept in a place that is removed itself.

Class tables, bands and runs are shuffled as hashes and places; text is read again only
for classes that share a band with another, documents that lost a paragraph and documents
that hold a shared run.

A document is a row: rows that repeat an id with other text are documents of their own,
rows that repeat id and text count as one. Null and short texts have no paragraphs. Runs
that repeat within one document alone are left to other operators, and so are paragraphs
unless `within` is set. Rows with a null id take no part. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from revdelta.llm.common import components, give_back, hidden, possibly_in, slices, stored

MIN_WORDS = 20
SHINGLE = 5
SIMILARITY = 0.8
#: 8 bands of 3 find a pair of similarity 0.8 with probability 0.997.
BANDS, ROWS = 8, 3
#: Words in a run.
RUN = 24
#: Words that a slice may have: places fill this much of a hash.
PLACES = 1 << 28
#: Drawn members with which a prefix bucket is compared before its pairs are.
PIVOTS = 12
#: Shingles of a prefix that are carried along to see where two prefixes meet first.
AHEAD = 256

_WORD_STARTS = np.zeros(256, bool)
_WORD_STARTS[[9, 10, 11, 12, 13, 32]] = True
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_PERMUTE = np.random.default_rng(20240229).integers(0, 1 << 63, BANDS * ROWS, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)

UNITS = T.StructType(
    [
        T.StructField("doc", T.LongType()),
        T.StructField("row", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("n_words", T.IntegerType()),
        T.StructField("hi", T.IntegerType()),
        T.StructField("lo", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)
#: A taken run that starts at word `at`.
RUNS = T.StructType(
    [
        T.StructField("doc", T.LongType()),
        T.StructField("row", T.LongType()),
        T.StructField("at", T.IntegerType()),
        T.StructField("hi", T.IntegerType()),
        T.StructField("lo", T.LongType()),
    ]
)
#: Words on either side of a run that are compared to move a passage's ends.
SIDE = RUN - 1
#: What stands around the run that starts at word `at`: how many words before it, their
#: hashes, nearest first, and how far before the run each starts; the same behind it; and
#: the run's own place. The binary columns hold SIDE little-endian 32-bit numbers each.
AROUND = (
    "kept_doc long, kept_row long, kept_at int, n_left int, left binary, back binary,"
    " n_right int, right binary, ahead binary, start long, end long"
)
#: Words first to last (exclusive) of a document that another one keeps.
SPANS = "doc long, row long, first int, last int, start long, end long, kept_doc long, kept_row long"
#: Parts in which rows of one key meet its few other rows.
SALTS = 16


def _names(fields: str) -> list[str]:
    return [f.split()[0] for f in fields.split(", ")]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def _rolled(hashes: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """A hash of each `size` neighbouring word hashes."""
    total = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            total = total * base + hashes[i : i + len(total)]
        return _mix(total)


def _sums(hashes: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of hashes, each divided by the base's power of its place (the base is
    odd, so that division is exact), and the powers."""
    n = len(hashes) + 1
    down = np.cumprod(np.full(n, np.uint64(pow(int(base), -1, 1 << 64)), np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * down[:-1], dtype=np.uint64)])
    return sums, np.cumprod(np.full(n, base, np.uint64))


def _ranged(hashes: np.ndarray, base: np.uint64, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of the words in each range, the same wherever the range stands."""
    with np.errstate(over="ignore"):
        sums, powers = _sums(hashes, base)
        return _mix((sums[last] - sums[first]) * powers[first])


def _rolled_at(hashes: np.ndarray, size: int, base: np.uint64, first: np.ndarray) -> np.ndarray:
    """_ranged() of the `size` words from each of the places `first`."""
    return _ranged(hashes, base, first, first + size)


class _Slice:
    """Words of several texts, one after the other, with their hashes and places in code points.

    cuts: for each text, (start, end) places whose words take no part.
    """

    def __init__(self, texts: list[bytes], cuts: list[list[dict] | None] | None = None):
        whole = b"\n\n".join(texts)  # a blank line keeps texts apart
        raw = np.frombuffer(whole, np.uint8)
        gap = _WORD_STARTS[raw]
        edges = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]])))
        first_byte = np.cumsum([0, *(len(t) + 2 for t in texts)])
        points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        at, ends = edges[0::2], edges[1::2]
        #: the text that holds a word, and the first word of each text
        self.owner = np.searchsorted(first_byte, at, "right") - 1
        self.base = np.searchsorted(at, first_byte)
        shift = points[first_byte[:-1]]
        self.starts, self.ends = points[at] - shift[self.owner], points[ends] - shift[self.owner]
        words = whole.lower().split()
        self.hashes = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
        breaks = np.flatnonzero(raw == 10)
        #: number of words before each line and at the end
        self.lines = np.concatenate([[0], np.searchsorted(at, breaks), [len(words)]])
        # barriers: words that no run may cover, and the first words of texts, that none may cross
        gone = np.zeros(len(words) + 1, np.int64)
        for i, cut in enumerate(cuts or ()):
            low, high = self.base[i], self.base[i + 1]
            for place in cut or ():
                first, last = low + np.searchsorted(self.starts[low:high], [place["start"], place["end"]])
                gone[first] += 1
                gone[last] -= 1
        self.gone = np.cumsum(gone[:-1]) > 0
        before = np.concatenate([[0], np.cumsum(self.gone)])
        n = max(0, len(words) - RUN + 1)
        #: whether the run that starts at a word lies in one text and keeps clear of the cuts
        self.clear = (before[RUN : RUN + n] == before[:n]) & (self.owner[RUN - 1 :] == self.owner[:n])

    def paragraphs(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last (exclusive) words of the paragraphs."""
        first, last = self.lines[:-1], self.lines[1:]
        n = last - first
        joins = (n > 0) & (n < least)  # short lines join a short line right before them
        head = (n > 0) & ~(joins & np.concatenate([[False], joins[:-1]]))
        heads = np.flatnonzero(head)
        # a paragraph ends with the last line that has words before the next one starts
        first, last = first[heads], np.maximum.reduceat(last, heads) if len(heads) else heads
        long_enough = last - first >= least
        return first[long_enough], last[long_enough]

    def runs(self) -> np.ndarray:
        """Starts (word numbers) of the runs that are taken, wherever a run is repeated too."""
        n = len(self.clear)
        if not n:
            return np.zeros(0, np.int64)
        # the place fills a hash's low bits: it settles ties to the left, and a minimum names it
        order = _rolled(self.hashes, 2, _BASES[1])[:n] & ~np.uint64(PLACES - 1) | np.arange(n, dtype=np.uint64)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], self.clear, [False]])))
        heads, sizes = edges[0::2], edges[1::2] - edges[0::2]
        short = sizes <= RUN
        taken = [np.array([order[a : a + size].min() for a, size in zip(heads[short].tolist(), sizes[short].tolist())], np.uint64)]
        if not short.all():
            least, width = order, 1
            while 2 * width <= RUN:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if width < RUN:
                least = np.minimum(least[: len(least) - (RUN - width)], least[RUN - width :])
            inside = np.zeros(n + 1, np.int64)
            np.add.at(inside, heads[~short], 1)
            np.add.at(inside, (heads + sizes)[~short] - RUN + 1, -1)
            taken.append(least[np.cumsum(inside)[: len(least)] > 0])
        return np.unique(np.concatenate(taken) & np.uint64(PLACES - 1)).astype(np.int64)

    def run_keys(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """hi and lo of the runs that start at the words `first`."""
        a, b = (_rolled_at(self.hashes, RUN, base, first) for base in _BASES)
        return a.astype(np.uint32).view(np.int32), b.view(np.int64)

    def around(self, text: np.ndarray, head: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, ...]:
        """Word numbers before the runs at `head` of the texts, nearest first, and behind the
        runs at `tail`, SIDE for each, and how many of them count: none that is cut, of
        another text, or beyond one that is."""
        low, high = self.base[text][:, None], self.base[text + 1][:, None]
        left = low + head[:, None] - 1 - np.arange(SIDE)
        right = low + tail[:, None] + RUN + np.arange(SIDE)
        out = []
        for at in (left, right):
            inside = (at >= low) & (at < high)
            at = np.where(inside, at, 0)
            out += [at, np.cumprod(inside & ~self.gone[at], axis=1).sum(axis=1)]
        return tuple(out)


def _bands(shingles: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The bands as signed longs, a row for each range of shingle hashes."""
    ranges = np.stack([first, last], axis=1).ravel()
    padded = np.append(shingles, np.uint64(0))  # a range may end with the hashes
    with np.errstate(over="ignore"):
        least = [_mix(np.minimum.reduceat(padded * p, ranges)[0::2]) for p in _PERMUTE]
        bands = np.zeros((len(first), BANDS), np.uint64)
        for i, column in enumerate(least):
            bands[:, i % BANDS] = bands[:, i % BANDS] * _BASES[0] + column
        return _mix(bands + np.arange(1, BANDS + 1, dtype=np.uint64) * _BASES[1]).view(np.int64)


def _numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False)


def _paragraphs(rows: pa.RecordBatch, least: int) -> pa.RecordBatch:
    t = _Slice(rows.column(0).to_pylist())
    first, last = t.paragraphs(least)
    own = t.owner[first]
    hi, lo = (_ranged(t.hashes, base, first, last) for base in _BASES)
    columns = [
        pa.array(_numbers(rows.column(1))[own]), pa.array(_numbers(rows.column(2))[own]), pa.array(t.starts[first]), pa.array(t.ends[last - 1]),
        pa.array(last - first, pa.int32()), pa.array(hi.astype(np.uint32).view(np.int32)), pa.array(lo.view(np.int64)),
    ]
    if len(first):
        ends = pa.array(np.arange(len(first) + 1) * BANDS, pa.int32())
        bands = _bands(_rolled(t.hashes, SHINGLE, _BASES[0]), first, last - SHINGLE + 1)
        columns.append(pa.ListArray.from_arrays(ends, pa.array(bands.ravel())))
    else:
        columns.append(pa.nulls(0, pa.list_(pa.int64())))
    return pa.RecordBatch.from_arrays(columns, names=UNITS.names)


def _taken(rows: pa.RecordBatch) -> pa.RecordBatch:
    t = _Slice(rows.column(0).to_pylist(), rows.column(3).to_pylist())
    first = t.runs()
    own = t.owner[first]
    hi, lo = t.run_keys(first)
    columns = [_numbers(rows.column(1))[own], _numbers(rows.column(2))[own], (first - t.base[own]).astype(np.int32), hi, lo]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=RUNS.names)


def _blobs(matrix: np.ndarray) -> pa.Array:
    """Rows of 32-bit numbers as binary values."""
    ends = pa.py_buffer(np.arange(0, 4 * SIDE * (len(matrix) + 1), 4 * SIDE, dtype=np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, ends, pa.py_buffer(matrix.astype("<i4").tobytes())])


def _matrix(blobs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), "<i4").reshape(-1, SIDE)


def _contexts(rows: pa.RecordBatch) -> pa.RecordBatch:
    """What stands around the runs of keepers, as AROUND."""
    t = _Slice(rows.column(0).to_pylist(), rows.column(3).to_pylist())
    short = t.hashes.astype(np.uint32).view(np.int32)
    asked = rows.column(4)
    own = np.repeat(np.arange(rows.num_rows), _numbers(asked.value_lengths()))
    at = _numbers(asked.flatten()).astype(np.int64)
    left, n_left, right, n_right = t.around(own, at, at)
    first = t.base[own] + at
    start, end = t.starts[first], t.ends[first + RUN - 1]
    columns = [
        pa.array(_numbers(rows.column(1))[own]), pa.array(_numbers(rows.column(2))[own]), pa.array(at, pa.int32()),
        pa.array(n_left, pa.int32()), _blobs(short[left]), _blobs(start[:, None] - t.starts[left]),
        pa.array(n_right, pa.int32()), _blobs(short[right]), _blobs(t.ends[right] - end[:, None]), pa.array(start), pa.array(end),
    ]
    return pa.RecordBatch.from_arrays(columns, names=_names(AROUND))


def _passages(rows: pa.RecordBatch) -> pa.RecordBatch:
    """The passages of documents, ends moved outwards, and where their keepers have them."""
    t = _Slice(rows.column(0).to_pylist(), rows.column(3).to_pylist())
    short = t.hashes.astype(np.uint32).view(np.int32)
    own = np.repeat(np.arange(rows.num_rows), _numbers(rows.column(4).value_lengths()))
    chain = rows.column(4).flatten()
    of = lambda name: _numbers(chain.field(name)).astype(np.int64)
    blob = lambda name: _matrix(chain.field(name))
    head, tail = of("head"), of("tail")
    left, n_left, right, n_right = t.around(own, head, tail)
    place = np.arange(SIDE)

    def agree(mine: np.ndarray, n_mine: np.ndarray, theirs: np.ndarray, n_theirs: np.ndarray) -> np.ndarray:
        both = place < np.minimum(n_mine, n_theirs)[:, None]
        return np.cumprod((mine == theirs) & both, axis=1).sum(axis=1)

    before, behind = agree(short[left], n_left, blob("left"), of("n_left")), agree(short[right], n_right, blob("right"), of("n_right"))
    row, low = np.arange(len(own)), t.base[own]
    moved = lambda name, n: np.where(n > 0, blob(name)[row, n - 1], 0)
    first, last = head - before, tail + RUN + behind
    kept_first = of("kept_head") - before
    keeper = of("kept_doc"), of("kept_row")
    here = (_numbers(rows.column(1))[own], _numbers(rows.column(2))[own], first, last, t.starts[low + first], t.ends[low + last - 1], *keeper)
    there = (*keeper, kept_first, kept_first + last - first, of("start") - moved("back", before), of("end") + moved("ahead", behind), *keeper)
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    columns = [pa.array(np.concatenate(both), kind) for both, kind in zip(zip(here, there), kinds)]
    return pa.RecordBatch.from_arrays(columns, names=_names(SPANS))


def _sliced(rows: DataFrame, work, schema: T.StructType | str) -> DataFrame:
    """work() over record batches of (raw, ...) rows of about SLICE bytes of raw."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 0):
                if part.num_rows:
                    yield work(part)
        give_back()

    return rows.mapInArrow(run, schema)


def _row(id_col: str, text: str) -> Column:
    """What tells rows of one id apart."""
    return F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text}`").cast("binary"))


def _texts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    given = docs.select(
        F.col(f"`{text}`").cast("binary").alias("raw"), F.col(f"`{id_col}`").cast("long").alias("doc"), _row(id_col, text).alias("row")
    )
    return given.where("doc is not null and length(raw) > 0")


def units(docs: DataFrame, id_col: str, text: str, min_words: int = MIN_WORDS) -> DataFrame:
    """Paragraphs of all documents, as UNITS."""
    return _sliced(_texts(docs, id_col, text), lambda rows: _paragraphs(rows, min_words), UNITS)


def _shingles(places: DataFrame, docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(p, shingles): the distinct shingles of the paragraphs at `places` (p).

    Only documents that hold one are read beyond their id, and only the paragraphs go on.
    """
    wanted = places.select("p", F.col("p.doc").alias("doc"), F.col("p.row").alias("row"))
    own = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc"), _row(id_col, text).alias("row"), F.col(f"`{text}`").alias("words")
    )
    own = possibly_in(own, F.col("row"), wanted, "row", "held").where("held").drop("held")
    texts = own.join(wanted, ["doc", "row"]).select(
        "p", F.substring("words", F.col("p.start") + 1, F.col("p.end") - F.col("p.start")).alias("words")
    )
    lower = F.translate("words", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.transform(
        F.sequence(F.lit(1), F.size("ws") - SHINGLE + 1), lambda i: F.xxhash64(F.slice("ws", i, F.lit(SHINGLE)))
    )
    sets = texts.select("p", words.alias("ws")).select("p", F.array_distinct(hashed).alias("shingles"))
    return sets.dropDuplicates(["p"])


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (u, v) pairs whose exact Jaccard similarity suffices."""
    a = sets.select(F.col("p").alias("u"), F.col("shingles").alias("su"))
    b = sets.select(F.col("p").alias("v"), F.col("shingles").alias("sv"))
    both = pairs.join(a, "u").join(b, "v")
    common = F.size(F.array_intersect("su", "sv"))
    return both.where(common >= similarity * (F.size("su") + F.size("sv") - common)).select("u", "v")


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(s, p, n, at, before): the first n - ceil(similarity * n) + 1 of each paragraph's n shingles,
    rarest first; similar paragraphs share one of them. before holds those ahead of s, the
    AHEAD rarest at most: what it lacks lets a pair meet twice, never not at all."""
    rows = sets.select("p", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    counts = rows.groupBy("s").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("p").orderBy("df", "s"))
    # a merge: Spark takes the rows for as small as the sets that they come from
    ranked = rows.join(counts.hint("merge"), "s").withColumn("at", rank)
    prefix = ranked.where((F.col("at") <= F.col("n") - F.ceil(F.col("n") * similarity) + 1) & (F.col("df") > 1))
    ahead = Window.partitionBy("p").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return prefix.select("s", "p", "n", "at", F.collect_list(F.when(F.col("at") <= AHEAD, F.col("s"))).over(ahead).alias("before"))


def _enough(similarity: float) -> Column:
    """Whether what follows a shared shingle is long enough for the overlap that is needed."""
    left = F.least(F.col("nu") - F.col("au"), F.col("nv") - F.col("av")) + 1
    return left >= (F.col("nu") + F.col("nv")) * (similarity / (1 + similarity)) - 1e-9


def _labelled(rows: DataFrame, known: DataFrame) -> DataFrame:
    named = rows.join(known.withColumnRenamed("node", "p"), "p", "left")
    return named.withColumn("c", F.coalesce("component", "p")).drop("component")


def _as_edges(known: DataFrame) -> DataFrame:
    return known.select(F.col("node").alias("u"), F.col("component").alias("v"))


def _connect(sets: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Components after linking what is similar among `sets` and not connected yet.

    A family of variants has as many similar pairs as its size squared, but a few links
    connect it. So each prefix bucket is first compared with members drawn from it, and only pairs that are then still apart are compared one by one.
    """
    # numbers instead of places: what follows is shuffled several times
    named = stored(_labelled(sets.select("p", "shingles"), known).withColumn("id", F.monotonically_increasing_id()))
    roots = named.groupBy("c").agg(F.min("id").alias("component"))
    labels = stored(named.select("c", F.col("id").alias("node")).join(roots, "c").select("node", "component"))
    own = named.select(F.col("id").alias("p"), "shingles")
    prefix = stored(_prefixes(own, similarity))
    rows = _labelled(prefix.drop("before"), labels)
    mixed = rows.groupBy("s").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least < most").select("s")
    rows = rows.join(mixed, "s")
    drawn = [F.min(F.struct(F.hash("p", F.lit(i)), "p", "n", "at", "c")) for i in range(PIVOTS)]
    pivots = rows.groupBy("s").agg(F.array_distinct(F.array(*drawn)).alias("ds")).select("s", F.explode("ds").alias("d"))
    both = rows.join(pivots, "s").where("c != d.c").select(
        F.least("d.p", "p").alias("u"), F.greatest("d.p", "p").alias("v"), F.col("d.n").alias("nu"), F.col("n").alias("nv"),
        F.col("d.at").alias("au"), F.col("at").alias("av"),
    )
    new = _similar(both.where(_enough(similarity)).select("u", "v").distinct(), own, similarity)
    labels = stored(components(_as_edges(labels).unionByName(new)))
    rows = _labelled(prefix, labels)
    one = rows.select("s", F.col("p").alias("u"), F.col("c").alias("cu"), F.col("n").alias("nu"), F.col("at").alias("au"), F.col("before").alias("bu"))
    two = rows.select("s", F.col("p").alias("v"), F.col("c").alias("cv"), F.col("n").alias("nv"), F.col("at").alias("av"), F.col("before").alias("bv"))
    # a pair meets at the first shingle that it shares only, unless that lies beyond AHEAD
    first = ~F.arrays_overlap("bu", "bv")
    rest = one.join(two, "s").where((F.col("cu") < F.col("cv")) & _enough(similarity) & first).select("u", "v").distinct()
    linked = _as_edges(labels).unionByName(_similar(rest, own, similarity)).where("u != v")
    places = named.select("id", "p")
    back = linked.join(places.withColumnsRenamed({"id": "u", "p": "a"}), "u")
    back = back.join(places.withColumnsRenamed({"id": "v", "p": "b"}), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return components(_as_edges(known).unionByName(back))


def paragraph_clusters(
    docs: DataFrame, id_col: str, text: str, similarity: float, min_words: int = MIN_WORDS, within: bool = False
) -> DataFrame:
    """(doc, row, start, end, n_words, kept_doc, kept_row, kept_start): paragraphs of clusters
    that span documents, or of all that repeat if within is set."""
    lines = stored(units(docs, id_col, text, min_words))
    place = F.struct("doc", "row", "start", "end")
    keys = ["hi", "lo"]
    # bands that different classes share; equal paragraphs meet in the partial aggregate
    banded = lines.select(*keys, F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("lo").alias("a"), F.max("lo").alias("b")).where("a != b")
    shared = stored(shared.select("band"))
    held = possibly_in(banded, F.col("band"), shared, "band", "held").where("held").drop("held")
    held = held.distinct().join(shared, "band")
    whose = F.struct("doc", "row", "start") if within else F.struct("doc", "row")
    classes = lines.groupBy(*keys).agg(F.min(place).alias("p"), F.max(whose).alias("last"))
    named = possibly_in(lines, F.col("lo"), held, "lo", "held").where("held")
    members = stored(held.join(named.groupBy(*keys).agg(F.min(place).alias("p")), keys).select("p", "band"))
    sets = stored(_shingles(members.select("p").distinct(), docs, id_col, text))
    # first to the shortest of the bucket, which other paragraphs may contain
    length = F.col("p.end") - F.col("p.start")
    pivots = members.groupBy("band").agg(F.min(F.struct(length, "p")).alias("least")).select("band", F.col("least.p").alias("pivot"))
    stars = members.join(pivots, "band").where("p != pivot").select(F.col("pivot").alias("u"), F.col("p").alias("v"))
    known = stored(components(_similar(stars.distinct(), sets, similarity)))
    # then what this leaves apart within a bucket
    labelled = _labelled(members, known)
    mixed = labelled.groupBy("band").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least < most")
    apart = labelled.join(mixed.select("band"), "band").select("p").distinct()
    roots = _connect(apart.join(sets, "p"), known, similarity).select(F.col("node").alias("p"), "component")
    # most classes are one paragraph of one document: they are done with before the next shuffle
    first = F.struct("p.doc", "p.row", "p.start") if within else F.struct("p.doc", "p.row")
    rooted = classes.join(roots, "p", "left").select(
        *keys, first.alias("first"), "last", F.coalesce("component", "p").alias("component"),
        F.col("component").isNotNull().alias("linked"),
    ).where("linked or first < last")
    spread = rooted.groupBy("component").agg(F.min("first").alias("a"), F.max("last").alias("b")).where("a < b")
    rooted = stored(rooted.join(spread.select("component"), "component").select(*keys, "component"))
    found = possibly_in(lines.drop("bands"), F.col("lo"), rooted, "lo", "held").where("held").drop("held")
    return found.join(rooted, keys).select(
        "doc", "row", "start", "end", "n_words", F.col("component.doc").alias("kept_doc"),
        F.col("component.row").alias("kept_row"), F.col("component.start").alias("kept_start"),
    )


def _with_cuts(texts: DataFrame, cuts: DataFrame) -> DataFrame:
    """texts plus `cut`, what paragraphs removed; only documents that lost some are joined."""
    flagged = possibly_in(texts, F.col("row"), cuts, "row", "held")
    hit = flagged.where("held").drop("held").join(cuts, ["doc", "row"], "left").select(*texts.columns, "cut")
    whole = flagged.where("not held").drop("held").withColumn("cut", F.lit(None).cast(cuts.schema["cut"].dataType))
    return whole.unionByName(hit)


def _salted(many: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """Join on keys of which one may hold a large share of `many`: its rows are dealt to
    SALTS parts, each of which gets a copy of `few`, where a key has few rows. Spark takes the
    copies for as small as `few` and would broadcast them; so the join is a merge."""
    salt = F.pmod(F.xxhash64("doc", "row"), F.lit(SALTS)).cast("int")
    copies = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("salt", salt).join(copies.hint("merge"), [*keys, "salt"]).drop("salt")


def _asked(texts: DataFrame, cuts: DataFrame, asked: DataFrame) -> DataFrame:
    """(raw, doc, row, cut, asked) of the documents that `asked` (doc, row, asked) names."""
    own = possibly_in(texts, F.col("row"), asked, "row", "held").where("held").drop("held")
    return _with_cuts(own, cuts).join(asked, ["doc", "row"]).select("raw", "doc", "row", "cut", "asked")


def shared_runs(docs: DataFrame, id_col: str, text: str, cuts: DataFrame) -> DataFrame:
    """(doc, row, start, end, n_words, kept_doc, kept_row): passages that stand in several
    documents. cuts (doc, row, cut) names places that take no part.

    All taken runs are shuffled by key; texts are read again only where a taken run is
    shared, once for what stands around runs in their keepers and once to compare it.
    Overlapping finds with the same keeper are one passage.
    """
    texts = _texts(docs, id_col, text)
    runs = stored(_sliced(_with_cuts(texts, cuts), _taken, RUNS))
    keys = ["hi", "lo"]
    shared = runs.groupBy(*keys).agg(F.min("row").alias("a"), F.max("row").alias("b")).where("a != b")
    shared = stored(shared.select(*keys))
    held = stored(possibly_in(runs, F.col("lo"), shared, "lo", "held").where("held").drop("held").join(shared, keys))
    first = held.groupBy(*keys).agg(F.min(F.struct("doc", "row", "at")).alias("kept"))
    first = first.select(*keys, F.col("kept.doc").alias("kept_doc"), F.col("kept.row").alias("kept_row"), F.col("kept.at").alias("kept_at"))
    pairs = _salted(held, first, keys).where("doc != kept_doc or row != kept_row or at != kept_at")
    # runs that follow each other, here as in the keeper, are one passage
    passage = ["doc", "row", "kept_doc", "kept_row"]
    along = Window.partitionBy(*passage).orderBy("at")
    step = F.col("at") - F.lag("at").over(along)
    follows = (step <= RUN) & (step == F.col("kept_at") - F.lag("kept_at").over(along))
    chained = pairs.withColumn("opens", F.when(follows, 0).otherwise(1))
    chained = chained.withColumn("chain", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    chains = stored(chained.groupBy(*passage, "chain").agg(
        F.min("at").alias("head"), F.max("at").alias("tail"), F.min("kept_at").alias("kept_head"), F.max("kept_at").alias("kept_tail")
    ))
    ends = F.explode(F.array("kept_head", "kept_tail")).alias("at")
    wanted = chains.select("kept_doc", "kept_row", ends).distinct().groupBy(F.col("kept_doc").alias("doc"), F.col("kept_row").alias("row"))
    around = stored(_sliced(_asked(texts, cuts, wanted.agg(F.collect_list("at").alias("asked"))), _contexts, AROUND))
    keeper = ["kept_doc", "kept_row"]
    before = around.select(*keeper, F.col("kept_at").alias("kept_head"), "n_left", "left", "back", "start")
    behind = around.select(*keeper, F.col("kept_at").alias("kept_tail"), "n_right", "right", "ahead", "end")
    told = _salted(_salted(chains, before, [*keeper, "kept_head"]), behind, [*keeper, "kept_tail"])
    known = F.struct("head", "tail", *keeper, "kept_head", "n_left", "left", "back", "start", "n_right", "right", "ahead", "end")
    asked = told.groupBy("doc", "row").agg(F.collect_list(known).alias("asked"))
    found = _sliced(_asked(texts, cuts, stored(asked)), _passages, SPANS).distinct()
    order = Window.partitionBy(*passage).orderBy("first")
    ahead = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("first") <= ahead, 0).otherwise(1)
    merged = found.withColumn("opens", opens).withColumn("passage", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return merged.groupBy(*passage, "passage").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max("last") - F.min("first")).alias("n_words")
    ).drop("passage")


REMOVED = "doc != kept_doc or row != kept_row"


def _both(docs: DataFrame, id_col: str, text: str, similarity: float, min_words: int, within: bool) -> DataFrame:
    if min_words < SHINGLE:
        raise ValueError("a paragraph needs the words of one shingle")
    lines = stored(paragraph_clusters(docs, id_col, text, similarity, min_words, within))
    lines = lines.withColumn("removed", F.expr(f"{REMOVED} or start != kept_start"))
    cuts = lines.where("removed").groupBy("doc", "row").agg(F.collect_list(F.struct("start", "end")).alias("cut"))
    runs = shared_runs(docs, id_col, text, stored(cuts)).withColumn("removed", F.expr(REMOVED))
    runs = runs.withColumn("kept_start", F.lit(None).cast("long"))
    return lines.withColumn("kind", F.lit("paragraph")).unionByName(runs.withColumn("kind", F.lit("run")))


def find(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
    min_words: int = MIN_WORDS, within: bool = False,
) -> DataFrame:
    """A row for every paragraph or passage of runs that repeats across documents, the kept
    ones too.

    Columns: <id_col>, kind ("paragraph" or "run"), start, end (code points from 0, end
    exclusive), n_words, kept_doc_id, kept_start (what stays of the cluster; null for runs), removed.
    A paragraph is removed unless it is the kept one; a passage unless it is in the
    document that keeps it. Of rows that repeat id and text one is told of.
    """
    return _both(docs, id_col, text, similarity, min_words, within).select(
        F.col("doc").alias(id_col), "kind", "start", "end", "n_words",
        F.col("kept_doc").alias("kept_doc_id"), "kept_start", "removed",
    )


def remove(text: Column, spans: Column) -> Column:
    """text without the (start, end) spans, and without lines that they empty."""

    def cut(t: str, places: list[dict]) -> str:
        kept, at = [], 0
        for start, end in sorted((s["start"], s["end"]) for s in places):
            kept.append(t[at:start])
            at = max(at, end)
            if (start == 0 or t[start - 1] == "\n") and t[at : at + 1] == "\n":
                at += 1
        whole = "".join([*kept, t[at:]])
        return whole.removesuffix("\n") if at == len(t) else whole

    def without(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, all_spans in batches:
            yield pa.array(map(cut, texts.to_pylist(), all_spans.to_pylist()), pa.string())
        give_back()

    # else a filter on the result runs the function once more, in a second worker for each core
    return F.arrow_udf("string")(without).asNondeterministic()(text, spans)


def dedup(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
    min_words: int = MIN_WORDS, within: bool = False,
) -> DataFrame:
    """docs with the removed paragraphs and runs cut out; a document of which nothing but
    white space stays goes. Documents without repeats pass through unchanged."""
    spans = _both(docs, id_col, text, similarity, min_words, within).where("removed").groupBy("doc", "row")
    held, row, cut_out = (hidden(docs, name) for name in ("held", "row", "spans"))
    spans = stored(spans.agg(F.collect_list(F.struct("start", "end")).alias(cut_out)))
    # documents without spans do not take part in the join
    parted = possibly_in(docs.withColumn(row, _row(id_col, text)), F.col(row), spans, "row", held)
    id_key = hidden(docs, "doc")
    spans = spans.select(F.col("doc").alias(id_key), F.col("row").alias(f"{row}_"), cut_out)
    key = (F.col(f"`{id_col}`").cast("long") == F.col(id_key)) & (F.col(row) == F.col(f"{row}_"))
    joined = parted.where(held).join(spans, key, "left")
    hit = joined.where(F.col(cut_out).isNotNull()).withColumn(text, remove(F.col(f"`{text}`"), F.col(cut_out)))
    hit = hit.where(F.col(f"`{text}`").rlike(r"\S"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rest = parted.where(~F.col(held)).select(*columns)
    return rest.unionByName(joined.where(F.col(cut_out).isNull()).select(*columns)).unionByName(hit.select(*columns))
