"""Pairing the pages of two revisions by content."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revdelta.functions import text as X
from revdelta.operators.matching import greedy
from revdelta.sources.scratch import stored

#: Fixed values of the alignment.
BAND, GAP, MOVE_ABOVE = 12, -0.3, 0.75


def fingerprints(pages: DataFrame) -> DataFrame:
    """(pair_id, side, page_number, words, n_words): the distinct words of every page."""
    words = pages.select("pair_id", "side", "page_number", X.fingerprint(F.col("text")).alias("words"))
    return words.withColumn("n_words", F.size("words"))


def jaccard(a: str, b: str) -> Column:
    """Similarity of two word arrays; two empty pages are alike, one empty page is not."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, 1.0).otherwise(common / F.greatest(union, F.lit(1)))


def _side(prints: DataFrame, side: str, page: str, words: str) -> DataFrame:
    own = prints.where(F.col("side") == side)
    return own.select("pair_id", F.col("page_number").alias(page), F.col("words").alias(words))


def similar_pages(prints: DataFrame, least: float = X.PAGE_MATCH) -> DataFrame:
    """(pair_id, earlier_page, newer_page, similarity) of all page pairs of a document
    that are at least that similar.

    Two such pages share one of their rarest words, so only a prefix of each page's
    words, rarest first, is joined; common words never meet.
    """
    words = prints.select("pair_id", "side", "page_number", "n_words", F.explode("words").alias("word"))
    counts = words.groupBy("pair_id", "word").agg(F.count("*").alias("df"))
    ranked = words.join(counts, ["pair_id", "word"]).withColumn(
        "place", F.row_number().over(Window.partitionBy("pair_id", "side", "page_number").orderBy("df", "word"))
    )
    prefix = ranked.where((F.col("place") <= F.col("n_words") - F.ceil(F.col("n_words") * least) + 1) & (F.col("df") > 1))
    own = lambda side, p: prefix.where(F.col("side") == side).select(
        "pair_id", "word", F.col("page_number").alias(f"{side}_page"), F.col("n_words").alias(f"{p}n"), F.col("place").alias(f"{p}p")
    )
    # what still can be shared from here on must reach the overlap that the similarity needs
    left = F.least(F.col("an") - F.col("ap"), F.col("bn") - F.col("bp")) + 1
    enough = left >= (F.col("an") + F.col("bn")) * (least / (1 + least)) - 1e-9
    met = own("earlier", "a").join(own("newer", "b"), ["pair_id", "word"]).where(enough)
    candidates = met.select("pair_id", "earlier_page", "newer_page").distinct()
    empty = prints.where("n_words = 0")
    blank = _side(empty, "earlier", "earlier_page", "w").drop("w").join(
        _side(empty, "newer", "newer_page", "w").drop("w"), "pair_id"
    )
    pairs = candidates.unionByName(blank)
    scored = pairs.join(_side(prints, "earlier", "earlier_page", "wa"), ["pair_id", "earlier_page"]).join(
        _side(prints, "newer", "newer_page", "wb"), ["pair_id", "newer_page"]
    )
    scored = scored.select("pair_id", "earlier_page", "newer_page", jaccard("wa", "wb").alias("similarity"))
    return scored.where(F.col("similarity") >= least)


def by_position(prints: DataFrame) -> DataFrame:
    """Page i with page i; what has no partner is added or removed."""
    a = _side(prints, "earlier", "earlier_page", "wa").withColumn("idx", F.col("earlier_page"))
    b = _side(prints, "newer", "newer_page", "wb").withColumn("idx", F.col("newer_page"))
    both = a.join(b, ["pair_id", "idx"], "full_outer")
    kind = F.when(F.col("newer_page").isNull(), "removed").when(F.col("earlier_page").isNull(), "added")
    score = F.when(F.col("earlier_page").isNull() | F.col("newer_page").isNull(), 0.0).otherwise(jaccard("wa", "wb"))
    return both.select(
        "pair_id", "idx", "earlier_page", "newer_page", kind.otherwise("matched").alias("kind"), score.alias("similarity")
    )


#: Pages of a side that one task holds.
TILE = 1000
TILE_KEY = ["pair_id", "ti", "tj"]


def _sizes(prints: DataFrame) -> DataFrame:
    """(pair_id, n, m, drift, width): pages of both sides, and the band around the diagonal."""
    sizes = prints.groupBy("pair_id").agg(
        F.count_if(F.col("side") == "earlier").alias("n"), F.count_if(F.col("side") == "newer").alias("m")
    )
    return sizes.withColumn("drift", F.col("n") / F.greatest("m", F.lit(1)))


def _tiles(sizes: DataFrame, tile: int) -> DataFrame:
    """The squares of `tile` pages a side that the band touches, by their row and column."""
    rows = sizes.where("n > 0 and m > 0").withColumn("ti", F.explode(F.expr(f"sequence(0, (n - 1) div {tile})")))
    low = F.greatest(F.lit(1), F.floor((F.col("ti") * tile + 1 - F.col("width")) / F.col("drift")))
    high = F.least(F.col("m"), F.ceil((F.least(F.col("n"), (F.col("ti") + 1) * tile) + F.col("width")) / F.col("drift")))
    columns = F.sequence(F.floor((low - 1) / tile).cast("int"), F.floor((high - 1) / tile).cast("int"))
    return rows.select("pair_id", "n", "m", "drift", "width", F.col("ti").cast("int").alias("ti"), F.explode(columns).alias("tj"))


@dataclass
class _Tile:
    """A square of the band: rows r0 + 1 .. r0 + height, columns c0 + 1 .. c0 + breadth.

    low, high: the columns of each row that the band holds, counted from c0 + 1 as 1 (none
    where low > high); similar: similarities of those, left-aligned, or 0.
    """

    r0: int
    c0: int
    low: np.ndarray
    high: np.ndarray
    breadth: int
    similar: np.ndarray

    @classmethod
    def band(cls, n: int, m: int, drift: float, width: int, ti: int, tj: int, tile: int) -> _Tile:
        r0, c0 = ti * tile, tj * tile
        height, breadth = min(tile, n - r0), min(tile, m - c0)
        r = np.arange(r0 + 1, r0 + height + 1)
        inside = lambda c: np.abs(r - c * drift) <= width
        low, high = np.floor((r - width) / drift).astype(np.int64) + 2, np.ceil((r + width) / drift).astype(np.int64) - 2
        for _ in range(4):  # the quotients are rounded, the band's rule is not
            low = np.where(inside(low - 1), low - 1, low)
            high = np.where(inside(high + 1), high + 1, high)
        low, high = np.maximum(low - c0, 1), np.minimum(high - c0, breadth)
        span = max(int((high - low).max()) + 1, 1)
        return cls(r0, c0, low, high, breadth, np.zeros((height, span)))

    def compare(self, ours: list[list[str]], theirs: list[list[str]]) -> None:
        """Fill in the similarities of word sets: common words over all words."""
        postings: dict[str, list[int]] = {}
        for c, words in enumerate(theirs):
            for w in words:
                postings.setdefault(w, []).append(c)
        holds = {w: np.array(c) for w, c in postings.items()}
        n_theirs = np.array([len(w) for w in theirs])
        for i, words in enumerate(ours):
            low, high = self.low[i], self.high[i]
            if low > high:
                continue
            met = [holds[w] for w in words if w in holds]
            common = np.bincount(np.concatenate(met), minlength=self.breadth) if met else np.zeros(self.breadth, np.int64)
            common = common[low - 1 : high]
            union = len(words) + n_theirs[low - 1 : high] - common
            self.similar[i, : high - low + 1] = np.where(union == 0, 1.0, common / np.maximum(union, 1))

    def walk(self, top: np.ndarray, left: np.ndarray, match: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best scores, one diagonal after the other: the last row's, the last column's, and
        the step that led to each cell (0 both pages, 1 an earlier one, 2 a newer one).

        top, left: scores of the row above and of the column before, both from the corner on.
        """
        height, span = self.similar.shape
        last_row, last_column = np.full(self.breadth + 1, -np.inf), np.full(height + 1, -np.inf)
        p = np.arange(1, height + 1)
        base = (p - 1) * span - p - self.low
        enter, leave = p + self.low, p + self.high
        gains, came = self.similar.ravel(), np.zeros(self.similar.size, np.int8)
        before = previous = None
        for s in range(height + self.breadth + 1):
            now = np.full(height + 1, -np.inf)
            if s <= self.breadth:
                now[0] = top[s]
            if s <= height:
                now[s] = left[s]
            first, end = np.searchsorted(leave, s), np.searchsorted(enter, s, "right")
            if first < end:
                at = base[first:end] + s
                both = before[first:end] + gains[at] - match
                ours, theirs = previous[first:end] + GAP, previous[first + 1 : end + 1] + GAP
                best = np.maximum(np.maximum(both, ours), theirs)
                came[at] = np.where(both == best, 0, np.where(ours == best, 1, 2))
                now[first + 1 : end + 1] = best
            if s >= height:
                last_row[s - height] = now[height]
            if s >= self.breadth:
                last_column[s - self.breadth] = now[s - self.breadth]
            before, previous = previous, now
        return last_row, last_column, came.reshape(self.similar.shape)

    def back(self, came: np.ndarray, r: int, c: int) -> tuple[list[tuple], int, int]:
        """The path's steps within the tile down to (r, c), and the cell before them."""
        steps = []
        p, q = r - self.r0, c - self.c0
        while p > 0 and q > 0:
            at = q - self.low[p - 1]
            held = 0 <= at and q <= self.high[p - 1]
            way = came[p - 1, at] if held else 1
            here = (p + self.r0, q + self.c0)
            if way == 0:
                steps.append((sum(here), *here, "matched", float(self.similar[p - 1, at])))
                p, q = p - 1, q - 1
            elif way == 1:
                steps.append((sum(here), here[0], None, "removed", 0.0))
                p -= 1
            else:
                steps.append((sum(here), None, here[1], "added", 0.0))
                q -= 1
        return steps, p + self.r0, q + self.c0


_STEP = "step int, earlier int, newer int, kind string, similarity double"
_TOLD = f"pair_id string, ti int, tj int, {_STEP}, n int, m int, drift double, width int, r int, c int, sort string, cells binary"
_TYPES = dict(f.split() for f in _TOLD.split(", "))
_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
_SCHEMA = pa.schema([(name, _ARROW[kind]) for name, kind in _TYPES.items()])


def _rows(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=_SCHEMA)


def _steps(key: dict, steps: list[tuple]) -> list[dict]:
    return [key | dict(zip(("step", "earlier", "newer", "kind", "similarity"), s), sort="step") for s in steps]


def _border(length: int, start: int) -> np.ndarray:
    return (np.arange(length + 1) + start) * GAP


def _edge(tile: _Tile, given: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Scores above and before a tile: borders of the table, handed on by tiles, or nothing."""
    read = lambda name, n: np.frombuffer(given[name]) if name in given else np.full(n + 1, -np.inf)
    height = len(tile.low)
    top = _border(tile.breadth, tile.c0) if tile.r0 == 0 else read("top", tile.breadth)
    left = _border(height, tile.r0) if tile.c0 == 0 else read("left", height)
    return top, left


def paths(prints: DataFrame, match: float = X.PAGE_MATCH, band: int = BAND, tile: int = TILE) -> DataFrame:
    """(pair_id, step, earlier, newer, kind, similarity) before moves are looked for: the best
    monotone path through every document's band; steps ascend but leave out numbers.

    A step on the diagonal earns the similarity over the threshold, a gap costs; equal
    steps prefer the diagonal, then leaving out an earlier page. A cell outside the band
    is never entered from inside; the borders are always there.

    The band is cut into squares of `tile` pages a side, so a task holds two times as many
    pages however long a document is or however much longer one side is. Similarities
    of all squares are computed at once. A document of one square is done with that. Of
    the others, squares on one diagonal follow each other, handing on the scores at their
    edges; then the path is read back from square to square. So a document of n and m
    pages takes about 2 (n + m) / tile rounds, whatever number of documents there is.
    """
    spark = prints.sparkSession
    width = F.greatest(F.lit(band), F.abs(F.col("n") - F.col("m")) + 1).cast("int")
    sizes = stored(_sizes(prints).withColumn("width", width).withColumn("n", F.col("n").cast("int")).withColumn("m", F.col("m").cast("int")))
    # documents with one side only are told at once
    alone = lambda n, m, kind: sizes.where(f"{n} > 0 and {m} = 0").select("pair_id", F.explode(F.expr(f"sequence(1, {n})")).alias("step")).select(
        "pair_id", "step", *[(F.col("step") if kind == k else F.lit(None).cast("int")).alias(a) for k, a in (("removed", "earlier"), ("added", "newer"))],
        F.lit(kind).alias("kind"), F.lit(0.0).alias("similarity"),
    )
    one_sided = alone("n", "m", "removed").unionByName(alone("m", "n", "added"))
    squares = _tiles(sizes, tile)
    rank = F.row_number().over(Window.partitionBy("pair_id", "side").orderBy("page_number"))
    placed = stored(prints.select("pair_id", "side", "words", rank.alias("place")).withColumn("at", F.floor((F.col("place") - 1) / tile).cast("int")))
    own = lambda side, t: placed.where(F.col("side") == side).drop("side").withColumnRenamed("at", t).join(squares, ["pair_id", t])
    pages = own("earlier", "ti").withColumn("side", F.lit("a")).unionByName(own("newer", "tj").withColumn("side", F.lit("b")))

    def compare(table: pa.Table) -> pa.Table:
        key = {c: table.column(c)[0].as_py() for c in TILE_KEY}
        n, m, drift, wide = (table.column(c)[0].as_py() for c in ("n", "m", "drift", "width"))
        square = _Tile.band(n, m, drift, wide, key["ti"], key["tj"], tile)
        sides = {"a": {}, "b": {}}
        for side, place, words in zip(*(table.column(c).to_pylist() for c in ("side", "place", "words"))):
            sides[side][place] = words
        square.compare(*([sides[s][p] for p in sorted(sides[s])] for s in "ab"))
        if n <= tile and m <= tile:
            _, _, came = square.walk(*_edge(square, {}), match)
            steps, r, c = square.back(came, n, m)
            return _rows([*_steps(key, steps), *([key | {"r": r, "c": c, "sort": "at"}] if r or c else [])])
        told = {"n": n, "m": m, "drift": drift, "width": wide, "cells": zlib.compress(square.similar.tobytes(), 1), "sort": "tile"}
        return _rows([key | told])

    found = stored(pages.groupBy(*TILE_KEY).applyInArrow(compare, _TOLD))
    steps, ends = found.where("sort = 'step'"), found.where("sort = 'at'")
    long = sizes.where(f"n > {tile} or m > {tile}").where("n > 0 and m > 0")
    if not long.isEmpty():
        cells = stored(found.where("sort = 'tile'").withColumn("diagonal", F.col("ti") + F.col("tj")), ["diagonal"])
        more, stops = _long_paths(cells, long, match, tile)
        steps, ends = steps.unionByName(more), ends.unionByName(stops)
    plain = ["pair_id", "step", "earlier", "newer", "kind", "similarity"]
    # what is left once one side is used up
    rest = lambda at, kind: ends.where(f"{at} > 0").select("pair_id", F.explode(F.expr(f"sequence(1, {at})")).alias("step")).select(
        "pair_id", "step", *[(F.col("step") if kind == k else F.lit(None).cast("int")).alias(a) for k, a in (("removed", "earlier"), ("added", "newer"))],
        F.lit(kind).alias("kind"), F.lit(0.0).alias("similarity"),
    )
    return steps.select(*plain).unionByName(rest("r", "removed")).unionByName(rest("c", "added")).unionByName(one_sided)


def _long_paths(cells: DataFrame, long: DataFrame, match: float, tile: int) -> tuple[DataFrame, DataFrame]:
    """Steps of documents of several squares, and where their paths meet a border."""

    def square_of(table: pa.Table) -> tuple[dict, _Tile, dict, list[dict]]:
        rows = table.to_pylist()
        own = next(r for r in rows if r["sort"] == "tile")
        square = _Tile.band(own["n"], own["m"], own["drift"], own["width"], own["ti"], own["tj"], tile)
        square.similar = np.frombuffer(zlib.decompress(own["cells"])).reshape(square.similar.shape)
        given = {r["sort"]: r["cells"] for r in rows if r["sort"] in ("top", "left")}
        return {c: own[c] for c in TILE_KEY}, square, given, [r for r in rows if r["sort"] == "at"]

    def forward(table: pa.Table) -> pa.Table:
        if "tile" not in table.column("sort").to_pylist():
            return _rows([])  # beyond the table or the band
        key, square, given, _ = square_of(table)
        last_row, last_column, _ = square.walk(*_edge(square, given), match)
        below = key | {"ti": key["ti"] + 1, "sort": "top", "cells": last_row.tobytes()}
        return _rows([below, key | {"tj": key["tj"] + 1, "sort": "left", "cells": last_column.tobytes()}])

    def backward(table: pa.Table) -> pa.Table:
        if "at" not in table.column("sort").to_pylist():
            return _rows([])
        key, square, given, ats = square_of(table)
        _, _, came = square.walk(*_edge(square, given), match)
        steps, r, c = square.back(came, ats[0]["r"], ats[0]["c"])
        at = {"ti": (r - 1) // tile, "tj": (c - 1) // tile, "r": r, "c": c, "sort": "at"}
        return _rows([*_steps(key, steps), key | at])

    each = lambda df, f: stored(df.groupBy(*TILE_KEY).applyInArrow(f, _TOLD))
    last = cells.agg(F.max("diagonal")).first()[0]
    handed, edges = None, None
    for diagonal in range(last):
        now = cells.where(F.col("diagonal") == diagonal).drop("diagonal")
        handed = each(now if handed is None else now.unionByName(handed), forward)
        edges = handed if edges is None else edges.unionByName(handed)
    edges = stored(edges.withColumn("diagonal", F.col("ti") + F.col("tj")), ["diagonal"])
    start = {"r": F.col("n"), "c": F.col("m"), "ti": F.floor((F.col("n") - 1) / tile), "tj": F.floor((F.col("m") - 1) / tile), "pair_id": F.col("pair_id"), "sort": F.lit("at")}
    at = stored(long.select(*[start.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in _TYPES.items()]))
    steps = stops = None
    while True:
        on = [r[0] for r in at.where("r > 0 and c > 0").select(F.col("ti") + F.col("tj")).distinct().collect()]  # a number for each round left
        done = at.where("r = 0 or c = 0")
        stops = done if stops is None else stops.unionByName(done)
        if not on:
            return steps.where("sort = 'step'"), stops
        here = at.where("r > 0 and c > 0")
        key = F.broadcast(here.select(*TILE_KEY)) if at.count() <= 10_000 else here.select(*TILE_KEY)
        held = cells.where(F.col("diagonal").isin(on)).unionByName(edges.where(F.col("diagonal").isin(on))).drop("diagonal")
        told = each(held.join(key, TILE_KEY, "left_semi").select(*_TYPES).unionByName(here), backward)
        steps = told if steps is None else steps.unionByName(told)
        at = told.where("sort = 'at'")


def align(prints: DataFrame, match: float = X.PAGE_MATCH, band: int = BAND, moves: bool = True, tile: int = TILE) -> DataFrame:
    """(pair_id, idx, earlier_page, newer_page, kind, similarity), moved pages paired again.

    Each removed page, in order, takes the most similar added page that is still free and
    above MOVE_ABOVE, the first among equals; the pair stands where the first of the two
    stood.
    """
    prints = stored(prints)
    found = stored(paths(prints, match, band, tile))
    rank = F.row_number().over(Window.partitionBy("pair_id", "side").orderBy("page_number"))
    places = prints.select("pair_id", "side", "page_number", "words", rank.alias("place"))
    a = places.where("side = 'earlier'").select("pair_id", F.col("place").alias("earlier"), F.col("page_number").alias("earlier_page"), F.col("words").alias("wa"))
    b = places.where("side = 'newer'").select("pair_id", F.col("place").alias("newer"), F.col("page_number").alias("newer_page"), F.col("words").alias("wb"))
    named = found.join(a, ["pair_id", "earlier"], "left").join(b, ["pair_id", "newer"], "left")
    plain = named.select("pair_id", "step", "earlier_page", "newer_page", "kind", "similarity")
    if moves:
        gone = named.where("kind = 'removed'").select("pair_id", F.col("step").alias("s1"), "earlier_page", "wa")
        come = named.where("kind = 'added'").select("pair_id", F.col("step").alias("s2"), "newer_page", "wb")
        # only pages that share a rare enough word can be that similar: the prefix join again
        near = similar_pages(prints.join(
            gone.select("pair_id", F.lit("earlier").alias("side"), F.col("earlier_page").alias("page_number"))
            .unionByName(come.select("pair_id", F.lit("newer").alias("side"), F.col("newer_page").alias("page_number"))),
            ["pair_id", "side", "page_number"], "left_semi",
        ), MOVE_ABOVE).where(F.col("similarity") > MOVE_ABOVE)
        options = near.join(gone.drop("wa"), ["pair_id", "earlier_page"]).join(come.drop("wb"), ["pair_id", "newer_page"])
        moved = stored(greedy(options, ["pair_id", "s1"], ["pair_id", "s2"], ["s1", F.col("similarity").desc(), "s2"]))
        gone_steps = moved.select("pair_id", F.explode(F.array("s1", "s2")).alias("step"))
        plain = plain.join(gone_steps, ["pair_id", "step"], "left_anti").unionByName(
            moved.select("pair_id", F.least("s1", "s2").alias("step"), "earlier_page", "newer_page", F.lit("moved").alias("kind"), "similarity")
        )
    order = Window.partitionBy("pair_id").orderBy("step")
    return plain.select("pair_id", F.row_number().over(order).alias("idx"), "earlier_page", "newer_page", "kind", "similarity")
