"""Lines of positioned text: grouping items, matching lines across revisions, changes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revdelta.functions import text as X
from revdelta.operators import edits
from revdelta.operators.matching import greedy
from revdelta.sources.scratch import stored

PAGE = ["pair_id", "side", "page_number"]
#: Fixed values of the line rules.
ATOMIC_CHARS, ATOMIC_SHARE = 12, 0.7
FLOOR_SHORT, FLOOR = 0.72, 0.52
SHIFT_TOLERANCE = 1.5


def ordered(items: DataFrame) -> DataFrame:
    """Items with `place`, their reading order: bands of the page's usual font height, then x.

    The band is a page's own: 0.35 of its upper median font size.
    """
    shown = items.where(F.trim("str") != "")
    by_size = Window.partitionBy(*PAGE).orderBy("font_size", "item_index")
    counted = shown.withColumn("k", F.row_number().over(by_size)).withColumn("n", F.count("*").over(Window.partitionBy(*PAGE)))
    median = F.max(F.when(F.col("k") == F.floor(F.col("n") / 2) + 1, F.col("font_size"))).over(Window.partitionBy(*PAGE))
    band = counted.withColumn("band", F.floor(F.col("y") / F.greatest(F.lit(0.5), median * 0.35) + 0.5))
    return band.withColumn("place", F.row_number().over(Window.partitionBy(*PAGE).orderBy("band", "x", "item_index"))).drop("k", "n")


def char_width(width: str, text: str) -> Column:
    return F.col(width) / F.greatest(F.lit(1), F.length(text))


def columns_of(rows: DataFrame, keys: list[str], page_width: float) -> DataFrame:
    """rows plus `col`: along x, a wide gap starts a new column. Session windows in space."""
    along = Window.partitionBy(*keys).orderBy("x", "place")
    w = F.col("width") / F.greatest(F.lit(1), F.length("str"))
    gap = F.col("x") - (F.lag("x").over(along) + F.lag("width").over(along))
    wide = gap > F.greatest(F.lit(page_width * 0.018), (F.lag(w).over(along) + w) * 1.15)
    fresh = F.when(F.lag("x").over(along).isNull() | wide, 1).otherwise(0)
    return rows.withColumn("col", F.sum(fresh).over(along.rowsBetween(Window.unboundedPreceding, 0)))


def rows_of(placed: DataFrame) -> DataFrame:
    """placed plus `row`: each item joins the nearest open row on its height, or opens one.

    The choice depends on the rows that earlier items opened, so a page is one group.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        anchors: list[tuple[float, float, float]] = []
        rows: list[int] = []
        for y, height, size in zip(pdf["y"], pdf["height"], pdf["font_size"]):
            center, best, nearest = y + height / 2, -1, math.inf
            for at in range(len(anchors) - 1, -1, -1):
                ay, ah, asize = anchors[at]
                away = abs(ay + ah / 2 - center)
                if away > max(asize, size) * 1.2:
                    break
                overlap = min(ay + ah, y + height) - max(ay, y)
                level = overlap >= max(0.01, min(ah, height)) * 0.3 or away <= max(asize, size) * 0.5
                if level and away < nearest:
                    best, nearest = at, away
            if best < 0:
                best = len(anchors)
                anchors.append((y, height, size))
            rows.append(best)
        return pdf.assign(row=rows)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema) + ", row int"
    return placed.groupBy(*PAGE).applyInPandas(fold, schema)


def joined_text(order: str = "place") -> Column:
    """Aggregate: a group's items as text, a space where the gap is wide."""
    items = F.array_sort(F.collect_list(F.struct("x", order, "str", "width")))

    def add(acc: Column, item: Column) -> Column:
        w = item["width"] / F.greatest(F.lit(1), F.length(item["str"]))
        wide = item["x"] - acc["right"] > F.greatest(F.lit(1.0), (acc["w"] + w) * 0.09)
        space = (acc["text"] != "") & ~acc["text"].rlike(r"\s$") & ~item["str"].rlike(r"^\s") & wide
        return F.struct(
            F.concat(acc["text"], F.when(space, " ").otherwise(""), item["str"]).alias("text"),
            (item["x"] + item["width"]).cast("double").alias("right"), w.cast("double").alias("w"),
        )

    start = F.struct(F.lit("").alias("text"), F.lit(0.0).alias("right"), F.lit(0.0).alias("w"))
    return F.trim(F.regexp_replace(F.aggregate(items, start, add, lambda acc: acc["text"]), f"[{X.SPACE}]+", " "))


def pieces(items: DataFrame) -> DataFrame:
    """(page, item_index, str, piece): each item's text led by what parts it from the last one.

    White space that an item brings along parts it from its neighbour; else a new line, or
    a step back, becomes a line feed, and a gap of more than 0.18 of a character a space.
    """
    order = Window.partitionBy(*PAGE).orderBy("item_index")
    last = lambda c: F.lag(c).over(order)
    known = items.select(*PAGE, "item_index", "str", "x", "y", "width", "height", "font_size", *[
        last(c).alias(f"l_{c}") for c in ("str", "x", "y", "width", "height", "font_size")
    ])
    wide = F.greatest(F.lit(1.0), (char_width("l_width", "l_str") + char_width("width", "str")) / 2)
    overlap = F.least(F.col("l_y") + F.col("l_height"), F.col("y") + F.col("height")) - F.greatest("l_y", "y")
    away = F.abs(F.col("l_y") + F.col("l_height") / 2 - F.col("y") - F.col("height") / 2)
    level = (overlap >= F.greatest(F.lit(0.01), F.least("l_height", "height")) * 0.25) | (away <= F.greatest("l_font_size", "font_size") * 0.55)
    parted = (F.col("l_str") == "") | (F.col("str") == "") | F.col("l_str").rlike(r"\s$") | F.col("str").rlike(r"^\s")
    between = (
        F.when(F.col("l_str").isNull() | parted, "")
        .when(~level | (F.col("x") + wide < F.col("l_x")), "\n")
        .when(F.col("x") - (F.col("l_x") + F.col("l_width")) > wide * 0.18, " ")
        .otherwise("")
    )
    return known.select(*PAGE, "item_index", "str", F.concat(between, F.col("str")).alias("piece"))


def stitched(items: DataFrame) -> DataFrame:
    """(page, text): each page's items in the order given, put together as running text."""
    in_order = F.array_sort(F.collect_list(F.struct("item_index", "piece")))
    whole = F.array_join(F.transform(in_order, lambda p: p["piece"]), "")
    return pieces(items).groupBy(*PAGE).agg(whole.alias("text"))


def text_lines(items: DataFrame, page_width: float) -> DataFrame:
    """(page, line, text, identity, canonical, x, y, width, height, n_items): the lines of every page.

    Pages of mostly short items keep each item a line of its own; else rows are cut into
    columns and rotated items stand alone. Lines without a word are left out.
    """
    placed = ordered(items)
    share = F.avg(F.when(F.length(F.trim("str")) <= ATOMIC_CHARS, 1.0).otherwise(0.0)).over(Window.partitionBy(*PAGE))
    placed = placed.withColumn("single", (share >= ATOMIC_SHARE) | F.col("rotated"))
    rows = rows_of(placed.where("not single"))
    grouped = columns_of(rows, [*PAGE, "row"], page_width).withColumn("group", F.concat_ws(":", "row", "col"))
    alone = placed.where("single").withColumn("group", F.concat(F.lit("i"), F.col("item_index")))
    both = grouped.drop("row", "col").unionByName(alone)
    lines = both.groupBy(*PAGE, "group").agg(
        joined_text().alias("text"), F.min("x").alias("x"), F.min("y").alias("y"),
        F.max(F.col("x") + F.col("width")).alias("right"), F.max(F.col("y") + F.col("height")).alias("bottom"),
        F.count("*").alias("n_items"), F.min("place").alias("first_place"),
    )
    named = lines.withColumn("canonical", X.canonical_text(F.col("text"))).where("canonical != ''")
    order = Window.partitionBy(*PAGE).orderBy("y", "x", "first_place")
    return named.select(
        *PAGE, F.row_number().over(order).alias("line"), "text", X.identity_text(F.col("text")).alias("identity"), "canonical",
        "x", "y", (F.col("right") - F.col("x")).alias("width"), (F.col("bottom") - F.col("y")).alias("height"), "n_items",
    )


PAIR = ["pair_id", "idx"]
_FIELDS = ["line", "text", "identity", "canonical", "x", "y", "width", "height"]


def sided(lines: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines of both sides of page pairs (pair_id, idx, earlier_page, newer_page), prefixed a_ and b_."""
    out = []
    for side, page, prefix in (("earlier", "earlier_page", "a"), ("newer", "newer_page", "b")):
        own = lines.where(F.col("side") == side).join(
            pages.select("pair_id", "idx", F.col(page).alias("page_number")), ["pair_id", "page_number"]
        )
        out.append(own.select(*PAIR, *[F.col(f).alias(f"{prefix}_{f}") for f in _FIELDS]))
    return out[0], out[1]


def distance(page_width: float, page_height: float) -> Column:
    """Between line centres, each axis in shares of the page."""
    center = lambda p, at, size: F.col(f"{p}_{at}") + F.col(f"{p}_{size}") / 2
    return F.hypot(
        (center("a", "x", "width") - center("b", "x", "width")) / page_width,
        (center("a", "y", "height") - center("b", "y", "height")) / page_height,
    )


def exact_matches(a: DataFrame, b: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """(pair, a_line, b_line): lines of equal identity, one to one, each earlier line in
    order taking the nearest that is free, the first among equals.

    Both sides' places of an identity become one row, so a line that a page repeats is
    settled within a row and never forms pairs with all its equals.
    """
    fields = ["line", "x", "y", "width", "height"]
    own = lambda df, p: df.groupBy(*PAIR, F.col(f"{p}_identity").alias("identity")).agg(
        F.array_sort(F.collect_list(F.struct(*[F.col(f"{p}_{f}").alias(f) for f in fields]))).alias(p)
    )
    both = own(a, "a").join(own(b, "b"), [*PAIR, "identity"])

    def settle(ours: pd.Series, theirs: pd.Series) -> pd.Series:
        return pd.Series([_nearest(x, y, page_width, page_height) for x, y in zip(ours, theirs)])

    schema = "array<struct<a_line:int,b_line:int>>"
    one = F.array(F.struct(F.get("a", F.lit(0))["line"].alias("a_line"), F.get("b", F.lit(0))["line"].alias("b_line"))).cast(schema)
    alone = (F.size("a") == 1) & (F.size("b") == 1)
    several = both.where(~alone).select(*PAIR, F.explode(F.pandas_udf(settle, schema)("a", "b")).alias("m"))
    return both.where(alone).select(*PAIR, F.explode(one).alias("m")).unionByName(several).select(*PAIR, "m.*")


def _nearest(a: list, b: list, page_width: float, page_height: float) -> list[tuple[int, int]]:
    """Places of one identity on both sides, settled in the order of the earlier lines."""
    centre = lambda p: ((p["x"] + p["width"] / 2) / page_width, (p["y"] + p["height"] / 2) / page_height)
    free = np.array([centre(p) for p in b], np.float64)
    out = []
    for place in a[: len(b)]:
        away = np.hypot(*(free - centre(place)).T)
        at = int(away.argmin())
        free[at] = np.inf
        out.append((place["line"], b[at]["line"]))
    return out


def _numbered(grams: pa.Array) -> pa.Array:
    """Each element of sorted lists with the number of its occurrence: equal ones stand
    together, so the place since the last other one numbers them."""
    at = edits.list_starts(grams)
    row = np.repeat(np.arange(len(grams)), np.diff(at))
    values = grams.flatten()
    fresh = np.ones(len(values), bool)
    if len(values):
        fresh[1:] = pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False).astype(bool) | (row[1:] != row[:-1])
    heads = np.flatnonzero(fresh)
    nth = np.arange(len(values)) - np.repeat(heads, np.diff(np.append(heads, len(values))))
    named = pc.binary_join_element_wise(values, pa.array(nth).cast(pa.string()), ":")
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), named, mask=pc.is_null(grams))


def _bag(grams: Column) -> Column:
    """A list as a set: each element with the number of its occurrence. Takes time in
    proportion to a list's length, however long a line is."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for at in range(0, len(batch), edits.ROWS):
                yield _numbered(batch.slice(at, edits.ROWS))

    return F.arrow_udf("array<string>")(run)(F.array_sort(grams))


def bags(lines: DataFrame, prefix: str) -> DataFrame:
    """lines plus their tokens and trigrams as bags, <prefix>_t and <prefix>_g."""
    canonical = F.col(f"{prefix}_canonical")
    return lines.withColumn(f"{prefix}_t", _bag(X.tokens(canonical))).withColumn(f"{prefix}_g", _bag(X.trigrams(canonical)))


def _prefixes(lines: DataFrame, prefix: str, sort: str, counts: DataFrame, least: float) -> DataFrame:
    """(pair, gram, line, n, at): of each bag, rarest first, what a partner of that Dice
    similarity must share one of."""
    rows = lines.select(*PAIR, f"{prefix}_line", F.size(f"{prefix}_{sort}").alias("n"), F.explode(f"{prefix}_{sort}").alias("gram"))
    order = Window.partitionBy(*PAIR, f"{prefix}_line").orderBy("df", "gram")
    ranked = rows.join(counts, [*PAIR, "gram"]).withColumn("at", F.row_number().over(order))
    share = least / (2 - least)
    return ranked.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1).select(
        *PAIR, "gram", f"{prefix}_line", F.col("n").alias(f"{prefix}_n"), F.col("at").alias(f"{prefix}_at")
    )


def ceilings(a: DataFrame, b: DataFrame, least: float = FLOOR) -> DataFrame:
    """(pair, a_line, b_line, ceiling, gram_dice): an upper bound of the similarity of two
    lines of a page pair, where it is at least `least`: the larger of the token-bag Dice
    and 0.94 times the trigram Dice.

    Lines as similar as that share one of the rarest elements of both bags, so only a
    prefix of each bag is joined; what the lengths or places rule out goes before bags meet.
    """
    a, b = stored(bags(a, "a")), stored(bags(b, "b"))
    found = None
    for sort, floor in (("t", least), ("g", least / 0.94)):
        sides = [x.select(*PAIR, F.explode(f"{p}_{sort}").alias("gram")) for x, p in ((a, "a"), (b, "b"))]
        counts = sides[0].unionByName(sides[1]).groupBy(*PAIR, "gram").agg(F.count("*").alias("df")).where("df > 1")
        met = _prefixes(a, "a", sort, counts, floor).join(_prefixes(b, "b", sort, counts, floor), [*PAIR, "gram"])
        left = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at")) + 1
        enough = 2 * F.least(left, F.col("a_n"), F.col("b_n")) >= (F.col("a_n") + F.col("b_n")) * floor - 1e-9
        pairs = met.where(enough).select(*PAIR, "a_line", "b_line")
        found = pairs if found is None else found.unionByName(pairs)
    bag = lambda df, p: df.select(*PAIR, f"{p}_line", f"{p}_t", f"{p}_g")
    both = found.distinct().join(bag(a, "a"), [*PAIR, "a_line"]).join(bag(b, "b"), [*PAIR, "b_line"])
    dice = lambda s: 2 * F.size(F.array_intersect(f"a_{s}", f"b_{s}")) / (F.size(f"a_{s}") + F.size(f"b_{s}"))
    bounded = both.select(*PAIR, "a_line", "b_line", F.greatest(dice("t"), dice("g") * 0.94).alias("ceiling"), dice("g").alias("gram_dice"))
    return bounded.where(F.col("ceiling") >= least)


def _token_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x, y) -> float:
        made, exact = edits.script(list(x), list(y))
        return 2 * made.count("=") / (len(x) + len(y)) if exact else -1.0

    return pd.Series([one(x, y) for x, y in zip(a, b)])


def candidates(a: DataFrame, b: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """(pair, a_line, b_line, similarity, score): changed lines that may be each other's revision.

    The bound is a filter before the token comparison, so few pairs reach Python.
    """
    words = lambda p: F.size(F.split(F.col(f"{p}_canonical"), " "))
    pairs = ceilings(a, b, min(FLOOR, FLOOR_SHORT)).join(a, [*PAIR, "a_line"]).join(b, [*PAIR, "b_line"])
    floor = F.when(F.least(words("a"), words("b")) <= 2, FLOOR_SHORT).otherwise(FLOOR)
    pairs = pairs.withColumn("floor", floor).where("ceiling >= floor")
    tokens = F.pandas_udf(_token_similarity, "double")(X.tokens(F.col("a_canonical")), X.tokens(F.col("b_canonical")))
    pairs = pairs.withColumn("tokens", tokens)
    pairs = pairs.withColumn("similarity", F.when(F.col("tokens") < 0, 0.0).otherwise(F.greatest("tokens", F.col("gram_dice") * 0.94)))
    aside = F.abs((F.col("a_x") + F.col("a_width") / 2) - (F.col("b_x") + F.col("b_width") / 2)) / page_width
    kept = pairs.where("similarity >= floor").where(~((aside > 0.24) & (F.col("similarity") < 0.9)))
    la, lb = F.length("a_canonical"), F.length("b_canonical")
    score = F.col("similarity") * 0.82 + F.least(la, lb) / F.greatest(la, lb) * 0.18 - distance(page_width, page_height) * 0.3
    return kept.select(*PAIR, "a_line", "b_line", "similarity", score.alias("score"))


def accept(of_candidates: DataFrame) -> DataFrame:
    """(pair, a_line, b_line): best score first, each line once."""
    best = [F.col("score").desc(), "a_line", "b_line"]
    return greedy(of_candidates, [*PAIR, "a_line"], [*PAIR, "b_line"], best).select(*PAIR, "a_line", "b_line")


def match(lines: DataFrame, pages: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """(pair, kind, a_*, b_*): every line of both sides once: same, changed, removed or added.

    What several steps read is written once, which also keeps their plans small.
    """
    a, b = (stored(side) for side in sided(stored(lines), pages))
    same = stored(exact_matches(a, b, page_width, page_height))
    left = stored(a.join(same.select(*PAIR, "a_line"), [*PAIR, "a_line"], "left_anti"))
    right = stored(b.join(same.select(*PAIR, "b_line"), [*PAIR, "b_line"], "left_anti"))
    changed = stored(accept(candidates(left, right, page_width, page_height)))
    pairs = same.withColumn("kind", F.lit("same")).unionByName(changed.withColumn("kind", F.lit("changed")))
    with_a = a.join(pairs.select(*PAIR, "a_line", "b_line", "kind"), [*PAIR, "a_line"], "left")
    with_a = with_a.withColumn("kind", F.coalesce("kind", F.lit("removed"))).join(b, [*PAIR, "b_line"], "left")
    added = b.join(pairs.select(*PAIR, "b_line"), [*PAIR, "b_line"], "left_anti").withColumn("kind", F.lit("added"))
    return with_a.unionByName(added, allowMissingColumns=True)


def changes(matched: DataFrame) -> DataFrame:
    """(pair, id, kind, before, after, a_line, b_line): changes in reading order.

    A changed line with exactly one local change reports only those words.
    """
    y, x = F.coalesce("a_y", "b_y"), F.coalesce("a_x", "b_x")
    order = Window.partitionBy(*PAIR).orderBy(y, x, F.when(F.col("kind") == "changed", 0).when(F.col("kind") == "removed", 1).otherwise(2), "a_line", "b_line")
    rows = matched.where("kind != 'same'").withColumn("seq", F.row_number().over(order))
    pairs = rows.where("kind = 'changed'").select(*PAIR, "seq", F.col("a_text").alias("before"), F.col("b_text").alias("after"))
    keys = [*PAIR, "seq"]
    local = edits.text_changes(edits.segments(edits.token_edits(pairs), keys), keys)
    single = local.groupBy(*keys).agg(F.count("*").alias("n"), F.first("before").alias("one_before"), F.first("after").alias("one_after")).where("n = 1")
    told = rows.join(single, keys, "left")
    return told.select(
        *PAIR, "seq", F.concat(F.lit("semantic-"), F.col("seq")).alias("id"), "kind",
        F.coalesce("one_before", "a_text", F.lit("")).alias("before"), F.coalesce("one_after", "b_text", F.lit("")).alias("after"),
        "a_line", "b_line",
    )


def unchanged(matched: DataFrame, scale_x: float = 1.0, scale_y: float = 1.0) -> DataFrame:
    """(pair, a_line, b_line, text, shifted): lines that stayed, and whether they moved on the page."""
    moved = F.hypot(F.col("b_x") * scale_x - F.col("a_x"), F.col("b_y") * scale_y - F.col("a_y")) > SHIFT_TOLERANCE
    return matched.where("kind = 'same'").select(*PAIR, "a_line", "b_line", F.col("a_text").alias("text"), moved.alias("shifted"))
