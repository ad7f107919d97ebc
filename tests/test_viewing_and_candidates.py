"""Labels of regions, viewer state, line candidates and whole comparisons."""

import itertools
import random
from collections import Counter

import numpy as np

from revdelta.functions import text as X
from revdelta.functions import viewing as V
from revdelta.operators import compare, labels, lines
from pyspark.sql import functions as F

BOX = "pair_id string, idx int, place int, id string, x double, y double, width double, height double, change_class string"
OVER = "pair_id string, idx int, place int, kind string, text string, x double, y double, width double, height double"


def test_regions_of_one_change_are_one_row(spark):
    regions = spark.createDataFrame(
        [("p", 1, 1, "a", 0.0, 0.0, 10.0, 2.0, "content"), ("p", 1, 2, "b", 0.0, 4.0, 30.0, 2.0, "content"),
         ("p", 1, 3, "c", 80.0, 80.0, 5.0, 5.0, "graphic"), ("p", 1, 4, "d", 50.0, 50.0, 1.0, 1.0, "graphic")], BOX,
    )
    overlays = spark.createDataFrame(
        [("p", 1, 1, "removed", "two \n lines " * 12, 0.0, 0.0, 40.0, 6.0), ("p", 1, 2, "added", " ", 50.0, 50.0, 1.0, 1.0)], OVER
    )
    rows = [(r.id, r.kind, r.label[:14], r.width, r.height) for r in labels.describe(regions, overlays).orderBy("place").collect()]
    assert rows == [("a", "removed", "Removed “two l", 30.0, 6.0), ("c", "changed", "Changed area 1", 5.0, 5.0), ("d", "changed", "Changed area 2", 1.0, 1.0)]
    assert labels.describe(regions, overlays.limit(0)).where("label like 'Changed area %'").count() == 4


def test_listed_changes_and_selection(spark):
    texts = spark.createDataFrame([("p", 1, "t1", "added"), ("p", 1, "t2", "removed"), ("p", 2, "t3", "added")], "pair_id string, idx int, id string, kind string")
    areas = spark.createDataFrame([("p", 1, "r1", "changed"), ("p", 2, "r2", "changed")], "pair_id string, idx int, id string, kind string")
    modes = spark.createDataFrame([("p", 1, "semantic-text", "added"), ("p", 2, "overlay", "added")], "pair_id string, idx int, mode string, text_filter string")
    listed = labels.page_changes(texts, areas, modes)
    assert sorted(r.id for r in listed.collect()) == ["r2", "t1"]
    chosen = spark.createDataFrame([("p", 1, "t2"), ("p", 2, "r2"), ("p", 1, None)], "pair_id string, idx int, selected string")
    assert Counter(r.selected for r in labels.still_selected(chosen, listed).collect()) == {None: 2, "r2": 1}


def test_settings_never_fail(spark):
    texts = [None, "", "null", "{", "[]", '{"unchangedOpacity": true}', '{"addedColor": [1, 2, 3.5], "unchangedOpacity": 0}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", V.overlay_settings(F.col("t")).alias("s"))
    found = {r.i: r.s for r in rows.collect()}
    assert all(found[i].opacity == V.OPACITY and found[i].added_color == list(V.ADDED) for i in range(6))
    assert found[6].added_color == [1.0, 2.0, 3.5] and found[6].opacity == 0.0 and found[6].removed_color == list(V.REMOVED)


LINE = "pair_id string, idx int, {0}_line int, {0}_text string, {0}_identity string, {0}_canonical string, {0}_x double, {0}_y double, {0}_width double, {0}_height double"


def side(spark, prefix, texts):
    rows = [("p", 1, i + 1, t, t, t, 10.0, 20.0 * i, 6.0 * len(t), 10.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, LINE.format(prefix))


def test_candidates_equal_all_pairs(spark):
    rng = random.Random(5)
    words = "alpha beta gamma delta rate of flow in the pump valve 12v 230v aa aa".split()
    make = lambda n: [" ".join(rng.choices(words, k=rng.randrange(1, 8))) for _ in range(n)]
    ours, theirs = make(25), make(25)

    def dice(a, b):
        both = sum((Counter(a) & Counter(b)).values())
        return 2 * both / (len(a) + len(b))

    grams = lambda t: [t[i : i + 3] for i in range(len(t) - 2)] if len(t) > 2 else list(t)
    bound = lambda a, b: max(dice(a.split(), b.split()), 0.94 * dice(grams(a), grams(b)))
    want = {(i + 1, j + 1): bound(a, b) for (i, a), (j, b) in itertools.product(enumerate(ours), enumerate(theirs)) if bound(a, b) >= lines.FLOOR}
    found = {(r.a_line, r.b_line): r.ceiling for r in lines.ceilings(side(spark, "a", ours), side(spark, "b", theirs)).collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_repeated_lines_take_the_nearest_free(spark):
    ours, theirs = ["x", "y", "x", "z", "x"], ["x", "x", "q", "z", "x", "x"]
    found = lines.exact_matches(side(spark, "a", ours), side(spark, "b", theirs), 600.0, 800.0).collect()
    assert sorted((r.a_line, r.b_line) for r in found) == [(1, 1), (3, 2), (4, 4), (5, 5)]


def test_whole_comparison_with_blank_pages_and_classes(spark):
    pages = spark.createDataFrame(
        [("d", "earlier", 1, "the same words on this page stay"), ("d", "newer", 1, "the same words on this page stay"), ("d", "newer", 2, "a page that is quite new here")],
        "pair_id string, side string, page_number int, text string",
    )
    white = np.full((12, 12, 4), 255, np.uint8)
    inked = white.copy()
    inked[2:8, 2:8, :3] = 0
    rows = [("d", 1, 12, 12, bytearray(white.tobytes()), bytearray(inked.tobytes())), ("d", 2, 12, 12, bytearray(white.tobytes()), bytearray(inked.tobytes()))]
    pairs = spark.createDataFrame(rows, "pair_id string, idx int, width int, height int, earlier binary, newer binary")
    boxes = spark.createDataFrame([("d", 2, "changed", 0.0, 0.0, 12.0, 12.0)], "pair_id string, idx int, role string, x double, y double, width double, height double")
    text_rows = compare.compare_text(pages)
    found = {r.idx: r for r in compare.compare_pairs(text_rows, pairs, boxes, align=False).collect()}
    assert found[1].status == "changed" and found[1].graphic == 1 and found[1].changed_pixels == 36 and found[1].noticeable
    assert found[2].status == "added" and found[2].content == 1 and found[2].graphic == 0
    alone = {r.idx: r for r in compare.compare_pairs(text_rows, pairs.where("idx = 2"), boxes, align=False).collect()}
    assert alone[1].status == "same" and alone[1].changed_pixels is None


def test_text_tokens_are_stitched_by_place(spark):
    items = spark.createDataFrame(
        [("p", "a", 1, i, s, x, y, w, 10.0, 10.0) for i, (s, x, y, w) in enumerate(
            [("one", 0.0, 0.0, 18.0), ("two", 24.0, 0.0, 18.0), ("three", 42.0, 1.0, 30.0), (" four", 80.0, 0.0, 30.0), ("five", 0.0, 14.0, 24.0), ("back", 0.0, 14.0, 24.0)]
        )],
        "pair_id string, side string, page_number int, item_index int, str string, x double, y double, width double, height double, font_size double",
    )
    assert lines.stitched(items).first().text == "one twothree four\nfiveback"
    assert X.CLOSING.startswith("]")
