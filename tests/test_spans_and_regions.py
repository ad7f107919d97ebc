"""Character spans, quads and merged regions against plain versions."""

import random
import re

import pytest

from revdelta.operators import classify, components, edits, lines, spans

TOKEN = re.compile(r"\w+|[^\s\w]")


def texts(spark, rows):
    return spark.createDataFrame(rows, "k int, text string")


def test_offsets_of_odd_texts(spark):
    rows = [(0, ""), (1, " \t\n"), (2, "a"), (3, "  Größe, 24 V\n\n(x_1)😀!  "), (4, "a" * 4000 + " " + "b," * 500), (5, None)]
    got = {}
    for r in spans.token_offsets(texts(spark, rows), ["k"]).orderBy("k", "at").collect():
        got.setdefault(r.k, []).append((r.token, r.start, r.end))
    for k, t in rows:
        assert got.get(k, []) == [(m[0], m.start(), m.end()) for m in TOKEN.finditer(t or "")]


def test_ranges_cut_the_changed_text_out(spark):
    rng, before, after = random.Random(2), [], []
    for k in range(20):
        words = [rng.choice(["a", "bb", "ccc", ",", "("]) for _ in range(rng.randrange(15))]
        other = [w for w in words if rng.random() > 0.3]
        for _ in range(rng.randrange(3)):
            other.insert(rng.randrange(len(other) + 1), "new")
        before.append((k, "  ".join(words)))
        after.append((k, " ".join(other) + " "))
    a, b = texts(spark, before), texts(spark, after)
    pairs = a.withColumnRenamed("text", "before").join(b.withColumnRenamed("text", "after"), "k")
    cut = edits.segments(edits.token_edits(pairs), ["k"])
    told = {(r.k, r.segment): r for r in spans.change_ranges(cut, a, b, ["k"]).collect()}
    assert set(told) == {(r.k, r.segment) for r in cut.collect() if r.kind != "same"} and told
    for r in cut.where("kind != 'same'").collect():
        t = told[r.k, r.segment]
        for text, tokens, start, end in ((dict(before)[r.k], r.before_tokens, t.before_start, t.before_end), (dict(after)[r.k], r.after_tokens, t.after_start, t.after_end)):
            assert TOKEN.findall(text[start:end]) == tokens and (tokens or start == end == len(text))


ITEM = "pair_id string, side string, page_number int, item_index int, str string, x double, y double, width double, height double, font_size double, rotated boolean"


def test_quads_of_parts_of_items(spark):
    rows = [("one two", 0.0, 0.0, 70.0, False), ("three", 80.0, 0.0, 50.0, False), ("", 0.0, 0.0, 0.0, False), ("down", 10.0, 20.0, 10.0, True)]
    items = spark.createDataFrame([("p", "a", 1, i, s, x, y, w, 40.0 if r else 10.0, 10.0, r) for i, (s, x, y, w, r) in enumerate(rows)], ITEM)
    assert lines.stitched(items).first().text == "one two threedown"
    assert [(r.str, r.start, r.end) for r in spans.item_spans(items).orderBy("item_index").collect()] == [("one two", 0, 7), ("three", 8, 13), ("", 13, 13), ("down", 13, 17)]
    ranges = spark.createDataFrame([("p", "a", 1, 4, 10), ("p", "a", 1, 15, 17), ("p", "a", 1, 3, 3), ("p", "b", 1, 0, 9)], "pair_id string, side string, page_number int, start long, end long")
    found = {(r.start, r.item_index): [(p.x, p.y) for p in r.quad] for r in spans.highlights(ranges, items).collect()}
    assert set(found) == {(4, 0), (4, 1), (15, 3)}
    assert found[4, 0] == [(40.0, 0.0), (70.0, 0.0), (70.0, 10.0), (40.0, 10.0)]
    assert found[4, 1] == [(80.0, 0.0), (100.0, 0.0), (100.0, 10.0), (80.0, 10.0)]
    assert found[15, 3] == [(20.0, 40.0), (20.0, 60.0), (10.0, 60.0), (10.0, 40.0)]


def test_ranges_over_many_strips_meet_once(spark):
    rng = random.Random(4)
    spot = lambda: sorted((rng.randrange(900), rng.randrange(900)))
    ranges, items = [(1, i, *spot()) for i in range(40)], [(1, i, *spot()) for i in range(40)]
    met = spans.covered(spark.createDataFrame(ranges, "k int, i int, start long, end long"), spark.createDataFrame(items, "k int, j int, start long, end long"), ["k"])
    want = {(i, j): ((max(s, t) - t) / (f - t), (min(e, f) - t) / (f - t)) for _, i, s, e in ranges for _, j, t, f in items if max(s, t) < min(e, f)}
    rows = met.collect()
    assert {(r.i, r.j): (r.covered_from, r.covered_to) for r in rows} == want and len(rows) == len(want)


BOX = "pair_id string, idx int, id int, x int, y int, width int, height int, pixel_count long"


def plain_merge(boxes, gap_x, gap_y):
    near = lambda a, b: max(a[1] - b[1] - b[3], b[1] - a[1] - a[3]) <= gap_x and max(a[2] - b[2] - b[4], b[2] - a[2] - a[4]) <= gap_y
    group = {b[0]: b[0] for b in boxes}
    for _ in boxes:
        for a in boxes:
            for b in boxes:
                if near(a, b):
                    group[a[0]] = group[b[0]] = min(group[a[0]], group[b[0]])
    out = []
    for g in set(group.values()):
        own = [b for b in boxes if group[b[0]] == g]
        x, y = min(b[1] for b in own), min(b[2] for b in own)
        out.append((g, x, y, max(b[1] + b[3] for b in own) - x, max(b[2] + b[4] for b in own) - y, sum(b[5] for b in own)))
    return sorted(out)


@pytest.mark.parametrize("grow", [False, True])
def test_near_regions_merge(spark, grow):
    rng = random.Random(6)
    pages = {i: [(k + 1, rng.randrange(400), rng.randrange(400), rng.randrange(1, 40), rng.randrange(1, 40), 1 + k) for k in range(n)] for i, n in enumerate([0, 1, 25, 45])}
    pages[9] = [(k + 1, 10 * k, 0, 8, 5, 1) for k in range(40)]  # a chain
    frame = spark.createDataFrame([("p", i, *b) for i, bs in pages.items() for b in bs], BOX)
    got = {}
    for r in classify.merge_nearby(frame, 6, 4, grow).collect():
        got.setdefault(r.idx, []).append(tuple(r)[2:])
    for i, boxes in pages.items():
        want, last = plain_merge(boxes, 6, 4), None
        while grow and want != last:
            last, want = want, plain_merge(want, 6, 4)
        assert sorted(got.get(i, [])) == want
    assert sorted(map(tuple, classify.merge_nearby(frame, 0, 0).collect())) == sorted(map(tuple, frame.collect()))


def test_components_by_key(spark):
    edges = [("a", 1, 2), ("a", 3, 2), ("b", 2, 9), ("b", 4, 4), ("a", 7, 8), ("a", None, 1)] + [("c", i, i + 1) for i in range(50)]
    found = components.components(spark.createDataFrame(edges, "k string, u long, v long"), ["k"]).collect()
    want = {("a", 1): 1, ("a", 2): 1, ("a", 3): 1, ("b", 2): 2, ("b", 9): 2, ("a", 7): 7, ("a", 8): 7} | {("c", i): 0 for i in range(51)}
    assert {(r.k, r.node): r.component for r in found} == want
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("few", [0, components.FEW])
def test_components_of_structs_by_rounds_and_by_one_task(spark, monkeypatch, few):
    """Long chains, hubs, loops and repeats of keys; both ways agree."""
    rng = random.Random(7)
    edges = [(k, rng.randrange(90), rng.randrange(90)) for k in ("a", None) for _ in range(40)] + [("z", i, i + 1) for i in range(100, 130)] * 2
    node = "named_struct('doc', cast({0} div 10 as bigint), 'at', if({0} % 10 = 9, null, cast({0} % 10 as int)))"
    frame = spark.createDataFrame(edges, "k string, u int, v int").selectExpr("coalesce(k, 'none') as k", f"{node.format('u')} as u", f"{node.format('v')} as v")
    monkeypatch.setattr(components, "FEW", few)
    found = {(r.k, *r.node): (r.k, *r.component) for r in components.components(frame, ["k"]).collect()}
    order = lambda n: tuple((x is not None, x) for x in n)
    want = {}
    for k, u, v in ((k or "none", *((x // 10, None if x % 10 == 9 else x % 10) for x in e)) for k, *e in edges):
        if u != v:
            one, two = (want.setdefault((k, *n), {(k, *n)}) for n in (u, v))
            for n in two if one is not two else ():
                want[n] = one
            one |= two
    assert found == {n: min(group, key=order) for n, group in want.items()}


def test_few_edges_take_few_tasks(spark):
    """A chain's rounds are not worth their joins where it is short."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long").repartition(3)
    context = spark.sparkContext
    context.setJobGroup("few", "components")
    assert components.components(edges).where("component = 0").count() == 301
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("few") for s in tracker.getJobInfo(j).stageIds]
    context.setLocalProperty("spark.jobGroup.id", None)
    assert sum(s.numTasks for s in stages if s is not None) < 60
