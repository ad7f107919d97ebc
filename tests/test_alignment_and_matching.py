"""Alignment in squares and matching in rounds against loops over whole documents."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from revdelta.operators import alignment, matching


def pages(spark, earlier, newer, pair="p"):
    rows = [(pair, side, i + 1, t) for side, texts in (("earlier", earlier), ("newer", newer)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "pair_id string, side string, page_number int, text string")


def whole_path(ours, theirs, match=0.55, band=12, gap=-0.3):
    """The best path over all cells of one document's band, cell by cell."""
    n, m = len(ours), len(theirs)
    drift, width = n / max(m, 1), max(band, abs(n - m) + 1)
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    score, came = {}, {}
    at = lambda r, c: score.get((r, c), -np.inf) if r and c else (r + c) * gap
    for r in range(1, n + 1):
        for c in range(1, m + 1):
            if abs(r - c * drift) <= width:
                s = like(ours[r - 1], theirs[c - 1])
                ways = (at(r - 1, c - 1) + s - match, at(r - 1, c) + gap, at(r, c - 1) + gap)
                came[r, c] = (max(range(3), key=lambda i: (ways[i], -i)), s)
                score[r, c] = max(ways)
    out, r, c = [], n, m
    while r or c:
        way, s = came.get((r, c), (1 if r else 2, 0.0))
        out.append([(r, c, "matched", s), (r, None, "removed", 0.0), (None, c, "added", 0.0)][way])
        r, c = r - (way != 2), c - (way != 1)
    return out[::-1]


def document(rng, n, m, words):
    make = lambda: " ".join(f"w{rng.randrange(words)}" for _ in range(rng.randrange(5)))
    ours = [make() for _ in range(n)]
    theirs = [rng.choice([t, t, t + " w1", make()]) for t in ours if rng.random() > 0.2]
    while len(theirs) < m:
        theirs.insert(rng.randrange(len(theirs) + 1), make())
    return ours, theirs[:m]


@pytest.mark.parametrize("tile", [1, 7, 1000])
def test_squares_find_the_path_of_the_whole_band(spark, tile):
    rng, docs, frame = random.Random(tile), {}, None
    sizes = [(1, 1), (3, 2), (2, 4)] if tile == 1 else [(0, 5), (5, 0), (1, 30), (30, 1), (14, 14), (15, 13), (40, 38), (22, 45), (45, 20), (50, 50), (7, 8)]
    for i, (n, m) in enumerate(sizes):
        docs[f"d{i}"] = document(rng, n, m, rng.choice([3, 8, 200]))
        one = pages(spark, *docs[f"d{i}"], pair=f"d{i}")
        frame = one if frame is None else frame.unionByName(one)
    found = {}
    for r in alignment.paths(alignment.fingerprints(frame), tile=tile).orderBy("step").collect():
        found.setdefault(r.pair_id, []).append((r.earlier, r.newer, r.kind, r.similarity))
    for name, (ours, theirs) in docs.items():
        assert found[name] == whole_path([set(t.split()) for t in ours], [set(t.split()) for t in theirs]), name


def test_a_long_document_in_small_groups(spark):
    n = 1500
    ours = [f"a{i} b{i} c{i}" for i in range(n)]
    theirs = [f"{t} more" if i % 11 == 5 else t for i, t in enumerate(ours) if i % 97 != 3]
    for i in range(40):
        theirs.insert(i * 31, f"new{i}")
    found = alignment.align(alignment.fingerprints(pages(spark, ours, theirs)), tile=250)
    kinds = dict(found.groupBy("kind").count().collect())
    assert kinds["matched"] + kinds["removed"] == n and kinds["matched"] + kinds["added"] == len(theirs)
    assert found.where("kind = 'matched' and similarity = 1").count() > 1300


def greedy_loop(edges, key):
    left, right, kept = set(), set(), []
    for e in sorted(edges, key=key):
        if e[1] not in left and e[2] not in right:
            left.add(e[1])
            right.add(e[2])
            kept.append(e)
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_rounds_keep_what_a_loop_keeps(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(g, rng.randrange(12), rng.randrange(12)) for g in range(4) for _ in range(60)})
    edges = [(*e, float(rng.randrange(3))) for e in edges]  # many ties
    edges += [(9, i, i + d, 1.0) for i in range(9) for d in (0, 1)]  # a chain: each waits for the one before
    frame = spark.createDataFrame(edges, "g int, a int, b int, s double")
    got = matching.greedy(frame, ["g", "a"], ["g", "b"], [F.col("s").desc(), "a", "b"], rounds=4).collect()
    want = [e for g in {e[0] for e in edges} for e in greedy_loop([e for e in edges if e[0] == g], lambda e: (-e[3], e[1], e[2]))]
    assert sorted(map(tuple, got)) == sorted(want)


def test_no_edges_and_open_ends(spark):
    frame = spark.createDataFrame([(None, 1, 0.5), (1, None, 0.5)], "a int, b int, s double")
    assert matching.greedy(frame, ["a"], ["b"], ["s"]).collect() == []
