"""Word differences and lines."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from revdelta.operators import edits, lines

KEYS = ["pair_id", "idx"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14))
def test_script_rebuilds_both_sides_and_keeps_a_longest_common_part(a, b):
    made, exact = edits.script(a, b)
    assert exact and made.count("=") == lcs(a, b)
    i = j = 0
    for e in made:
        if e == "=":
            assert a[i] == b[j]
        i, j = i + (e != "+"), j + (e != "-")
    assert (i, j) == (len(a), len(b))


def changes(spark, before, after):
    pairs = spark.createDataFrame([("p", 1, before, after)], "pair_id string, idx int, before string, after string")
    found = edits.text_changes(edits.segments(edits.token_edits(pairs), KEYS), KEYS).orderBy("id").collect()
    return [(r.id, r.kind, r.before, r.after) for r in found]


def test_one_word(spark):
    assert changes(spark, "limit is 30 mA", "limit is 45 mA") == [("semantic-2", "changed", "30", "45")]
    assert changes(spark, "same", "same") == [] and changes(spark, "", "") == []
    assert changes(spark, "", "new words") == [("semantic-1", "added", "", "new words")]


def test_unrelated_texts_give_up_and_split(spark):
    found = changes(spark, " ".join(f"a{i}" for i in range(600)), " ".join(f"b{i}" for i in range(600)))
    assert [k for _, k, _, _ in found] == ["removed", "added"]


ITEM = "pair_id string, side string, page_number int, item_index int, str string, x double, y double, width double, height double, font_size double, rotated boolean"


def items(side, texts):
    return [("p", side, 1, i, t, x, y, 5.0 * len(t), 10.0, 10.0, False) for i, (t, x, y) in enumerate(texts)]


def test_lines_rows_columns_and_changes(spark):
    left = [("The supply voltage is limited to", 0.0, 0.0), ("30 volts in operation", 170.0, 0.0), ("A second column entry here", 400.0, 0.0), ("unchanged closing sentence of it", 0.0, 30.0)]
    right = [("The supply voltage is limited to", 0.0, 0.0), ("45 volts in operation", 170.0, 0.0), ("A second column entry here", 400.0, 0.0), ("unchanged closing sentence of it", 0.0, 40.0)]
    frame = spark.createDataFrame([*items("earlier", left), *items("newer", right)], ITEM)
    found = lines.text_lines(frame, 600.0)
    texts = [r.text for r in found.where("side = 'earlier'").orderBy("line").collect()]
    assert texts == ["The supply voltage is limited to 30 volts in operation", "A second column entry here", "unchanged closing sentence of it"]
    pages = spark.createDataFrame([("p", 1, 1, 1)], "pair_id string, idx int, earlier_page int, newer_page int")
    matched = lines.match(found, pages, 600.0, 800.0)
    assert [(r.kind, r.before, r.after) for r in lines.changes(matched).collect()] == [("changed", "30", "45")]
    assert sorted((r.text, r.shifted) for r in lines.unchanged(matched).collect()) == [("A second column entry here", False), ("unchanged closing sentence of it", True)]


def test_short_items_stay_lines_of_their_own(spark):
    frame = spark.createDataFrame(items("earlier", [("R1", 0.0, 0.0), ("10k", 12.0, 0.0), ("C2", 0.0, 20.0)]), ITEM)
    assert lines.text_lines(frame, 600.0).count() == 3


def test_equal_lines_pair_with_the_nearest(spark):
    frame = spark.createDataFrame(
        [*items("earlier", [("repeated line of some words", 0.0, 10.0), ("repeated line of some words", 0.0, 300.0)]),
         *items("newer", [("repeated line of some words", 0.0, 300.0), ("repeated line of some words", 0.0, 12.0)])], ITEM)
    pages = spark.createDataFrame([("p", 1, 1, 1)], "pair_id string, idx int, earlier_page int, newer_page int")
    matched = lines.match(lines.text_lines(frame, 600.0), pages, 600.0, 800.0).where("kind = 'same'").collect()
    assert sorted((r.a_y, r.b_y) for r in matched) == [(10.0, 12.0), (300.0, 300.0)]


def test_diagonals_followed_together_give_the_same_script(monkeypatch):
    rng = random.Random(4)
    for case in range(250):
        a = [rng.choice("abcdefgh"[: 1 + case % 8]) for _ in range(rng.randrange(90))]
        b = [t for t in a if rng.random() > 0.2] if case % 3 else [rng.choice("abcxyz") for _ in range(rng.randrange(90))]
        b[len(b) // 2 : len(b) // 2] = [rng.choice("abcdefgh") for _ in range(rng.randrange(9))]
        for least, most, each in ((250_000, 4_000_000, 240), (rng.randrange(1, 900), 1, 0)):
            monkeypatch.setattr(edits, "LEAST_WORK", least)
            monkeypatch.setattr(edits, "MOST_WORK", most)
            monkeypatch.setattr(edits, "WORK_PER_TOKEN", each)
            found = []
            for wide, few in ((10**9, 8), (1, 0), (1, 3), (20, 8)):
                monkeypatch.setattr(edits, "WIDE", wide)
                monkeypatch.setattr(edits, "FEW", few)
                found.append(edits.shortest_script(a, b))
            assert found[1:] == found[:1] * 3
            if found[0] is not None:
                assert all(a[i] == b[j] for i, j in found[0]) and found[0] == sorted(set(found[0]))
