"""Words, page pairing and alignment, on inputs small enough to work out by hand."""

import pytest
from pyspark.sql import functions as F

from revdelta.functions import text as X
from revdelta.operators import alignment

A = "alpha motor controller startup sequence voltage ramp"
B = "thermal derating curve ambient temperature current limit"
C = "connector pinout signal ground shield assignment table"
D = "revision history document approval engineering change"
NEW = "electromagnetic compatibility filter layout guideline notes"


def pages(spark, earlier, newer, pair="p"):
    rows = [(pair, side, i + 1, t) for side, texts in (("earlier", earlier), ("newer", newer)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "pair_id string, side string, page_number int, text string")


def aligned(spark, earlier, newer, **options):
    found = alignment.align(alignment.fingerprints(pages(spark, earlier, newer)), **options).orderBy("idx").collect()
    return [(r.earlier_page, r.newer_page, r.kind) for r in found]


def test_insertion_and_removal(spark):
    assert aligned(spark, [A, B, C], [A, NEW, B, C]) == [(1, 1, "matched"), (None, 2, "added"), (2, 3, "matched"), (3, 4, "matched")]
    assert aligned(spark, [A, B, C, D], [A, C, D]) == [(1, 1, "matched"), (2, None, "removed"), (3, 2, "matched"), (4, 3, "matched")]


def test_moved_page_is_paired_again(spark):
    found = aligned(spark, [A, B, C, D], [A, C, D, B])
    assert (2, 4, "moved") in found and not {"added", "removed"} & {k for _, _, k in found}
    assert {"added", "removed"} <= {k for _, _, k in aligned(spark, [A, B, C, D], [A, C, D, B], moves=False)}


def test_a_replaced_page_still_pairs(spark):
    assert aligned(spark, [A, B, C], [A, NEW, C])[1] == (2, 2, "matched")


def test_forty_pages_and_one_insertion(spark):
    body = [f"page{i} words{i} only{i} here{i}" for i in range(40)]
    found = alignment.align(alignment.fingerprints(pages(spark, body, [*body[:7], NEW, *body[7:]]))).collect()
    assert sum(r.kind == "matched" and r.similarity == 1.0 for r in found) == 40


def test_empty_sides_and_empty_pages(spark):
    assert aligned(spark, [], [A]) == [(None, 1, "added")]
    assert aligned(spark, [A], []) == [(1, None, "removed")]
    assert aligned(spark, [""], [""]) == [(1, 1, "matched")]


def test_fingerprint_leaders_and_marks(spark):
    row = spark.createDataFrame([("Chapter 3.3.....17 (see) end. it's a/b- ",)], "t string").select(X.fingerprint(F.col("t")).alias("w")).first()
    assert row.w == ["chapter", "3.3", "17", "see", "end", "it's", "a/b"]


@pytest.mark.parametrize(
    ("text", "ratio"), [("", 1.0), ("abc", 1.0), ("\x01\x02", 0.0), ("a\x01", 0.5), (" \t\n ", 1.0), ("\x0b\x0ca", 1.0), ("�ab", 0.5)]
)
def test_decodable_ratio(spark, text, ratio):
    assert spark.createDataFrame([(text,)], "t string").select(X.decodable_ratio(F.col("t"))).first()[0] == ratio


def test_join_tokens(spark):
    frame = spark.createDataFrame([("say (a, b) 50% of \"it\"!",)], "t string")
    assert frame.select(X.join_tokens(X.tokens(F.col("t")))).first()[0] == 'say (a, b) 50% of"it"!'


def test_normal_forms():
    assert X.canonical("24 V – 5 ms, DC") == X.canonical("24V - 5ms DC") == "24v 5ms dc"
    assert X.identity("A B C") == "abc"
    assert X.identity("D+") != X.identity("D-")


def test_prefix_join_finds_what_all_pairs_find(spark):
    texts = [" ".join(f"w{(i * k) % 23}" for k in range(1, 9 + i % 5)) for i in range(30)] + ["", ""]
    prints = alignment.fingerprints(pages(spark, texts[::2], texts[1::2]))
    found = {(r.earlier_page, r.newer_page) for r in alignment.similar_pages(prints, 0.55).collect()}
    bags = [set(t.split()) for t in texts]
    near = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    assert found == {(i // 2 + 1, j // 2 + 1) for i in range(0, 32, 2) for j in range(1, 32, 2) if near(bags[i], bags[j]) >= 0.55}
