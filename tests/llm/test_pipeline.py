"""The corpus pipeline keeps clean documents and acts on the others."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from revdelta.llm import catalog
from revdelta.llm.common import scratch


def prose(seed, n=90):
    rng = random.Random(seed)
    return " ".join(f"word{rng.randrange(5000)}" for _ in range(n)) + "."


def test_stages_act_and_leave_clean_documents(spark, tmp_path):
    shared = prose(50, 60)
    texts = {
        1: prose(1), 2: prose(2) + " write to joe@example.com now", 3: "spam " * 80, 4: prose(1), 5: prose(5) + "\n" + shared,
        6: prose(6) + "\n" + shared, 7: prose(7).upper(),
    }
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept["quality"]) == {1, 2, 4, 5, 6} and set(kept["near_copies"]) == {1, 2, 5, 6}
    assert kept["repeats"][5] == texts[5] and shared not in kept["repeats"][6] and kept["repeats"][1] == texts[1]
    assert "<EMAIL>" in kept["personal_data"][2] and "@" not in kept["personal_data"][2]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == {1, 2, 5, 6}


ODD = "doc_id long, text string, lang string, source string, n_chars long, features long, row string"


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, tmp_path, name):
    """Nulls in every column, empty texts, repeated ids and rows, columns that clash, no rows."""
    stage = dict(corpus_pipeline.STAGES)[name]
    long = " ".join(prose(seed, 200) for seed in range(1000, 1100))
    rows = [
        (1, prose(1), "en", "s", 9, 1, "x"), (1, prose(1), "en", "s", 9, 1, "x"), (1, prose(2), None, None, None, None, None),
        (2, None, None, None, None, None, None), (3, "", "en", "s", 0, 1, "x"), (None, prose(3), "en", "s", 9, 1, "x"), (4, long, "en", "s", 9, 1, "x"),
    ]
    docs = spark.createDataFrame(rows, ODD)
    with scratch(spark):
        found = stage(spark, docs, str(tmp_path)).collect()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    if name == "sequences":
        whole = {(r.doc_id, r.start, r.length, r.doc_tokens) for r in found}
        assert {r.doc_id for r in found} == {1, 2, 3, 4, None} and (2, 0, 1, 1) in whole and (3, 0, 1, 1) in whole
        assert sum(r.length for r in found if r.doc_id == 4) == next(r.doc_tokens for r in found if r.doc_id == 4)
        return
    assert set(found[0].asDict()) == set(corpus_pipeline.COLUMNS)
    told = Counter((r.doc_id, r.text) for r in found)
    own = Counter((r[0], r[1]) for r in rows)
    if name == "quality":
        want = own - Counter({(2, None): 1, (3, ""): 1})
    elif name == "near_copies":
        want = Counter([(1, prose(1)), (1, prose(2)), (2, None), (None, prose(3)), (4, long)])
    else:
        want = own
    assert told == want


def test_repeats_cuts_a_text_once(spark):
    """A function that runs twice in a task needs two workers for each core, which executors keep."""
    rows = [(i, prose(i) + "\n" + prose(50, 60), "en", "s", 9) for i in range(1, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    with scratch(spark):
        found = corpus_pipeline.repeats(spark, docs, "")
        plan = found._jdf.queryExecution().executedPlan().toString()
        left = {r.doc_id: (r.text, r.n_chars) for r in found.collect()}
    assert plan.count("EvalPython") == 1
    assert left == {i: (t, len(t)) for i, t in ((i, rows[0][1] if i == 1 else prose(i)) for i in range(1, 5))}


def test_every_operator_has_its_query():
    assert sorted(int(n.split("_")[0][2:]) for n in catalog.queries()) == list(range(1, 14))
