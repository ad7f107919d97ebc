"""Percentiles, metrics, tables in versions and results by content."""

import math
import random

import pytest
from pyspark.sql import functions as F

from revdelta.operators import instruments
from revdelta.operators.ordering import numbered
from revdelta.operators.results import ResultCache
from revdelta.operators.selection import nearest_ranks
from revdelta.sources.scratch import stored
from revdelta.sources.versions import VersionedTable


def test_ranks_equal_a_sort(spark):
    rng = random.Random(3)
    groups = {
        "ties": [float(rng.randrange(3)) for _ in range(400)], "one": [7.5], "same": [2.0] * 300, None: [rng.random() for _ in range(50)],
        "wide": [rng.choice([-1.7e308, 1.7e308, 0.0, 5e-324, 1e-9 * rng.random()]) for _ in range(300)], "spread": [rng.gauss(0, 1) * 10 ** rng.randrange(9) for _ in range(500)],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("one", None), ("void", None)]
    shares = [0.0, 0.01, 0.5, 0.95, 1.0]
    frame = spark.createDataFrame(rows, "k string, v double")
    got = {(r.k, r.share): (r.n, r.value) for r in nearest_ranks(frame, ["k"], "v", shares, whole=5).collect()}
    want = {(k, s): (len(vs), sorted(vs)[max(1, math.ceil(len(vs) * s)) - 1]) for k, vs in groups.items() for s in shares}
    assert got == want


def test_metrics_of_stages(spark):
    sink = instruments.Sink()
    out = sink.measure("numbers", lambda: spark.range(10), {"even": F.count_if(F.col("id") % 2 == 0)}, kind="x")
    assert out.count() == 10
    with pytest.raises(ZeroDivisionError):
        sink.measure("broken", lambda: 1 / 0)
    rows = sink.table(spark).collect()
    assert [(r.name, r.status, r.rows, r.attributes) for r in rows] == [("numbers", "ok", 10, '{"even": 5, "kind": "x"}'), ("broken", "error", None, "{}")]
    assert all(r.duration_ms > 0 for r in rows)
    told = instruments.summary(spark.createDataFrame([("a", float(i)) for i in range(1, 21)] + [("b", 3.0)], "name string, duration_ms double"))
    assert {tuple(r) for r in told.collect()} == {("a", 20, 20.0, 10.0, 19.0), ("b", 1, 3.0, 3.0, 3.0)}


def test_versions(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "kept"), "id int, name string", ["id"])
    assert table.read().count() == 0 and table.versions() == []
    write = lambda *rows: table.upsert(spark.createDataFrame(rows, "id int, name string"))
    write((1, "a"), (2, "b"))
    before = table.read()
    write((2, "c"), (3, "d"))
    assert sorted(map(tuple, table.read().collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, before.collect())) == [(1, "a"), (2, "b")]  # a reader keeps its version
    assert [r.name for r in table.get(id=2).collect()] == ["c"] and table.get(id=9).count() == 0
    (tmp_path / "kept" / "version-7").mkdir()  # a write that never committed
    table.delete(F.col("name") == "a")
    assert sorted(r.id for r in table.read().collect()) == [2, 3] and table.versions() == [1, 2]
    table.delete()
    assert table.read().count() == 0


def test_a_log_is_what_its_entries_are_one_by_one(spark, tmp_path):
    rng = random.Random(1)
    log = [(rng.randrange(20), i, rng.random() < 0.3) for i in range(200)]
    table, state = VersionedTable(spark, str(tmp_path / "log"), "id int, at int", ["id"]), {}
    for part in (log[:90], log[90:91], log[91:]):
        table.apply(spark.createDataFrame(part, "id int, at int, gone boolean"), "at", F.col("gone"))
    for key, at, gone in log:
        state.pop(key, None)
        if not gone:
            state[key] = at
    assert {r.id: r.at for r in table.read().collect()} == state


def test_only_new_content_is_computed(spark, tmp_path):
    cache = ResultCache(spark, str(tmp_path / "results"), "n int")
    compute = lambda misses: misses.select("content_key", F.length(F.coalesce("before", F.lit(""))).alias("n"))
    pairs = lambda *rows: spark.createDataFrame(rows, "pair_id string, before string, after string")
    first = pairs(("p", "a", "b"), ("q", "a", "b"), ("r", None, "b"), ("s", "", "b"), ("t", "aa", None))
    found, n = cache.results(first, compute, {"threshold": 1})
    assert n == 4 and {(r.pair_id, r.n) for r in found.collect()} == {("p", 1), ("q", 1), ("r", 0), ("s", 0), ("t", 2)}
    again, n = cache.results(first.unionByName(pairs(("u", "new", "b"))), compute, {"threshold": 1})
    assert n == 1 and again.count() == 6 and again.where("n is null").isEmpty()
    assert cache.results(first, compute, {"threshold": 1})[1] == 0
    assert cache.results(first, compute, {"threshold": 2})[1] == 4  # other settings are other results


def test_numbers_over_ranges(spark):
    rows = [(i % 7, i) for i in range(300)] + [(None, -1)]
    frame = stored(spark.createDataFrame(rows, "k int, v int"))
    found = numbered(frame, [F.col("k").asc_nulls_first(), F.col("v").desc()], "n", parts=6).orderBy("n").collect()
    assert [(r.k, r.v) for r in found] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, -r[1]))
    assert [r.n for r in found] == list(range(301)) and len({r.part for r in found}) > 1
