"""Pages of either side that arrive alone, late, twice and in any order."""

import random
import time

import pytest

from revdelta.streaming import sides


@pytest.mark.parametrize("seed", [1])
def test_replay_in_any_order_equals_the_batch(spark, tmp_path, seed):
    for key, value in sides.STORE.items():
        spark.conf.set(key, value)
    rng = random.Random(seed)
    pages = [("p", i, "earlier", f"alpha beta w{i}") for i in range(8)] + [("p", i, "newer", f"alpha beta w{i - i % 3}") for i in range(2, 11)]
    pages += [("q", 0, "newer", None), ("q", 1, "earlier", ""), ("p", 3, "earlier", "alpha beta w3"), (None, 1, "newer", "x"), ("p", None, "newer", "x")]
    rng.shuffle(pages)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    write = lambda rows: spark.createDataFrame(rows, sides.SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    want = sides.batch(spark.createDataFrame(pages, sides.SCHEMA))
    expected = sorted(map(tuple, want.collect()))
    write(pages[::2])
    query = sides.deliver(sides.source(spark, folder), out, str(tmp_path / "state"), wait_ms=200)
    try:
        got, end, second = None, time.time() + 120, False
        while got != expected and time.time() < end and query.isActive:
            time.sleep(1)
            if query.lastProgress and not second:  # single sides of the first half are told of before or after this
                write(pages[1::2])
                second = True
            done = second and query.lastProgress["batchId"] > 1
            got = sorted(map(tuple, sides.latest(spark.read.parquet(out)).collect())) if done else None
        assert got == expected, query.exception()
    finally:
        query.stop()
    told = spark.read.parquet(out)
    assert {r.status for r in want.collect()} == {"same", "changed", "added", "removed"}
    assert told.groupBy("pair_id", "idx", "revision").count().where("count > 1").isEmpty()
