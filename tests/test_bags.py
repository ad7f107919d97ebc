"""Bags of tokens and trigrams in time linear in a line."""

import random
import time
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from revdelta.operators import lines


def plain(grams):
    seen, out = Counter(), []
    for g in grams:
        out.append(f"{g}:{seen[g]}")
        seen[g] += 1
    return out


def test_bags_equal_plain_ones(spark):
    draw = random.Random(2)
    rows = [[], ["a"], *(sorted(draw.choice("abcé😀") for _ in range(draw.randrange(30))) for _ in range(50)), None]
    kind = pa.list_(pa.string())
    assert lines._numbered(pa.array(rows, kind)).to_pylist() == [r if r is None else plain(r) for r in rows]
    assert lines._numbered(pa.array(rows, kind).slice(3, 9)).to_pylist() == [plain(r) for r in rows[3:12]]
    long = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(120_000)), lambda i: (i % 7).cast("string")).alias("g"))
    began = time.time()
    bag = long.select(lines._bag(F.col("g")).alias("b")).first().b
    assert bag == plain(sorted(str(i % 7) for i in range(1, 120_001))) and time.time() - began < 30
