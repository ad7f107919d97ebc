"""Connected components of a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revdelta.sources.scratch import stored

#: Edges that one task settles: rounds of joins over so few cost the driver more than they share out.
FEW = 1 << 15


def _digest(edges: DataFrame, keys: list[str]):
    return edges.agg(F.count("*"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first()


def _order(node):
    """A node as a value that hashes, and sorts as Spark does: structs field by field, nulls first."""
    return tuple((x is not None, x) for x in node.values()) if isinstance(node, dict) else node


def _united(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, component) by one task that unites the nodes of edges: for FEW at most."""
    names = [*keys, "node", "component"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches)
        n = rows.num_rows
        nodes = pa.chunked_array([*rows["u"].chunks, *rows["v"].chunks]).combine_chunks()
        named = list(zip(*(rows[k].to_pylist() for k in keys))) if keys else [()] * n
        who = list(zip(named + named, map(_order, nodes.to_pylist())))
        place = {w: i for i, w in enumerate(who)}
        up = {w: w for w in place}

        def root(w):
            while up[w] != w:
                up[w] = w = up[up[w]]
            return w

        for a, b in zip(who[:n], who[n:]):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
        own = pa.array(place.values(), pa.int64())
        least = pa.array([place[root(w)] for w in place], pa.int64())
        key = pa.array([i % n for i in place.values()], pa.int64())
        columns = [*(rows[k].take(key) for k in keys), nodes.take(own), nodes.take(least)]
        yield from pa.Table.from_arrays(columns, names).to_batches()

    return edges.coalesce(1).mapInArrow(run, edges.toDF(*names).schema)


def components(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, node, component): component is the smallest node that edges (keys, u, v) reach.

    Edges of different keys never meet. Alternates large-star and small-star steps on the
    edge table until it no longer changes. Each step is a partial aggregate and a join
    whose large side is the edge table, so a hub's edges can be split over tasks; the
    result of each round is cut. FEW edges or fewer, whatever the data, are settled by one
    task in place of rounds. Nodes are longs or structs of them; loops and repeated edges
    are fine, rows with a null are ignored.
    """
    keys = keys or []
    at = [*keys, "u"]
    u, v = F.col("u"), F.col("v")
    edges = edges.toDF(*keys, "u", "v").where(u.isNotNull() & v.isNotNull() & (u != v))
    now = stored(edges.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _digest(now, keys)
    if seen[0] <= FEW:
        return stored(_united(now, keys))
    while True:
        both = now.unionByName(now.select(*keys, v.alias("u"), u.alias("v")))
        least = both.groupBy(*at).agg(F.min("v").alias("m")).select(*at, F.least("m", "u").alias("m"))
        large = both.join(least, at).where(v > u).select(*keys, v.alias("u"), F.col("m").alias("v"))
        large = large.where(u != v)
        least = large.groupBy(*at).agg(F.min("v").alias("m"))
        star = large.join(least, at)
        small = star.where(v != F.col("m")).select(*keys, v.alias("u"), F.col("m").alias("v"))
        after = stored(small.unionByName(least.select(*at, F.col("m").alias("v"))).distinct())
        last, seen = seen, _digest(after, keys)
        if last == seen:
            break
        now = after
    roots = after.select(*keys, F.col("v").alias("node")).distinct()
    return after.select(*keys, F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select(*keys, "node", F.col("node").alias("component"))
    )
