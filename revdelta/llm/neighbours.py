"""Approximate nearest neighbours by robust-pruned graphs, one for each shard.

Vectors are dealt to shards of bounded size. In a shard the graph is grown in batches:
greedy searches from the shard's medoid propose neighbours for the new vectors, pruning
keeps a proposed edge only if no kept neighbour is closer to it by the factor ALPHA, and
edges are added backwards and pruned likewise. Every query is then beam-searched in every
shard and the shards' answers are merged by exact distance.

Equal vectors are one node, with its K + 1 smallest ids: more of them can never be among
K answers, so nothing is lost and a vector that a third of the rows share is one node.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revdelta.llm.common import stored

#: Vectors in a shard on average: bounds a task's memory and work.
SHARD = 4000
#: Queries that search one shard in one task, on average.
QUERY_BLOCK = 20_000
DEGREE = 32
BUILD_BEAM = 64
SEARCH_BEAM = 96
ALPHA = 1.2
#: Vectors that are inserted or searched together.
BATCH = 1024


def _distances(points: np.ndarray, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of each query to the points in its row of ids."""
    gap = points[ids] - queries[:, None, :]
    return np.einsum("ijk,ijk->ij", gap, gap)


class Graph:
    """A directed graph over the rows of `points`; edges is (n, DEGREE) padded with -1.

    Walks compare single-precision copies; answers are measured again by who asks.
    """

    def __init__(self, points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 7):
        self._keep(points)
        points, self.degree, self.alpha = self.points, degree, alpha
        n = len(points)
        self.edges = np.full((n, degree), -1, np.int32)
        self.counts = np.zeros(n, np.int32)
        self.start = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
        order = np.random.default_rng(seed).permutation(n)
        order = np.concatenate([[self.start], order[order != self.start]])
        done = 1
        while done < n:
            # a batch sees the graph before it, so it grows by doubling up to BATCH;
            # its members also propose each other
            batch = order[done : done + min(BATCH, done)]
            found, _ = self._walk(points[batch], beam)
            near = _nearest_in(points, batch, min(len(batch), degree // 2))
            self._link(batch, np.concatenate([found, near], axis=1))
            done += len(batch)

    @classmethod
    def stored(cls, points: np.ndarray, edges: list, start: int) -> Graph:
        """A graph that was built before."""
        graph = cls.__new__(cls)
        graph._keep(points)
        graph.start = start
        graph.edges = np.full((len(points), max(1, max(map(len, edges)))), -1, np.int32)
        for row, own in zip(graph.edges, edges):
            row[: len(own)] = own
        return graph

    def _keep(self, points: np.ndarray) -> None:
        """Scale by the usual size of a vector, so that single precision holds the squares."""
        self.scale = float(np.median(np.abs(points).max(axis=1, initial=0))) or 1.0
        self.points = self._scaled(points)

    def _scaled(self, points: np.ndarray) -> np.ndarray:
        return np.clip(points / self.scale, -1e15, 1e15).astype(np.float32)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries in step: (ids, squared scaled distances), nearest first, -1 padded."""
        return self._walk(self._scaled(queries), beam)

    def _walk(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        m = len(queries)
        ids = np.full((m, beam), -1, np.int64)
        dist = np.full((m, beam), np.inf, np.float32)
        opened = np.zeros((m, beam), bool)
        ids[:, 0] = self.start
        dist[:, 0] = ((queries - self.points[self.start]) ** 2).sum(axis=1)
        seen = np.zeros((m, len(self.points)), bool)
        seen[:, self.start] = True
        live = np.arange(m)
        while len(live):
            waiting = np.where(opened[live] | (ids[live] < 0), np.inf, dist[live])
            at = waiting.argmin(axis=1)
            some = np.isfinite(waiting[np.arange(len(live)), at])
            live, at = live[some], at[some]
            if not len(live):
                break
            opened[live, at] = True
            step = self.edges[ids[live, at]]
            new = (step >= 0) & ~seen[live[:, None], step]
            rows = np.repeat(live, new.sum(axis=1))
            seen[rows, step[new]] = True
            far = np.where(new, _distances(self.points, queries[live], step), np.inf)
            both_ids = np.concatenate([ids[live], np.where(new, step, -1)], axis=1)
            both = np.concatenate([dist[live], far], axis=1)
            flags = np.concatenate([opened[live], np.zeros(step.shape, bool)], axis=1)
            keep = np.argpartition(both, beam - 1, axis=1)[:, :beam]
            take = np.arange(len(live))[:, None]
            ids[live], dist[live], opened[live] = both_ids[take, keep], both[take, keep], flags[take, keep]
        order = np.argsort(dist, axis=1, kind="stable")
        take = np.arange(m)[:, None]
        return ids[take, order], dist[take, order]

    def _prune(self, nodes: np.ndarray, pool: np.ndarray) -> np.ndarray:
        """Of each node's pool (-1 padded), the edges that relaxed pruning keeps."""
        n = len(nodes)
        pool = np.where(pool == nodes[:, None], -1, pool)
        dist = np.where(pool < 0, np.inf, _distances(self.points, self.points[nodes], pool))
        order = np.argsort(dist, axis=1, kind="stable")
        take = np.arange(n)
        pool, dist = pool[take[:, None], order], dist[take[:, None], order]
        kept = np.full((n, self.degree), -1, np.int32)
        count = np.zeros(n, np.int64)
        live = np.arange(n)
        while len(live):
            at = dist[live].argmin(axis=1)
            some = np.isfinite(dist[live, at]) & (count[live] < self.degree)
            live, at = live[some], at[some]
            if not len(live):
                break
            best = pool[live, at]
            kept[live, count[live]] = best
            count[live] += 1
            between = _distances(self.points, self.points[best], pool[live])
            drop = (self.alpha**2 * between <= dist[live]) | (pool[live] == best[:, None])
            dist[live] = np.where(drop, np.inf, dist[live])
        return kept

    def _link(self, batch: np.ndarray, pool: np.ndarray) -> None:
        kept = self._prune(batch, pool)
        self.edges[batch] = kept
        self.counts[batch] = (kept >= 0).sum(axis=1)
        sources = np.repeat(batch, self.counts[batch])
        targets = kept[kept >= 0].astype(np.int64)
        order = np.argsort(targets, kind="stable")
        sources, targets = sources[order], targets[order]
        nodes, first, sizes = np.unique(targets, return_index=True, return_counts=True)
        room = self.counts[nodes] + sizes <= self.degree
        rank = np.arange(len(targets)) - np.repeat(first, sizes)
        fits = np.repeat(room, sizes)
        self.edges[targets[fits], self.counts[targets[fits]] + rank[fits]] = sources[fits]
        self.counts[nodes[room]] += sizes[room].astype(np.int32)
        full = nodes[~room]
        if len(full):
            width = int(sizes[~room].max())
            more = np.full((len(full), width), -1, np.int64)
            row = np.repeat(np.arange(len(full)), sizes[~room])
            more[row, rank[~fits]] = sources[~fits]
            for i in range(0, len(full), BATCH):
                part = full[i : i + BATCH]
                again = self._prune(part, np.concatenate([self.edges[part], more[i : i + BATCH]], axis=1))
                self.edges[part] = again
                self.counts[part] = (again >= 0).sum(axis=1)


def _nearest_in(points: np.ndarray, batch: np.ndarray, k: int) -> np.ndarray:
    """The k nearest members of the batch to each of its members, itself included."""
    own = points[batch]
    square = (own**2).sum(axis=1)
    dist = square[:, None] + square[None, :] - 2 * own @ own.T
    return batch[np.argpartition(dist, k - 1, axis=1)[:, :k]]


def usable(vectors: DataFrame, vector: str, id_col: str) -> DataFrame:
    """(id, v) rows that take part: not null, no null or non-finite component, not all zero."""
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), v.alias("v")).where("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0))


INDEX = "shard int, place int, start boolean, v array<double>, ids array<bigint>, edges array<int>"


def index(vectors: DataFrame, k: int = 10, vector: str = "embedding", id_col: str = "vec_id", shard: int = SHARD) -> DataFrame:
    """The graphs of all shards: a row per distinct vector with its place in the shard's
    graph, the places its edges lead to, and its k + 1 smallest ids. `start` marks where
    searches begin; vectors of different lengths never share a graph."""
    # equal vectors become one node; of a vector's ids each task passes on k + 1 at most
    rows = usable(vectors, vector, id_col).distinct()
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    least = rows.select("id", "v", place.alias("nth")).where(F.col("nth") <= k + 1)
    nodes = stored(least.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    shards = max(1, ceil(nodes.count() / shard))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    # a task for each shard: partitions that are dealt by number stay apart
    dealt = dealt.repartitionById(shards, "shard")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        points = np.array(pdf["v"].tolist(), np.float64).reshape(len(pdf), -1)
        graph = Graph(points)
        edges = [row[:n].tolist() for row, n in zip(graph.edges, graph.counts)]
        return pd.DataFrame({
            "shard": pdf["shard"], "place": np.arange(len(pdf)), "start": np.arange(len(pdf)) == graph.start,
            "v": pdf["v"], "ids": pdf["ids"], "edges": edges,
        })

    return dealt.groupBy("shard", F.size("v")).applyInPandas(build, INDEX)


def search(
    graphs: DataFrame, queries: DataFrame, k: int = 10, vector: str = "embedding", id_col: str = "vec_id",
    beam: int = SEARCH_BEAM, block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, <id_col>, score): each query's k nearest other rows by distance.

    graphs: a table made by index(). score is the Euclidean distance in double precision
    on the original vectors; ties go to the smaller id. Vectors that are null, zero or
    hold a null or non-finite component take no part; queries are searched among vectors
    of their own length. Repeated rows count once. Empty tables give no rows. Queries go
    to every shard in blocks of bounded size.
    """
    asked = usable(queries, vector, id_col).groupBy("id", "v").agg(F.lit(1).alias("one")).select("id", "v")
    blocks = max(1, ceil(asked.count() / block))
    shards = graphs.agg(F.max("shard")).first()[0]
    shards = 0 if shards is None else shards + 1
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))) if shards else F.lit(0))
    held = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(points: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        none = {"query_id": np.array([], np.int64), "ids": pd.Series([], dtype=object), "score": np.array([], np.float64)}
        if points.empty or questions.empty:
            return pd.DataFrame(none)
        return _search_shard(points, questions, k, beam)

    key = ["shard", "block", "length"]
    found = (
        held.withColumn("length", F.size("v")).groupBy(*key)
        .cogroup(asked.withColumn("length", F.size("v")).groupBy(*key))
        .applyInPandas(run, "query_id bigint, ids array<bigint>, score double")
    )
    # each shard sends k + 1 nodes for a query; the exact order decides between them
    flat = found.select("query_id", "score", F.explode("ids").alias("other")).where("query_id != other")
    nearest = F.slice(F.array_sort(F.collect_set(F.struct("score", "other"))), 1, k)
    best = flat.groupBy("query_id").agg(nearest.alias("best"))
    return best.select("query_id", F.posexplode("best").alias("pos", "b")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.other").alias(id_col), F.col("b.score").alias("score")
    )


def _search_shard(nodes: pd.DataFrame, questions: pd.DataFrame, k: int, beam: int) -> pd.DataFrame:
    nodes = nodes.sort_values("place")
    points = np.array(nodes["v"].tolist(), np.float64).reshape(len(nodes), -1)
    graph = Graph.stored(points, nodes["edges"].tolist(), int(np.flatnonzero(nodes["start"])[0]))
    ids = nodes["ids"].to_numpy()
    wanted = min(k + 1, len(points))
    query_ids, places, scores = [], [], []
    for at in range(0, len(questions), BATCH):
        part = questions.iloc[at : at + BATCH]
        asked = np.array(part["v"].tolist(), np.float64).reshape(len(part), -1)
        found, _ = graph.search(asked, max(beam, wanted))
        dist = np.where(found < 0, np.inf, np.sqrt(_distances(points, asked, found)))
        order = np.argsort(dist, axis=1, kind="stable")
        take = np.arange(len(part))[:, None]
        found, dist = found[take, order], dist[take, order]
        # what ties with the last one wanted goes along: ids decide between them
        rows, cols = np.nonzero((found >= 0) & (dist <= dist[:, wanted - 1 : wanted]))
        query_ids.append(part["id"].to_numpy()[rows])
        places.append(found[rows, cols])
        scores.append(dist[rows, cols])
    place = np.concatenate(places)
    return pd.DataFrame(
        {"query_id": np.concatenate(query_ids), "ids": [ids[p] for p in place], "score": np.concatenate(scores)}
    )
