"""Merkle manifest of a table: a digest of every row, a tree for each group, one root.

Rows are leaves; in each tree every 8 neighbours become their digest until one is left, and
the trees' roots, ordered by group, form one more tree. With a row's siblings on the way
up (its proof) anyone can tell whether the row still is what the root was made of.

Fragments of the forest form a monoid. A fragment holds unresolved nodes, keyed by tree,
level and index; joining two unites their nodes and resolves every run of siblings that
is complete, which is known as each tree's size is. Every range of sorted rows resolves
what it can and keeps a few nodes a level at its ends; fragments are then merged FAN at a
time until no two are left. All nodes that leave a range stay in a table, of at
most some hundred rows a range, from which each range learns the siblings above its own.

Null fields are told from empty ones. Null groups are a group of their own, the first.
Rows that repeat group and order are ordered by their digests; equal rows are leaves of
their own. An empty table has no root and gives no rows. Columns that are not named in
`fields` take no part, whatever they are called.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revdelta.llm.common import stored
from revdelta.operators.ordering import numbered

#: Siblings of a run; ranges merged at a time; rows of a range at most, about.
ARITY_BITS, FAN, RANGE_ROWS = 3, 16, 500_000
ARITY = 1 << ARITY_BITS
#: Bytes of the trees' names and sizes up to which they are broadcast.
NAMES_BYTES = 8 << 20


def leaf(values: dict[str, Column], fields: list[str]) -> Column:
    """Hex digest of a row: every field as `-` if null, else its byte count, a colon, its value."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[one(values[f].cast("string")) for f in fields]), 256)


def digest_of(children: Iterable[bytes]) -> bytes:
    """The digest of a run: of its children's digests as hex text."""
    return sha256(b"".join(children).hex().encode()).digest()


Levels = dict[int, dict[int, bytes]]


def settle(size: int, levels: Levels) -> list[tuple[int, int, bytes]]:
    """Resolve every complete run of one tree, in place; returns the nodes made.

    levels: unresolved nodes by level and index; size: leaves of the whole tree.
    """
    made, width, level = [], size, 0
    while width > 1:
        row, above = levels.get(level, {}), levels.setdefault(level + 1, {})
        held: dict[int, int] = defaultdict(int)
        for i in row:
            held[i >> ARITY_BITS] += 1
        for run, n in held.items():
            first = run << ARITY_BITS
            if n == min(ARITY, width - first):
                above[run] = digest_of(row.pop(i) for i in range(first, first + n))
                made.append((level + 1, run, above[run]))
        width, level = -(-width >> ARITY_BITS), level + 1
    return made


def _is_root(size: int, level: int) -> bool:
    return size <= 1 << ARITY_BITS * level


NODE = "tree long, size long, level int, at long, digest binary"


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
    names, types = zip(*(f.split() for f in schema.split(", ")))
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.table([pa.array(c, kinds[t]) for c, t in zip(columns, types)], names=list(names))


def _by_tree(table: pa.Table) -> dict[tuple[int, int], Levels]:
    found: dict[tuple[int, int], Levels] = {}
    for tree, size, level, at, digest in zip(*(table.column(c).to_pylist() for c in ("tree", "size", "level", "at", "digest"))):
        found.setdefault((tree, size), {}).setdefault(level, {})[at] = digest
    return found


def _rows_of(trees: dict[tuple[int, int], Levels]) -> Iterator[tuple]:
    for (tree, size), levels in trees.items():
        for level, row in levels.items():
            for at, digest in row.items():
                yield tree, size, level, at, digest


def _fragments(key: tuple, table: pa.Table) -> pa.Table:
    """What one range cannot resolve by itself."""
    part = key[0].as_py()
    trees = _by_tree(table)
    for (_, size), levels in trees.items():
        settle(size, levels)
    return _table([(part, *r) for r in _rows_of(trees)], f"part int, {NODE}")


def _merged(key: tuple, table: pa.Table) -> pa.Table:
    """Join fragments: nodes made of complete runs, and what stays unresolved (`open`)."""
    part, rows = key[0].as_py(), []
    trees = _by_tree(table)
    for (tree, size), levels in trees.items():
        made = settle(size, levels)
        left = {(level, at) for level, row in levels.items() for at in row}
        new = {(level, at) for level, at, _ in made}
        rows += [(part, tree, size, *m, True, m[:2] in left and not _is_root(size, m[0])) for m in made]
        rows += [(part, *r, False, True) for r in _rows_of({(tree, size): levels}) if (r[2], r[3]) not in new]
    return _table(rows, f"part int, {NODE}, made boolean, open boolean")


@dataclass
class Forest:
    """leaves: the input plus tree, size, level, at and part; nodes: all that left a range,
    with its part, or none for nodes made by merging; height of the tallest tree."""

    leaves: DataFrame
    nodes: DataFrame
    height: int


def grow(leaves: DataFrame, group: str, order: list[str]) -> Forest | None:
    """The trees of a table that holds `digest` (binary), one for each group; None if empty."""
    spark = leaves.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(leaves.count() / RANGE_ROWS))
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]
    ranged = numbered(leaves, by, "number", parts=parts)
    trees = stored(ranged.groupBy(F.col(group).alias("_name")).agg(F.min("number").alias("tree"), F.count("*").alias("size")))
    told = trees.agg(F.sum(F.coalesce(F.octet_length(F.col("_name").cast("string")), F.lit(0)) + 32), F.max("size")).first()
    if told[0] is None:
        return None
    known = F.broadcast(trees) if told[0] <= NAMES_BYTES else trees
    placed = ranged.join(known, F.col(group).eqNullSafe(F.col("_name")))
    placed = placed.select(*leaves.columns, "part", "tree", "size", F.lit(0).alias("level"), (F.col("number") - F.col("tree")).alias("at"))
    node = ["tree", "size", "level", "at", "digest"]
    nodes = stored(placed.select("part", *node).groupBy("part").applyInArrow(_fragments, f"part int, {NODE}"))
    root = F.col("size") <= F.expr(f"shiftleft(1L, {ARITY_BITS} * level)")
    now, ranges = nodes.where(~root), 1 + (nodes.agg(F.max("part")).first()[0] or 0)
    while ranges > 1:
        joint = now.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).select("part", *node)
        after = stored(joint.groupBy("part").applyInArrow(_merged, f"part int, {NODE}, made boolean, open boolean"))
        nodes = nodes.unionByName(after.where("made").select(F.lit(None).cast("int").alias("part"), *node))
        now, ranges = after.where("open").select("part", *node), math.ceil(ranges / FAN)
    return Forest(placed, nodes, next(h for h in range(64) if _is_root(told[1], h)))


def roots(forest: Forest) -> DataFrame:
    """(tree, size, digest) of every tree."""
    return forest.nodes.where(F.col("size") <= F.expr(f"shiftleft(1L, {ARITY_BITS} * level)")).select("tree", "size", "digest")


STEP = "array<struct<place:int,siblings:binary>>"


def above(forest: Forest) -> DataFrame:
    """(part, tree, size, level, at, path): the siblings from every node that left a range up
    to its tree's root."""
    own = F.struct("at", "digest")
    parent = F.shiftright("at", ARITY_BITS)
    inner = forest.nodes.where(F.col("size") > F.expr(f"shiftleft(1L, {ARITY_BITS} * level)"))
    runs = stored(inner.groupBy("tree", F.col("level").alias("on"), parent.alias("run")).agg(F.sort_array(F.collect_list(own)).alias("nodes")))
    now = forest.nodes.where("part is not null").select(
        "part", "tree", "size", "level", "at", F.col("at").alias("up"), F.array().cast(STEP).alias("path")
    )
    for step in range(forest.height):
        run = runs.select(F.col("tree").alias("_tree"), "on", "run", "nodes")
        met = now.join(run, (F.col("tree") == F.col("_tree")) & (F.col("level") + step == F.col("on")) & (F.shiftright("up", ARITY_BITS) == F.col("run")), "left")
        place = F.col("up").bitwiseAND(F.lit(ARITY - 1)).cast("int")
        others = F.concat(F.slice("nodes", F.lit(1), place), F.slice("nodes", place + 2, F.lit(ARITY)))
        others = F.aggregate(others, F.lit(b""), lambda joined, node: F.concat(joined, node["digest"]))
        step_up = F.array(F.struct(place.alias("place"), others.alias("siblings")))
        path = F.when(F.col("nodes").isNull(), F.col("path")).otherwise(F.concat("path", step_up)).cast(STEP)
        now = met.select("part", "tree", "size", "level", "at", F.shiftright("up", ARITY_BITS).alias("up"), path.alias("path"))
    return now.drop("up")


class _Way:
    """Ways from the nodes of one range to the root; asks for neighbours in turn are cheap.

    A way is the hex text of all siblings and, for each step, the text left and right.
    """

    def __init__(self, size: int, levels: Levels, outer: dict[tuple[int, int], list[dict]]):
        self.widths, self.levels, self.outer, self.last = [size], levels, outer, {}
        while self.widths[-1] > 1:
            self.widths.append(-(-self.widths[-1] >> ARITY_BITS))

    def of(self, level: int, at: int) -> tuple[bytes, list[tuple[bytes, bytes]]]:
        kept = self.last.get(level)
        if kept is None or kept[0] != at:
            kept = self.last[level] = (at, self._find(level, at))
        return kept[1]

    def _find(self, level: int, at: int) -> tuple[bytes, list[tuple[bytes, bytes]]]:
        if (level, at) in self.outer:
            texts = [(s["place"], s["siblings"].hex().encode()) for s in self.outer[level, at]]
            return b"".join(t for _, t in texts), [(t[: 64 * p], t[64 * p :]) for p, t in texts]
        run = at >> ARITY_BITS
        first, last = run << ARITY_BITS, min(self.widths[level], (run + 1) << ARITY_BITS)
        row = self.levels[level]
        left = b"".join(row[i] for i in range(first, at)).hex().encode()
        right = b"".join(row[i] for i in range(at + 1, last)).hex().encode()
        text, steps = self.of(level + 1, run)
        return left + right + text, [(left, right), *steps]


def _ways(leaves: pa.Table, outer: pa.Table) -> Iterator[tuple[int, bytes, list[tuple[bytes, bytes]]]]:
    """(row of `leaves`, siblings, steps), by tree and place."""
    paths: dict[int, dict] = {}
    for tree, level, at, path in zip(*(outer.column(c).to_pylist() for c in ("tree", "level", "at", "path"))):
        paths.setdefault(tree, {})[level, at] = path
    trees = _by_tree(leaves)
    ways = {}
    for (tree, size), levels in trees.items():
        whole = {level: dict(row) for level, row in levels.items()}
        for level, at, digest in settle(size, levels):
            whole.setdefault(level, {})[at] = digest
        ways[tree] = _Way(size, whole, paths[tree])
    tree, at = (leaves.column(c).to_pylist() for c in ("tree", "at"))
    for row in sorted(range(len(at)), key=lambda r: (tree[r], at[r])):
        yield row, *ways[tree[row]].of(0, at[row])


def _paths(leaves: pa.Table, outer: pa.Table) -> pa.Table:
    own = leaves.column("own").to_pylist()
    rows = [
        (own[row], [{"place": len(a) // 64, "siblings": bytes.fromhex((a + b).decode())} for a, b in steps])
        for row, _, steps in _ways(leaves, outer)
    ]
    kind = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.binary())]))
    return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], kind)], names=["own", "path"])


def _fold(digest: bytes, steps: list[tuple[bytes, bytes]]) -> str:
    text = digest.hex()
    for left, right in steps:
        text = sha256(left + text.encode() + right).hexdigest()
    return text


PROOF = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proofs(leaves: pa.Table, outer: pa.Table) -> pa.Table:
    if not leaves.num_rows:
        return _table([], PROOF)
    root = outer.column("root")[0].as_py().hex()
    subroots = dict(zip(outer.column("tree").to_pylist(), outer.column("subroot").to_pylist()))
    ids, trees, digests, changed = (leaves.column(c).to_pylist() for c in ("id", "tree", "digest", "changed"))
    rows = []
    for row, siblings, steps in _ways(leaves, outer):
        folded = _fold(changed[row] or digests[row], steps)
        proof = sha256(siblings).hexdigest()
        rows.append((ids[row], digests[row].hex(), subroots[trees[row]].hex(), root, proof, folded, folded == root))
    return _table(rows, PROOF)


def verify(docs: DataFrame, fields: list[str], group: str, id_col: str, changed: dict[str, Column] | None = None) -> DataFrame:
    """Each row's leaf, its tree's root, the root of all, and what its proof says of the row.

    changed: values that some fields have now; a row's leaf is made of them again and
    folded with the siblings of the manifest, which were made of the values of docs.
    Columns: <id_col> (long), leaf, subroot, root, proof_sha256 (digest of all siblings, level
    by level, left to right), folded_root, verified.
    """
    own = {f: F.col(f"`{f}`") for f in fields}
    same = F.lit(True)
    for f, value in (changed or {}).items():
        same = same & value.eqNullSafe(own[f])
    now = F.when(~same, F.unhex(leaf(own | (changed or {}), fields)))
    base = docs.select(own[id_col].cast("long").alias("id"), F.col(f"`{group}`").alias("name"), F.unhex(leaf(own, fields)).alias("digest"), now.alias("changed"))
    forest = grow(stored(base), "name", ["id", "digest"])
    if forest is None:
        return docs.sparkSession.createDataFrame([], PROOF).withColumnRenamed("id", id_col)
    names = forest.leaves.groupBy("tree").agg(F.first("name").alias("name"))
    tops = stored(roots(forest).join(names, "tree").select(F.lit(0).alias("all"), "name", "digest", F.col("tree").alias("own")))
    top = grow(tops, "all", ["name"])
    root = roots(top).first()["digest"]
    ways = top.leaves.groupBy("part").cogroup(above(top).groupBy("part")).applyInArrow(_paths, f"own long, path {STEP}")
    ways = ways.join(tops.select("own", F.col("digest").alias("subroot")), "own").withColumnRenamed("path", "rest")
    outer = above(forest).join(ways, F.col("tree") == F.col("own")).select(
        "part", "tree", "level", "at", F.concat("path", "rest").alias("path"), "subroot", F.lit(bytes(root)).alias("root")
    )
    leaves = forest.leaves.select("part", "id", "tree", "size", "level", "at", "digest", "changed")
    proofs = leaves.groupBy("part").cogroup(outer.groupBy("part")).applyInArrow(_proofs, PROOF)
    return proofs.withColumnRenamed("id", id_col)
