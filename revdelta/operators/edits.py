"""Word-level differences of two texts."""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revdelta.functions import text as X

#: The work that a comparison may take before it gives up.
LEAST_WORK, MOST_WORK, WORK_PER_TOKEN = 250_000, 4_000_000, 240


#: Edits from which a level's diagonals are followed together rather than one by one, and
#: how few of them that still match are followed one by one again.
WIDE, FEW = 64, 8


def shortest_script(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]] | None:
    """The common tokens, as index pairs, of a shortest edit script; None beyond the work limit.

    The greedy furthest-reaching search: on each diagonal k = i - j the furthest i that d
    edits reach. Work counts every diagonal tried and every common token passed.
    """
    n, m = len(a), len(b)
    limit = max(LEAST_WORK, min(MOST_WORK, (n + m) * WORK_PER_TOKEN))
    ids: dict[str, int] = {}
    # tokens as numbers; the ends differ from everything, so no match runs over them
    one = [*(ids.setdefault(t, len(ids)) for t in a), -1]
    two = [*(ids.setdefault(t, len(ids)) for t in b), -2]
    arrays = np.array(one), np.array(two)
    # a level holds how far each of its diagonals, d + 1 of them, reached
    levels: list[array | np.ndarray] = []
    last, work = array("i"), 0
    for d in range(n + m + 1):
        if d >= WIDE:
            reach, costs = _together(np.asarray(last), d, one, two, *arrays)
            ends = np.flatnonzero((reach >= n) & (reach - (2 * np.arange(d + 1) - d) >= m))
            at = int(ends[0]) if len(ends) else d
            work += int(costs[: at + 1].sum())
            if work > limit:
                return None
            if len(ends):
                return _common(levels, n, m, d, at)
            levels.append(reach)
            last = reach
            continue
        reach = array("i", bytes(4 * (d + 1)))
        for at in range(d + 1):
            # diagonal k = 2 * at - d comes from k + 1 (an insertion) or k - 1 of the last level
            if not d:
                i = 0
            elif not at or at < d and last[at - 1] < last[at]:
                i = last[at]
            else:
                i = last[at - 1] + 1
            start, j = i, i - (2 * at - d)
            if i < n and j < m:
                while one[i] == two[j]:
                    i, j = i + 1, j + 1
            work += 1 + i - start
            if work > limit:
                return None
            reach[at] = i
            if i >= n and j >= m:
                return _common(levels, n, m, d, at)
        levels.append(reach)
        last = reach
    return None


def _together(
    last: np.ndarray, d: int, one: list[int], two: list[int], one_at: np.ndarray, two_at: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(how far the diagonals of level d reach, the work of each), from the level before."""
    n, m = len(one) - 1, len(two) - 1
    i = np.empty(d + 1, np.int32)
    i[0], i[d] = last[0], last[d - 1] + 1
    # the further of an insertion and a removal
    i[1:d] = np.maximum(last[1:], last[:-1] + 1)
    start, j = i.copy(), i - (2 * np.arange(d + 1, dtype=np.int32) - d)
    live = np.flatnonzero(one_at[np.minimum(i, n)] == two_at[np.minimum(j, m)])
    while len(live) > FEW:
        i[live] += 1
        j[live] += 1
        live = live[one_at[np.minimum(i[live], n)] == two_at[np.minimum(j[live], m)]]
    for at in live.tolist():
        x, y = int(i[at]), int(j[at])
        while one[x] == two[y]:
            x, y = x + 1, y + 1
        i[at] = x
    return i, 1 + i - start


def _common(levels: list[array], i: int, j: int, d: int, at: int) -> list[tuple[int, int]]:
    """Follow the search back from the end and collect the diagonals it went down."""
    pairs: list[tuple[int, int]] = []
    while True:
        insert = start = 0
        if d:
            last = levels[d - 1]
            insert = not at or at < d and last[at - 1] < last[at]
            start = last[at] if insert else last[at - 1] + 1
        while i > start and j > start - (2 * at - d):
            i, j = i - 1, j - 1
            pairs.append((i, j))
        if not d:
            return pairs[::-1]
        i, j = (i, j - 1) if insert else (i - 1, j)
        d, at = d - 1, at if insert else at - 1


def script(a: Sequence[str], b: Sequence[str]) -> tuple[list[str], bool]:
    """(edits in order, whether exact): "=" keeps, "-" removes from a, "+" adds from b."""
    common = shortest_script(a, b) if len(a) and len(b) else []
    if common is None:
        return ["-"] * len(a) + ["+"] * len(b), False
    out: list[str] = []
    i = j = 0
    for x, y in [*common, (len(a), len(b))]:
        out += _between(a, b, i, j, x, y)
        if x < len(a) or y < len(b):
            out.append("=")
        i, j = x + 1, y + 1
    return out, True


def _between(a, b, i: int, j: int, x: int, y: int) -> list[str]:
    return ["-"] * (x - i) + ["+"] * (y - j)


EDITS = "edits array<string>, exact boolean"


def token_edits(pairs: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """pairs plus a, b (token arrays), edits and exact.

    One pair is one row's work, of very uneven cost and little size, so rows are dealt
    over all cores first.
    """
    dealt = pairs.repartition(4 * pairs.sparkSession.sparkContext.defaultParallelism)  # tokens only then: they are larger than texts
    words = dealt.withColumn("a", X.tokens(F.col(before))).withColumn("b", X.tokens(F.col(after)))

    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        made = [script(list(x), list(y)) for x, y in zip(a, b)]
        return pd.DataFrame({"edits": [e for e, _ in made], "exact": [x for _, x in made]})

    return words.withColumn("made", F.pandas_udf(run, EDITS)("a", "b")).select("*", "made.*").drop("made")


SEGMENTS = "array<struct<segment:int,kind:string,before_tokens:array<string>,after_tokens:array<string>>>"
#: Scripts that are cut at once.
ROWS = 256
_KINDS = pa.array(["same", "changed", "removed", "added"])


def list_starts(lists: pa.Array) -> np.ndarray:
    """Where each list's values start within all values, and their end; null lists are empty."""
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])


def _islands(edits: pa.Array, exact: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
    """SEGMENTS of each script: runs of kept and of other edits with their tokens of both
    sides. Inexact scripts part removals from additions."""
    at = list_starts(edits)
    row = np.repeat(np.arange(len(edits)), np.diff(at))
    values = edits.flatten()
    same, plus, minus = (pc.equal(values, e).to_numpy(zero_copy_only=False).astype(bool) for e in "=+-")
    whole = pc.fill_null(exact, False).to_numpy(zero_copy_only=False).astype(bool)[row]
    sort = np.where(same, 0, np.where(whole, 1, np.where(plus, 2, 3)))
    fresh = np.ones(len(sort), bool)
    fresh[1:] = (sort[1:] != sort[:-1]) | (row[1:] != row[:-1])
    heads = np.flatnonzero(fresh)
    ends, own = np.append(heads[1:], len(sort)), row[heads]
    upto = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(edits)))])
    sizes, tokens = [], []
    for absent, side in ((plus, a), (minus, b)):
        seen = np.concatenate([[0], np.cumsum(~absent)])
        n = seen[ends] - seen[heads]
        first = list_starts(side)[own] + seen[heads] - seen[at[own]]
        held = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat(first - held[:-1], n) + np.arange(held[-1])
        tokens.append(pa.ListArray.from_arrays(pa.array(held, pa.int32()), side.flatten().take(pa.array(place))))
        sizes.append(n)
    kind = np.where(sort[heads] == 0, 0, np.where((sizes[0] > 0) & (sizes[1] > 0), 1, np.where(sizes[0] > 0, 2, 3)))
    fields = [pa.array(np.arange(len(heads)) - upto[own] + 1, pa.int32()), _KINDS.take(pa.array(kind)), *tokens]
    told = pa.StructArray.from_arrays(fields, ["segment", "kind", "before_tokens", "after_tokens"])
    return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), told)


def _segmented(edited: DataFrame) -> DataFrame:
    """edited plus `segments`, in order. A script is one row's work: its edits never become
    rows that are sorted."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            for at in range(0, len(batch[0]), ROWS):
                yield _islands(*(column.slice(at, ROWS) for column in batch))

    return edited.withColumn("segments", F.arrow_udf(SEGMENTS)(run)("edits", "exact", "a", "b"))


def segments(edited: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, segment, kind, before_tokens, after_tokens): runs of kept and of changed tokens.

    A changed run with both sides is one replacement where the script is exact, else a
    removal and an addition.
    """
    return _segmented(edited).select(*keys, F.explode("segments").alias("s")).select(*keys, "s.*")


def text_runs(of_segments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, segment, side, id, kind, text): what each side shows of every segment."""
    sides = F.explode(F.array(
        F.struct(F.lit("before").alias("side"), X.join_tokens(F.col("before_tokens")).alias("text")),
        F.struct(F.lit("after").alias("side"), X.join_tokens(F.col("after_tokens")).alias("text")),
    )).alias("run")
    rows = of_segments.select(*keys, "segment", "kind", sides).where("run.text != ''")
    run_id = F.concat(F.lit("semantic-"), F.col("segment"), F.lit("-"), F.col("run.side"))
    return rows.select(*keys, "segment", "run.side", run_id.alias("id"), "kind", "run.text")


def text_changes(of_segments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, kind, before, after): the changed segments."""
    return of_segments.where("kind != 'same'").select(
        *keys, F.concat(F.lit("semantic-"), F.col("segment")).alias("id"), "kind",
        X.join_tokens(F.col("before_tokens")).alias("before"), X.join_tokens(F.col("after_tokens")).alias("after"),
    )
