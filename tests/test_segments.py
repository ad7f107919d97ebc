"""Segments of edit scripts come from rows, without sorting edits."""

import itertools
import random

import pyarrow as pa

from revdelta.operators import edits


def plain(script, exact, a, b):
    """Runs one after the other, told apart edit by edit."""
    out, i, j = [], 0, 0
    for _, run in itertools.groupby(script, lambda e: "=" if e == "=" else "~" if exact else e):
        run = list(run)
        ni, nj = sum(e != "+" for e in run), sum(e != "-" for e in run)
        kind = "same" if run[0] == "=" else "changed" if ni and nj else "removed" if ni else "added"
        out.append({"segment": len(out) + 1, "kind": kind, "before_tokens": a[i : i + ni], "after_tokens": b[j : j + nj]})
        i, j = i + ni, j + nj
    return out


def test_segments_equal_plain_ones():
    draw = random.Random(5)
    rows = []
    for n in [0, 1, *(draw.randrange(40) for _ in range(60))]:
        script = [draw.choice("=+-") for _ in range(n)]
        a, b = ([f"{s}{k}" for k in range(sum(e != absent for e in script))] for s, absent in (("a", "+"), ("b", "-")))
        rows.append((script, draw.random() < 0.5, a, b))
    texts = pa.list_(pa.string())
    columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((texts, pa.bool_(), texts, texts))]
    assert edits._islands(*columns).to_pylist() == [plain(*r) for r in rows]
    assert edits._islands(*(c.slice(5, 20) for c in columns)).to_pylist() == [plain(*r) for r in rows[5:25]]


def test_edits_are_not_shuffled(spark):
    """Rows of edits took some 18 times the disk of the texts."""
    kind = "k int, edits array<string>, exact boolean, a array<string>, b array<string>"
    rows = [(1, ["=", "-", "+", "="], True, ["x", "y", "z"], ["x", "w", "z"]), (2, ["-", "+"], False, ["x"], ["y"]), (3, [], True, [], []), (4, None, True, None, None)]
    found = edits.segments(spark.createDataFrame(rows, kind), ["k"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    assert sorted((r.k, r.segment, r.kind, r.before_tokens, r.after_tokens) for r in found.collect()) == [
        (1, 1, "same", ["x"], ["x"]), (1, 2, "changed", ["y"], ["w"]), (1, 3, "same", ["z"], ["z"]),
        (2, 1, "removed", ["x"], []), (2, 2, "added", [], ["y"]),
    ]
