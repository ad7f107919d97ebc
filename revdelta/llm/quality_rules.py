"""Quality rules as a bitmask ledger.

measure() reads each text once and keeps its measurements; ledger() turns every rule
into one failure bit; policies are bit masks over the ledger, so a new policy version
or an ablation never reads a text again.

Null texts count as empty. Empty texts and texts without words have zero counts. Rows
with equal ids stay separate rows; other columns pass through (columns that clash with
the measurements are replaced). An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revdelta.llm.common import map_texts

SPACES = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_letters", "n_upper",
)


def _repeat_words(words: list[bytes], size: int = 3) -> int:
    """Words covered by windows of `size` words that occur at least twice."""
    n = len(words)
    if n <= size:
        return 0
    first: dict[bytes, int] = {}
    ids = np.fromiter(map(first.setdefault, words, range(n)), np.int64, n)
    codes = ids[: n - size + 1]
    for i in range(1, size):
        codes = codes * n + ids[i : n - size + 1 + i]
        if n > 1 << 20:  # keep products within 63 bits
            codes = np.unique(codes, return_inverse=True)[1]
    _, at, counts = np.unique(codes, return_inverse=True, return_counts=True)
    again = counts[at] > 1
    covered = np.zeros(n, bool)
    for i in range(size):
        covered[i : n - size + 1 + i] |= again
    return int(covered.sum())


def _measure(text: bytes) -> tuple[int, ...]:
    words = text.split()  # on bytes: space and \t to \r, nothing else
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    decoded = text.decode("utf-8", "replace")
    letters, upper = len(text.translate(None, _NOT_LETTERS)), len(text.translate(None, _NOT_UPPER))
    return (
        len(words), len(decoded) - (len(text) - len(text.translate(None, SPACES))),
        len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), _repeat_words(words),
        len(lines), letters, upper,
    )


_UPPER = bytes(range(65, 91))
_NOT_UPPER = bytes(sorted(set(range(256)) - set(_UPPER)))
_NOT_LETTERS = bytes(sorted(set(range(256)) - set(_UPPER) - set(range(97, 123))))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus the columns MEASURES (longs). n_letters and n_upper count A-Z and a-z."""

    def make():
        def work(texts: list[bytes]) -> list[pa.Array]:
            rows = [_measure(t) for t in texts]
            return [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES))]

        return work

    return map_texts(docs, text, [T.StructField(m, T.LongType()) for m in MEASURES], make)


@dataclass(frozen=True)
class Rule:
    """A document fails where `fails` (SQL over the measurements) holds."""

    name: str
    fails: str


#: The order gives each rule its bit; append only, so that stored ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", "10 * n_symbols > n_words"),
    Rule("mostly_upper", "n_letters >= 20 and 2 * n_upper > n_letters"),
    Rule("duplicate_lines", "n_lines >= 4 and 100 * n_dup_lines > 60 * n_lines"),
    Rule("long_words", "n_words > 0 and word_chars > 20 * n_words"),
    Rule("short_words", "n_words > 0 and 10 * word_chars < 18 * n_words"),
)
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A version names the rules that reject; others are recorded only."""

    name: str
    version: int
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        names = [r.name for r in rules]
        return sum(1 << names.index(x) for x in set(self.rules))


BASE_POLICY = Policy("base", 1, BASE)
POLICY = Policy("prose", 1, tuple(r.name for r in RULES))


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs plus measurements plus `failed`, a long with one bit for each rule."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)]
    failed: Column = F.lit(0).cast("long")
    for b in bits:
        failed = failed.bitwiseOR(b)
    return measure(docs, text).withColumn("failed", failed)


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    return F.col("failed").bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0


def ablations(ledgers: DataFrame, policies: tuple[Policy, ...], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each policy and rule: what it fails, what it alone fails, what would stay without it.

    The ledger shrinks to a count for each distinct mask before anything else, so the
    shuffle carries at most 2^rules rows from a task.
    """
    masks = ledgers.groupBy("failed").count()
    cases = [
        (p.name, p.version, r.name, p.mask(rules), 1 << i)
        for p in policies for i, r in enumerate(rules) if r.name in p.rules
    ]
    per_rule = F.explode(F.array(*[
        F.struct(
            F.lit(n).alias("policy"), F.lit(v).alias("version"), F.lit(r).alias("rule"),
            F.lit(m).cast("long").alias("mask"), F.lit(b).cast("long").alias("bit"),
        ) for n, v, r, m, b in cases
    ]))
    rows = masks.select("failed", "count", per_rule.alias("c")).select("failed", "count", "c.*")
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    count_if = lambda cond: F.sum(F.when(cond, F.col("count")).otherwise(0))
    return rows.groupBy("policy", "version", "rule").agg(
        F.sum("count").alias("n_docs"),
        count_if(hit.bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count_if(hit == F.col("bit")).alias("n_failed_alone"),
        count_if(hit == 0).alias("n_kept"),
        count_if(hit.bitwiseAND(F.bitwise_not("bit")) == 0).alias("n_kept_without"),
    )
