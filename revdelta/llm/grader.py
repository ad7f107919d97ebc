"""Quality grades by ordinal regression with a cumulative link.

A text's score is the sum of the weights of its distinct hashed features; thresholds
t1 < t2 < ... cut the score into grades: P(grade >= k) = sigmoid(score - t_k). All grades
share the weights, so the model orders texts and gives both an expected grade and the
probability of the upper grades.

Training uses a bounded sample of the rated documents (SAMPLE, the least hashes of their
ids, so the same rows whatever the partitioning) whose features the executors compute;
scoring is one pass over all documents.

Null and empty texts have only the bias feature. Repeated rows are graded each for
itself; columns that clash with the results are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh32_intdigest

from revdelta.llm.common import map_texts

BUCKETS = 1 << 18
#: Most rated documents that training uses; more do not change the model noticeably.
SAMPLE = 12_000
EPOCHS, BATCH, RATE = 20, 128, 0.15
#: Weight of the absolute-value penalty: features without evidence stay at exactly zero.
LASSO = 2e-4
#: Features of fewer training texts than this have no weight: they would only be learnt by heart.
LEAST_TEXTS = 3

_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_SYMBOLS = bytes(sorted(set(range(33, 127)) - set(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:'\"()-?!")))


def _level(name: bytes, share: float) -> bytes:
    return b"%b=%d" % (name, min(9, int(10 * share)))


def features(text: bytes) -> np.ndarray:
    """The distinct hashed features of a text: its words, and how it is made up in tenths."""
    words = text.split()
    n = max(1, len(words))
    lower = text.lower()
    distinct = set(_WORD.findall(lower))
    size = max(1, len(text))
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    made_up = [
        b"bias",
        _level(b"symbols", (len(text) - len(text.translate(None, _SYMBOLS))) / n),
        _level(b"exclamations", text.count(b"!") / n),
        _level(b"upper", 2 * upper / size),
        _level(b"fresh", len(set(words)) / n),
        _level(b"bars", text.count(b"|") / n),
        b"long=%d" % min(20, n.bit_length()),
    ]
    keys = list(distinct)
    hashed = np.fromiter(map(xxh32_intdigest, keys, repeat(1)), np.int64, len(keys)) % (BUCKETS - 1024)
    fixed = np.fromiter((BUCKETS - 1024 + xxh32_intdigest(m, 2) % 1024 for m in made_up), np.int64, len(made_up))
    return np.unique(np.concatenate([hashed, fixed]))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum())

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... as columns."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -500, 500)))


def train(rows: list[np.ndarray], grades: np.ndarray, seed: int = 11) -> Model:
    """Fit weights and thresholds by adaptive proximal gradient steps on the log-likelihood.

    Without rated texts every text gets grade probabilities of one half.
    """
    top = max(1, int(grades.max())) if len(grades) else 1
    if len(rows):
        common = np.bincount(np.concatenate(rows), minlength=BUCKETS) >= LEAST_TEXTS
        rows = [x[common[x]] for x in rows]
    weights, seen = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
    # thresholds start where the shares of the grades put them
    above = np.array([(grades >= k).mean() if len(grades) else 0.5 for k in range(1, top + 1)])
    thresholds = np.maximum.accumulate(-np.log(np.clip(above, 1e-3, 1 - 1e-3) / np.clip(1 - above, 1e-3, 1)))
    thresholds = thresholds + np.arange(top) * 1e-3
    cut_seen = np.full(top, 1e-8)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS if len(rows) else 0):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            own = [rows[i] for i in part]
            flat = np.concatenate(own)
            which = np.repeat(np.arange(len(part)), [len(x) for x in own])
            score = np.bincount(which, weights[flat], len(part))
            y = grades[part]
            upper = np.concatenate([np.ones((len(part), 1)), _sigmoid(score[:, None] - thresholds), np.zeros((len(part), 1))], axis=1)
            rows_at = np.arange(len(part))
            hi, lo = upper[rows_at, y], upper[rows_at, y + 1]
            p = np.maximum(hi - lo, 1e-9)
            slope_hi, slope_lo = hi * (1 - hi), lo * (1 - lo)
            by_score = -(slope_hi - slope_lo) / p / len(part)
            by_cut = np.zeros(top + 2)
            np.add.at(by_cut, y, slope_hi / p / len(part))
            np.add.at(by_cut, y + 1, -slope_lo / p / len(part))
            touched, inverse = np.unique(flat, return_inverse=True)
            slope = np.bincount(inverse, by_score[which])
            seen[touched] += slope**2
            step = RATE / np.sqrt(seen[touched])
            moved = weights[touched] - step * slope
            weights[touched] = np.sign(moved) * np.maximum(np.abs(moved) - step * LASSO, 0)
            own_cut = by_cut[1 : top + 1]
            cut_seen += own_cut**2
            thresholds = np.maximum.accumulate(thresholds - RATE / np.sqrt(cut_seen) * own_cut + np.arange(top) * 1e-9)
    return Model(weights, thresholds)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(docs: DataFrame, ratings: DataFrame, text: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Train on at most `sample` rated documents. ratings: (id, grade), grades 0, 1, 2, ...

    Several ratings of an id count as their smallest; null ids and grades are left out.
    Only features of the sampled texts come to the driver.
    """
    rated = ratings.toDF("rated", "grade").where("rated is not null and grade is not null")
    rated = rated.groupBy("rated").agg(F.min("grade").cast("int").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("rated"), "rated").limit(sample)
    own = docs.select(F.col(f"`{id_col}`").alias("rated"), F.col(f"`{text}`").alias("words"))
    own = own.join(chosen, "rated").select("rated", "grade", "words")

    def make():
        def work(texts: list[bytes]) -> list[pa.Array]:
            return [pa.array([features(t).astype("<i4").tobytes() for t in texts], pa.binary())]

        return work

    found = map_texts(own, "words", [T.StructField("found", T.BinaryType())], make).drop("words")
    # rows that repeat an id are one training text
    got = found.groupBy("rated").agg(F.min("grade").alias("grade"), F.min("found").alias("found")).orderBy("rated").toArrow()
    rows = [np.frombuffer(x.as_py(), "<i4") for x in got.column("found")]
    return train(rows, got.column("grade").to_numpy())


def grade(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs plus expected_grade and tails, the array of P(grade >= k) for k = 1, 2, ..."""
    spark = docs.sparkSession
    # a fixed size: BUCKETS weights, whatever the data
    shared = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    def make():
        weights, thresholds = shared.value
        own = Model(weights, thresholds)

        def work(texts: list[bytes]) -> list[pa.Array]:
            tails = own.tails(np.array([own.score(features(t)) for t in texts]))
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(texts) + 1) * tails.shape[1], pa.int32()), pa.array(tails.ravel())
            )
            return [pa.array(tails.sum(axis=1)), lists]

        return work

    fields = [T.StructField("expected_grade", T.DoubleType()), T.StructField("tails", T.ArrayType(T.DoubleType()))]
    return map_texts(docs, text, fields, make)


def kept(least_grade: int = 2, least: float = 0.5) -> Column:
    """Selection: whether the tail probability of `least_grade` suffices."""
    reached = F.try_element_at("tails", F.lit(least_grade))
    return F.coalesce(reached >= least, F.lit(False))


def ratings_of(labels: DataFrame) -> DataFrame:
    """(id, grade) of the labels table: 0 toxic, 1 of low quality, 2 else."""
    rating = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    return labels.select("doc_id", F.when(F.col("toxic").isNotNull() & F.col("quality").isNotNull(), rating))
