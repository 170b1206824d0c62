"""Ordinal quality classifier: a cumulative-link regression over hashed text.

One weight vector over hashed character trigrams is shared by all grades; grades differ by ordered thresholds, so that
P(grade >= g) = sigmoid(w.x - threshold_g). A document gets its expected grade and its tail probability, by which it is
selected. Fitted on a bounded sample of rated rows, hashed by the executors; every document is scored on its whole text in
one map.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.columns import packed, unpacked
from tablewright.llm.labelled import labelled_sample

#: Rated rows that the model is fitted on at most.
SAMPLE_ROWS = 6_000
#: Trigram buckets, and after them a bucket for each tenth of words that repeat the word before.
TRIGRAMS, TENTHS = 1 << 14, 11
BUCKETS = TRIGRAMS + TENTHS
PENALTY, STEPS = 1e-4, 300
KEEP_GRADE, KEEP_TAIL = 1, 0.5


def hashed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) of a whole text: byte trigrams by a fixed multiplicative hash, of norm 1, and its share of
    words that repeat the word before.
    """
    raw = np.frombuffer(f"  {text} ".encode(), np.uint8).astype(np.uint32)
    trigram = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    counts = np.bincount((trigram * np.uint32(2654435761)) >> np.uint32(18), minlength=TRIGRAMS)
    at = np.flatnonzero(counts)
    weight = np.sqrt(counts[at])
    words = text.split()
    again = sum(map(str.__eq__, words, words[1:])) * 10 // max(1, len(words))
    return np.append(at, TRIGRAMS + again), np.append(weight / np.sqrt((weight * weight).sum()), 1.0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one for each grade from 1

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= g) for g from 1, a column each."""
        return sigmoid(score[:, None] - self.thresholds[None, :])

    def score(self, text: str) -> float:
        at, weight = hashed(text)
        return float(weight @ self.weights[at])


Hashed = tuple[np.ndarray, np.ndarray]


@dataclass
class Design:
    """Hashed texts end to end: buckets, values, where each text starts, and the text of each entry."""

    flat: np.ndarray
    value: np.ndarray
    starts: np.ndarray
    row_of: np.ndarray

    @classmethod
    def of(cls, rows: list[Hashed]) -> Design:
        sizes = [len(a) for a, _ in rows]
        return cls(np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows]), np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(rows)), sizes))


def likelihood(theta: np.ndarray, x: Design, grades: np.ndarray, penalty: float = PENALTY) -> tuple[float, np.ndarray]:
    """Mean log likelihood of cumulative links less the penalty on the weights, and its gradient.

    ``theta`` holds the weights, the first threshold and the logs of the gaps between thresholds.
    """
    w, gaps = theta[:BUCKETS], np.exp(theta[BUCKETS + 1 :])
    cut = theta[BUCKETS] + np.concatenate([[0], np.cumsum(gaps)])
    n, levels = len(x.starts), len(cut)
    score = np.add.reduceat(w[x.flat] * x.value, x.starts)
    tail = np.hstack([np.ones((n, 1)), sigmoid(score[:, None] - cut), np.zeros((n, 1))])
    i = np.arange(n)
    upper, lower = tail[i, grades], tail[i, grades + 1]
    p = np.maximum(upper - lower, 1e-12)
    d_upper, d_lower = upper * (1 - upper) / p, lower * (1 - lower) / p
    d_score = d_upper - d_lower
    d_cut = np.zeros((n, levels + 2))
    d_cut[i, grades] -= d_upper
    d_cut[i, grades + 1] += d_lower
    d_cut = d_cut[:, 1:-1].mean(0)
    grad = np.zeros_like(theta)
    grad[:BUCKETS] = np.bincount(x.flat, x.value * d_score[x.row_of], BUCKETS) / n - penalty * w
    grad[BUCKETS] = d_cut.sum()
    grad[BUCKETS + 1 :] = np.cumsum(d_cut[::-1])[::-1][1:] * gaps
    return float(np.log(p).mean() - penalty * (w @ w) / 2), grad


def fit(rows: list[Hashed], grades: np.ndarray, levels: int, steps: int = STEPS, penalty: float = PENALTY) -> Ordinal:
    """Adam on the penalised likelihood of cumulative links of hashed texts. Thresholds are a first one and positive gaps.

    Without rows, the weights stay 0 and the thresholds split evenly. A grade that never occurs closes up to its neighbour.
    """
    thresholds = np.linspace(-1, 1, levels) if levels > 1 else np.zeros(1)
    if not len(rows):
        return Ordinal(np.zeros(BUCKETS), thresholds)
    x = Design.of(rows)
    theta = np.concatenate([np.zeros(BUCKETS), thresholds[:1], np.log(np.diff(thresholds))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        _, grad = likelihood(theta, x, grades, penalty)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        theta[BUCKETS + 1 :] = np.maximum(theta[BUCKETS + 1 :], -6.0)
    return Ordinal(theta[:BUCKETS], theta[BUCKETS] + np.concatenate([[0], np.cumsum(np.exp(theta[BUCKETS + 1 :]))]))


def fit_on(docs: DataFrame, labels: DataFrame, grade: Column, levels: int, sample_rows: int = SAMPLE_ROWS) -> Ordinal:
    """Fits on at most ``sample_rows`` rated documents; ``grade`` is 0 to ``levels``.

    Texts are hashed where they lie; the driver gets at most ``BUCKETS`` numbers of a text, however long that is.
    """

    @F.pandas_udf("at array<int>, weight array<float>")
    def hash_texts(texts: pd.Series) -> pd.DataFrame:
        pairs = [hashed(t) for t in texts]
        return pd.DataFrame({"at": [a.astype(np.int32) for a, _ in pairs], "weight": [w.astype(np.float32) for _, w in pairs]})

    sample = labelled_sample(docs, labels, grade, sample_rows).select(hash_texts("text").alias("h"), "grade")
    rows: list[Hashed] = []
    grades: list[int] = []
    for row in sample.toLocalIterator():
        rows.append((np.array(row.h["at"], np.int32), np.array(row.h["weight"], np.float32)))
        grades.append(min(max(row.grade, 0), levels))
    return fit(rows, np.array(grades, dtype=int), levels)


def score_documents(docs: DataFrame, model: Ordinal, keep_grade: int = KEEP_GRADE, keep_tail: float = KEEP_TAIL) -> DataFrame:
    """``docs`` with expected_grade, tail (P(grade >= keep_grade)) and quality_kept (tail >= keep_tail).

    Null and empty texts are scored as the empty text, very long ones whole. All columns and rows of ``docs`` stay, repeated
    rows too, and an empty table gives none. Where ``docs`` has a column named like an output, that output has an underscore
    after its name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("expected_grade double, tail double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            tails = own.tails(np.array([own.score(t or "") for t in texts], dtype=float))
            yield pd.DataFrame({"expected_grade": tails.sum(1), "tail": tails[:, keep_grade - 1]})

    out = packed(docs, scored(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("scored"))
    return unpacked(out, docs.columns, expected_grade=F.col("scored.expected_grade"), tail=F.col("scored.tail"), quality_kept=F.col("scored.tail") >= keep_tail)


def rating() -> Column:
    """The labels table's rating: 0 poor, 1 sound but toxic, 2 sound; null without a quality label."""
    return F.when(F.col("quality") <= 0, 0).when(F.col("quality").isNull(), None).when(F.coalesce("toxic", F.lit(0)) >= 1, 1).otherwise(2)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` scored by a model of the labels' rating; see ``score_documents``. Without labels every document is kept."""
    return score_documents(docs, fit_on(docs, labels, rating(), 2))


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probability and selection of every row of ``documents``."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs.select("doc_id", "text"), labels).select("doc_id", "expected_grade", "tail", F.col("quality_kept").alias("kept"))
