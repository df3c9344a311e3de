"""Quality classifier: ordinal cumulative-link regression on graded ratings.

All grades share one weight for each hashed text feature (words, word shapes, repetition and
length); ordered thresholds cut the score into grades: P(grade >= k) = sigmoid(x.w - t_k). The
thresholds' order is kept by learning the logarithms of their gaps. Besides the tail probabilities,
their sum over the lowest grade gives the expected grade.

Edge cases: null and empty texts have their own feature and are rated like any other; with one
grade only (or no ratings) every document gets that grade (or 0); repeated rows give repeated
results; empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, fold
from .crf import hashed

BUCKETS = 1 << 16
#: Rated documents that the model is fitted on, at most (about).
ROWS = 3000


def shape(word: str) -> str:
    """A word's outline: runs of capitals, small letters and digits as one sign each."""
    out = []
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


class Features:
    """Hashed, length-normalised features of a text; words' buckets are kept until the cache is full."""

    def __init__(self, cache: int = 300_000):
        self.cache, self.known = cache, {}

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").split()
        if not words:
            return np.array([0]), np.array([1.0])
        counts = Counter(words)
        known = self.known
        if len(known) > self.cache:
            known.clear()
        idx: list[int] = []
        for w in counts:
            k = known.get(w)
            if k is None:
                k = known[w] = (hashed("w" + w.lower(), BUCKETS - 1) + 1, hashed("s" + shape(w), BUCKETS - 1) + 1)
            idx += k
        tf = np.fromiter(counts.values(), float, len(counts))
        value = np.stack([np.log1p(tf) / np.sqrt(len(counts)) / 2, tf / len(words)], axis=1).reshape(-1)
        extra = ["n" + str(int(np.log2(len(words)))), "r" + str(int(10 * len(counts) / len(words))), "t" + str(int(20 * tf.max() / len(words)))]
        return np.array(idx + [hashed(x, BUCKETS - 1) + 1 for x in extra]), np.concatenate([value, np.full(len(extra), 0.5)])


class OrdinalModel:
    def __init__(self, grades: list[float], weights: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.thresholds = grades, weights.astype(np.float32), thresholds

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each grade but the lowest."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -35, 35)))


def fit(texts: list[str], ratings: list[float], rounds: int = 120, rate: float = 0.15, decay: float = 2e-4) -> OrdinalModel:
    """Full-batch Adam on the cumulative-link likelihood."""
    grades = sorted(set(ratings))
    if len(grades) < 2:
        return OrdinalModel(grades or [0.0], np.zeros(BUCKETS), np.zeros(0))
    features = Features()
    each = [features.of(t) for t in texts]
    doc = np.repeat(np.arange(len(each)), [len(i) for i, _ in each])
    idx, val = np.concatenate([i for i, _ in each]), np.concatenate([v for _, v in each])
    y = np.searchsorted(grades, ratings)
    k = len(grades) - 1
    above = (y[:, None] > np.arange(k)).astype(float)
    # Each grade weighs the same in all.
    share = 1 / np.bincount(y, minlength=k + 1)[y] / (k + 1)
    w, t = np.zeros(BUCKETS), np.concatenate([[0.0], np.zeros(k - 1)])
    m, v = [np.zeros_like(w), np.zeros_like(t)], [np.zeros_like(w), np.zeros_like(t)]
    for step in range(1, rounds + 1):
        cuts = np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))
        s = np.bincount(doc, weights=w[idx] * val, minlength=len(each))
        # Likelihood of the interval between two thresholds, by its derivative in score and thresholds.
        p = 1 / (1 + np.exp(-np.clip(s[:, None] - cuts, -35, 35)))
        full = np.concatenate([np.ones((len(s), 1)), p, np.zeros((len(s), 1))], axis=1)
        rows = np.arange(len(s))
        mass = np.maximum(full[rows, y] - full[rows, y + 1], 1e-12)
        slope = full * (1 - full)
        gs = share * (slope[rows, y] - slope[rows, y + 1]) / mass
        gc = np.zeros(k + 2)
        np.add.at(gc, y, -share * slope[rows, y] / mass)
        np.add.at(gc, y + 1, share * slope[rows, y + 1] / mass)
        gc = gc[1:-1]
        tail = np.cumsum(gc[::-1])[::-1]
        grads = [np.bincount(idx, weights=gs[doc] * val, minlength=BUCKETS) - decay * w, np.concatenate([tail[:1], tail[1:] * np.exp(t[1:])])]
        for i, (x, g) in enumerate(zip((w, t), grads, strict=True)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            x += rate * (1 - step / (rounds + 1)) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return OrdinalModel(grades, w, np.cumsum(np.concatenate([t[:1], np.exp(t[1:])])))


def train(documents: DataFrame, ratings: DataFrame, rating: str = "quality", rows: int = ROWS) -> OrdinalModel:
    """Fit on about so many rated rows, chosen by a hash of the id over the whole table."""
    own = ratings.select(F.col("doc_id").alias("_id"), F.col(rating).cast("double").alias("_grade")).where("_grade is not null and doc_id is not null")
    counts = {r[0]: r[1] for r in own.groupBy("_grade").count().collect()}
    most = 2 * rows
    share = F.xxhash64("_id").bitwiseAND((1 << 30) - 1) / float(1 << 30)
    bound = F.lit(0.0)
    for g, n in sorted(counts.items()):
        bound = F.when(F.col("_grade") == g, rows / len(counts) / n).otherwise(bound)
    few = own.where(share < bound).distinct().orderBy(F.xxhash64("_id"), "_id", "_grade").limit(most)
    found = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_grade")
    found = sorted(bounded(found, most).collect(), key=lambda r: (r.doc_id, r._grade, r.text))
    return fit([r.text or "" for r in found], [r._grade for r in found])


def score(documents: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, expected_grade, tails (P(grade >= k) for each grade but the lowest), top_tail, predicted (the likeliest grade)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, expected_grade double, tails array<double>, top_tail double, predicted double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, features = shared.value, Features()
        grades = np.array(m.grades)
        for batch in batches:
            each = [features.of(t) for t in batch.column("text").to_pylist()]
            s = np.array([float(np.dot(m.weights[i], v)) for i, v in each])
            tails = m.tails(s) if len(s) else np.zeros((0, len(grades) - 1))
            expected = grades[0] + tails @ np.diff(grades)
            full = np.concatenate([np.ones((len(s), 1)), tails, np.zeros((len(s), 1))], axis=1)
            best = grades[(full[:, :-1] - full[:, 1:]).argmax(axis=1)]
            top = tails[:, -1] if tails.shape[1] else np.ones(len(s))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(expected), pa.array(tails.tolist(), pa.list_(pa.float64())), pa.array(top), pa.array(best, pa.float64())], names=[x.split()[0] for x in schema.split(", ")])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def quality(documents: DataFrame, labels: DataFrame, fold_parts: int = 5, held_out: int = 0) -> DataFrame:
    """Train on the rated documents outside the held-out fold, then score every document."""
    model = train(documents, labels.where(fold("doc_id", fold_parts) != held_out))
    return score(documents, model).withColumn("held_out", fold("doc_id", fold_parts) == held_out)
