"""Toxicity: a linear-chain CRF tags toxic spans; marginals aggregate to document scores and offsets.

Only documents carry labels, so word labels are derived from them: words that occur in many
toxic and almost no clean training documents seed the toxic tag, every word of a clean document
is clean, and a second round relabels toxic documents with the first model's marginals. The
document score is a logistic function of the marginals' sum, maximum and share.

Edge cases: null or empty texts score like a document without toxic words and have no spans;
texts of any length are read whole; repeated rows give repeated results; an empty table gives
an empty result; without labelled rows all scores are 0, and where all labels agree all scores are that label.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, fold
from .crf import CRF, hashed

BUCKETS = 1 << 17
#: Labelled documents of each class that the model is fitted on, at most (about).
TOXIC_ROWS, CLEAN_ROWS = 900, 1800
#: Words that go through forward-backward together.
BATCH_WORDS = 200_000
_WORD = re.compile(r"\S+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def features(word: str) -> list[int]:
    """Hashed identity, affixes and letter-shape features of a lower-case word."""
    w = _EDGE.sub("", word)
    if not w:
        return [0]
    out = ["=" + w, "#" + str(min(len(w), 9)), "$" + w[-3:]]
    out += ["^" + w[:k] for k in (3, 4, 5, 6) if len(w) >= k]
    return [0] + [hashed(x, BUCKETS - 1) + 1 for x in out]


def summary(p: np.ndarray) -> list[float]:
    """Document features of the toxic marginals of its words."""
    if not len(p):
        return [1.0, 0.0, 0.0, 0.0]
    total = float(p.sum())
    return [1.0, float(np.log1p(total)), float(p.max()), total / len(p)]


class ToxicityModel:
    """A fitted tagger with its document-level calibration."""

    def __init__(self, crf: CRF, weights: np.ndarray, constant: float | None = None):
        self.crf, self.weights, self.constant = crf, weights, constant

    def document_score(self, p: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.weights, summary(p)), -30, 30))))

    def tag(self, texts: list[str | None]) -> list[np.ndarray]:
        """Toxic marginals of the words of each text."""
        out: list[np.ndarray] = []
        words: list[str] = []
        lengths: list[int] = []

        def flush() -> None:
            p = self.crf.marginals(words, np.array(lengths))[:, 1] if words else np.zeros(0)
            out.extend(np.split(p, np.cumsum(lengths)[:-1]) if lengths else [])
            words.clear()
            lengths.clear()

        for text in texts:
            own = (text or "").lower().split()
            words += own
            lengths.append(len(own))
            if len(words) >= BATCH_WORDS:
                flush()
        flush()
        return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps, classes weighed equally."""
    w = np.zeros(x.shape[1])
    share = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (share * (y - p)) - ridge * w
        h = (x * (share * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(h, g), -2, 2)
    return w


def _stems(word: str) -> set[str]:
    """A word without signs at its edges, and its first five letters as a stem."""
    w = _EDGE.sub("", word)
    return {w, "^" + w[:5]} - {"", "^"} if len(w) > 5 else {w} - {""}


def seed_words(texts: list[str], toxic: list[int], least: int = 4, ratio: float = 12.0) -> set[str]:
    """Words and stems in at least `least` toxic documents whose document rate there is `ratio` times the clean one."""
    bad, good = Counter(), Counter()
    for text, y in zip(texts, toxic, strict=True):
        (bad if y else good).update(set().union(*map(_stems, set(text.lower().split()))))
    nb, ng = max(1, sum(toxic)), max(1, len(toxic) - sum(toxic))
    return {w for w, n in bad.items() if n >= least + w.startswith("^") and n / nb >= ratio * (good[w] + 0.5) / ng}


def fit(texts: list[str], toxic: list[int]) -> ToxicityModel:
    """Fit on whole labelled texts; see the module's docstring."""
    crf = CRF(["clean", "toxic"], BUCKETS, features)
    if not 0 < sum(toxic) < len(toxic):
        return ToxicityModel(crf, np.zeros(4), float(bool(toxic) and sum(toxic) > 0))
    seeds = seed_words(texts, toxic)
    words = [t.lower().split() for t in texts]
    tags = [[int(bool(y) and not seeds.isdisjoint(_stems(w))) for w in ws] for ws, y in zip(words, toxic, strict=True)]
    crf.fit(list(zip(words, tags, strict=True)), rounds=14, rate=0.4)
    model = ToxicityModel(crf, np.zeros(4))
    p = model.tag(texts)
    tags = [[int(bool(y) and (a or q > 0.5)) for a, q in zip(ts, ps, strict=True)] for ts, ps, y in zip(tags, p, toxic, strict=True)]
    again = CRF(["clean", "toxic"], BUCKETS, features)
    again.fit(list(zip(words, tags, strict=True)), rounds=16, rate=0.4)
    model = ToxicityModel(again, np.zeros(4))
    x = np.array([summary(q) for q in model.tag(texts)])
    model.weights = _logistic(x, np.array(toxic, float))
    return model


def labelled_sample(documents: DataFrame, labels: DataFrame, toxic_rows: int, clean_rows: int) -> list:
    """(text, toxic) of about so many labelled rows of each class, chosen by a hash of the id over the whole table."""
    own = labels.select("doc_id", F.col("toxic").cast("int").alias("_toxic")).where("_toxic is not null and doc_id is not null")
    n = {r[0]: r[1] for r in own.groupBy("_toxic").count().collect()}
    share = F.xxhash64("doc_id").bitwiseAND((1 << 30) - 1) / float(1 << 30)
    bound = F.when(F.col("_toxic") > 0, toxic_rows / max(1, sum(v for k, v in n.items() if k > 0))).otherwise(clean_rows / max(1, n.get(0, 0)))
    most = 2 * (toxic_rows + clean_rows)
    # About toxic_rows + clean_rows ids, whatever the size of the tables; rows of repeated ids are bounded as well.
    few = own.where(share < bound).select(F.col("doc_id").alias("_id"), "_toxic").distinct().orderBy(F.xxhash64("_id"), "_id", "_toxic").limit(most)
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_toxic")
    return sorted(bounded(rows, most).collect(), key=lambda r: (r.doc_id, r._toxic, r.text))


def train(documents: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> ToxicityModel:
    """Fit on a bounded sample of the labelled rows given."""
    rows = labelled_sample(documents, labels, toxic_rows, clean_rows)
    return fit([r.text or "" for r in rows], [int(r._toxic > 0) for r in rows])


def score(documents: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """Per document: doc_id, score, predicted, and the toxic spans as code point offsets (start, end, p)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, score double, predicted int, spans array<struct<start:int,end:int,p:double>>"
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = part.column("text").to_pylist()
                marginals = m.tag(texts)
                scores = [m.document_score(p) for p in marginals]
                spans = [_spans(t, p, threshold) if len(p) and p.max() >= threshold else [] for t, p in zip(texts, marginals, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(x >= 0.5) for x in scores], pa.int32()), pa.array(spans, spans_type)], names=["doc_id", "score", "predicted", "spans"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _spans(text: str, p: np.ndarray, threshold: float) -> list[dict]:
    """Runs of neighbouring toxic words; lower-casing may change lengths, so offsets are taken from the text itself."""
    at = [m.span() for m in _WORD.finditer(text)]
    out: list[dict] = []
    last = -2
    for i in np.flatnonzero(p >= threshold):
        if i >= len(at):
            break
        if i == last + 1:
            out[-1]["end"], out[-1]["p"] = at[i][1], max(out[-1]["p"], float(p[i]))
        else:
            out.append({"start": at[i][0], "end": at[i][1], "p": float(p[i])})
        last = i
    return out


def toxicity(documents: DataFrame, labels: DataFrame, fold_parts: int = 5, held_out: int = 0) -> DataFrame:
    """Train on the labelled documents outside the held-out fold, then score every document."""
    train_labels = labels.where(fold("doc_id", fold_parts) != held_out)
    model = train(documents, train_labels)
    return score(documents, model).withColumn("held_out", fold("doc_id", fold_parts) == held_out)
