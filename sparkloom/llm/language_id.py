"""Language identification: a linear-chain CRF labels words with languages, also in code-switched text.

Word emissions come from affix, character n-gram and lexicon features, label changes from learned
transitions, and forward-backward gives each word's marginals. Training texts carry one language
each, so transitions are learned from sequences spliced from texts of different languages.

Edge cases: null texts and texts without any letter are `und` with score 0; a table without
labelled rows gives `und` throughout; ties between languages go to the one first in order; texts
of any length are read whole; repeated rows give repeated results; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from .common import bounded, fold, release
from .crf import CRF, hashed

BUCKETS = 1 << 17
#: Documents of each language that the model is fitted on, at most (about).
ROWS_PER_LANGUAGE = 250
BATCH_WORDS = 200_000
#: The answer for texts without a language.
NONE = "und"
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def features(word: str) -> list[int]:
    """Hashed identity (lexicon), affixes and trigrams of a lower-case word; words without letters only have a bias."""
    w = _EDGE.sub("", word)
    if not w:
        return [0]
    v = f"<{w}>"
    out = ["=" + w, "^" + w[:2], "$" + w[-2:], "$" + w[-4:]]
    out += [v[i : i + 3] for i in range(len(v) - 2)]
    out += [c for c in set(w) if c > "\x7f"]
    return [hashed(x, BUCKETS - 1) + 1 for x in out]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def fit(texts: list[str], langs: list[str], seed: int = 7) -> CRF | None:
    """Fit on whole texts with one language each, plus sequences spliced from two of them."""
    states = sorted(set(langs))
    if not states:
        return None
    number = {x: i for i, x in enumerate(states)}
    plain = [(w, [number[y]] * len(w)) for t, y in zip(texts, langs, strict=True) if (w := t.lower().split())]
    rng = np.random.default_rng(seed)
    mixed = []
    for i in rng.permutation(len(plain))[: len(plain) // 3]:
        (a, ya), (b, yb) = plain[i], plain[int(rng.integers(len(plain)))]
        if ya[0] == yb[0]:
            continue
        k, n = int(rng.integers(1, len(a) + 1)), int(rng.integers(3, 40))
        j = int(rng.integers(0, len(b)))
        a, ya = a[max(0, k - 60) : k + 60], ya[max(0, k - 60) : k + 60]
        k = len(a) // 2
        mixed.append((a[:k] + b[j : j + n] + a[k:], ya[:k] + yb[j : j + n] + ya[k:]))
    return CRF(states, BUCKETS, features).fit(plain + mixed, rounds=14, rate=0.4)


def train(documents: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> CRF | None:
    """Fit on about so many rows of each language (twice as many at most), chosen by a hash of id and text over the whole table."""
    own = documents.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    counts = {r[0]: r[1] for r in own.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.xxhash64("doc_id", "text").bitwiseAND((1 << 30) - 1) / float(1 << 30)
    bound = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        bound = F.when(F.col("lang") == lang, rows_per_language / n).otherwise(bound)
    some = bounded(own.where(share < bound), 2 * rows_per_language * len(counts))
    rows = sorted(some.collect(), key=lambda r: (r.doc_id if r.doc_id is not None else -1, r.text))
    return fit([r.text for r in rows], [r.lang for r in rows])


def predict(documents: DataFrame, model: CRF | None, keep: list[str] | None = None, names: tuple[str, str, str] = ("lang_pred", "score", "words_by_lang")) -> DataFrame:
    """doc_id and, as names say, the language, its score and the expected words of each language; `keep` names columns to carry along instead of doc_id."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    states = model.states if model else []
    kept = documents.select(*([F.col(f"`{c}`") for c in keep] if keep else [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]))
    fields = [f for f in kept.schema.fields if keep or f.name == "doc_id"]
    schema = StructType([*fields, *[StructField(n, k) for n, k in zip(names, (StringType(), DoubleType(), ArrayType(DoubleType())), strict=True)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                found = label(crf, states, part.column("text").cast(pa.string()).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(f.name) for f in fields] + [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.list_(pa.float64()))],
                    names=[*[f.name for f in fields], *names],
                )
        release()

    return kept.mapInArrow(run, schema)


def label(crf: CRF | None, states: list[str], texts: list[str | None]) -> list[tuple[str, float, list[float]]]:
    """(language, share of the words with letters, expected words of each language) of each text."""
    if not states:
        return [(NONE, 0.0, [])] * len(texts)
    out: list[tuple[str, float, list[float]]] = []
    words: list[str] = []
    lengths: list[int] = []

    def flush() -> None:
        if not lengths:
            return
        p = crf.marginals(words, np.array(lengths)) if words else np.zeros((0, len(states)))
        weight = np.array([w.isalpha() or any(map(str.isalpha, w)) for w in words], float)
        sums = np.concatenate([np.zeros((1, len(states))), np.cumsum(p * weight[:, None], axis=0)])
        ends = np.cumsum(lengths)
        for total in sums[ends] - sums[ends - np.array(lengths)]:
            best = int(total.argmax())
            all_words = total.sum()
            out.append((NONE, 0.0, []) if all_words <= 0 else (states[best], min(1.0, float(total[best] / all_words)), total.tolist()))
        words.clear()
        lengths.clear()

    for text in texts:
        own = text.lower().split() if has_letter(text) else []
        words += own
        lengths.append(len(own))
        if len(words) >= BATCH_WORDS:
            flush()
    flush()
    return out


def language_id(documents: DataFrame, fold_parts: int = 4, held_out: int = 2) -> DataFrame:
    """Train on the labelled documents outside the held-out fold, then predict every document."""
    model = train(documents.where(fold("doc_id", fold_parts) != held_out))
    return predict(documents, model).withColumn("held_out", fold("doc_id", fold_parts) == held_out)
