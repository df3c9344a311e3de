"""Document fingerprints: a canonical exact digest.

Texts are put into one form (Unicode NFKC, case folding, white space folded to single spaces and
trimmed) and digested with 128-bit xxhash. Documents with equal digests form a bucket; within it
the canonical bytes are compared, so that a collision can't make two texts one: a bucket whose
smallest and largest canonical forms differ is split by the forms' SHA-256.

Edge cases: a null text counts as empty; equal and repeated texts share a fingerprint; texts of any
length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import inner, stored

#: Stands for a null doc_id in the order.
NO_ID = -(1 << 63)
#: Rows of a range of doc_id: all but its last, and the two that may meet another range.
INSIDE, FIRST, LAST = 0, 1, 2


def canonical(text: str | None) -> bytes:
    if not text:
        return b""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


def digest(form: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(form)


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of every row, collisions told apart by bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([digest(canonical(t)) for t in texts], pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def collisions(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The fingerprints that stand for several canonical texts: none, unless xxhash collides.

    Canonical bytes are compared within each bucket of several rows: all are equal exactly if the
    smallest and the largest are. Both are gathered with partial aggregation, so a bucket of any
    number of copies sends one pair of texts from each task.
    """
    several = found.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select(F.col("fingerprint").alias("_fp"))
    ids = found.join(several, F.col("fingerprint") == F.col("_fp"), "left_semi").select(F.col("doc_id").alias("_id")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        smallest: dict[str, bytes] = {}
        for b in batches:
            forms = [canonical(t) for t in b.column("text").to_pylist()]
            keys = [digest(f) for f in forms]
            send = []
            for k, f in zip(keys, forms, strict=True):  # a form that this task has sent already needn't go again
                send.append(smallest.get(k) != f)
                if k not in smallest and len(smallest) < 2000:
                    smallest[k] = f
            yield pa.RecordBatch.from_arrays([pa.array([k for k, s in zip(keys, send, strict=True) if s], pa.string()), pa.array([f for f, s in zip(forms, send, strict=True) if s], pa.binary())], names=["fingerprint", "form"])

    members = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    forms = members.select("text").mapInArrow(run, "fingerprint string, form binary")
    return forms.groupBy("fingerprint").agg(F.min("form").alias("lo"), F.max("form").alias("hi")).where("lo != hi").select("fingerprint")


def with_next(documents: DataFrame, function, schema: str, rows: int = 4000) -> DataFrame:
    """Apply function(list of (doc_id, text, next text)) -> RecordBatch to all rows in descending doc_id order; after the last comes the first.

    Rows are dealt out by ranges of doc_id, about one for so many rows, and stream through their task
    in order. A range's last row can't see the next range's first: of each range these two rows are
    written out as well, and a small join pairs them up. Only the ids of those rows are ever sorted
    in one place, two for each range.
    """
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = docs.count()
    if not n:
        return documents.sparkSession.createDataFrame([], schema)
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    laid = docs.repartitionByRange(-(-n // rows), F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id"), "text")
    edge, edge_id, edge_text = inner("edge"), inner("doc"), inner("text")
    names = [*kinds.names, edge, edge_id, edge_text]

    def inside(found: list) -> pa.RecordBatch:
        own = function(found)
        k = own.num_rows
        return pa.RecordBatch.from_arrays([*own.columns, pa.array([INSIDE] * k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.string())], names=names)

    def at_edge(kind: int, doc: int, text: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.nulls(1, f.type) for f in kinds], pa.array([kind], pa.int32()), pa.array([doc], pa.int64()), pa.array([text], pa.string())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # the row whose next text isn't known yet
        out: list = []
        size = 0
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if waiting is None:
                    yield at_edge(FIRST, doc, text)
                else:
                    out.append((*waiting, text))
                    size += len(text)
                waiting = (doc, text)
                if size > 4_000_000:
                    yield inside(out)
                    out, size = [], 0
        if out:
            yield inside(out)
        if waiting is not None:
            yield at_edge(LAST, *waiting)

    def run_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield function(list(zip(*(c.to_pylist() for c in b.columns), strict=True)))

    step = stored(laid.mapInArrow(run, f"{schema}, {edge} int, {edge_id} long, {edge_text} string"), "ranges")
    # In order, each range's first row stands before its last, and the next range's first row after that.
    ids = step.where(F.col(edge) != INSIDE).select(edge, edge_id)
    after = F.coalesce(F.lead(edge_id).over(Window.orderBy(F.desc(edge_id), edge)), F.max(edge_id).over(Window.partitionBy()))
    links = ids.select(edge, edge_id, after.alias(inner("after"))).where(F.col(edge) == LAST).select(F.col(edge_id).alias(inner("last")), inner("after"))
    firsts = step.where(F.col(edge) == FIRST).select(F.col(edge_id).alias(inner("after")), F.col(edge_text).alias(inner("next")))
    lasts = step.where(F.col(edge) == LAST).select(F.col(edge_id).alias(inner("last")), edge_text)
    pairs = lasts.join(links, inner("last")).join(firsts, inner("after")).select(inner("last"), edge_text, inner("next"))
    ends = stored(pairs.mapInArrow(run_edges, schema), "range-ends")
    return step.where(F.col(edge) == INSIDE).select(*kinds.names).unionByName(ends)


def edited(text: str, after: str) -> str:
    """The last half of the code points replaced by the first as many of the next document."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def edit_likeness(documents: DataFrame) -> DataFrame:
    """Fingerprints of each document and its edited text, and likeness to the edited and the next text: 1 if the canonical bytes agree, else 0."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def measured(clash: frozenset) -> DataFrame:
        def mark(form: bytes) -> str:
            key = digest(form)
            return f"{key}-{hashlib.sha256(form).hexdigest()}" if key in clash else key

        def measure(rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in range(7)]
            for doc, text, after in rows:
                new = edited(text, after)
                a, b, c = canonical(text), canonical(new), canonical(after)
                own = (None if doc == NO_ID else doc, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), mark(a), mark(b), float(a == b), float(a == c))
                for col, v in zip(cols, own, strict=True):
                    col.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

        return with_next(documents, measure, schema)

    found = measured(frozenset())
    # Expected to be empty: two different texts with one 128-bit digest.
    clash = frozenset(r[0] for r in collisions(documents, found.select("doc_id", "fingerprint")).collect())
    return measured(clash) if clash else found
