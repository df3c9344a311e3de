"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

A table hashes a unit vector by fast Hadamard pseudo-rotations (three rounds of random signs and a
Hadamard transform): the nearest signed axis of each of several rotations is its bucket. The number
of rotations, and the last one's width, follow the number of vectors, so that buckets stay small. A
query probes every bucket whose penalty (the sum over rotations of the squared differences between
its largest coordinate and the one on the bucket's axis) is within a radius. The radius is fitted on
SAMPLE queries, whose true neighbours an exact pass over all vectors finds: it is the one by which
GOAL of those are reached. Candidates are ranked by their exact distances in double precision.

Equal vectors are one candidate with their smallest ids, of which a query needs no more than asked
for, and one search answers all queries of equal vectors: groups of copies cost nothing, whatever
their size. Work is dealt in blocks of a table and an axis of its first rotation; blocks with many
vectors or queries are cut on both sides into grids of bounded parts.

Edge cases: rows without an id, and vectors that are null, empty, zero, hold null or non-finite
components or are of another length than most (of lengths equally frequent the longest counts) take
no part. Rows are told apart by vec_id and vector: repeated rows count once, a query's own are the
rows of its id. Ties go to the smaller vec_id. Queries that probing gives too few neighbours search
all vectors. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

TABLES = 8
#: Vectors for each bucket on average, about.
FILL = 4
#: Queries that the radius is fitted on, and the share of their neighbours that it is to reach.
SAMPLE, GOAL = 200, 0.965
#: Vectors and queries of one block.
BLOCK, BLOCK_QUERIES = 50_000, 20_000
#: Pairs whose distances are taken at once.
PAIRS = 40_000


class Rotations:
    """The hash of vectors of so many dimensions into about so many buckets; a rule alone, nothing is stored."""

    def __init__(self, dims: int, buckets: float, tables: int = TABLES, seed: int = 7):
        self.dims, self.tables = dims, tables
        self.size = 1 << max(1, (dims - 1).bit_length())
        self.widths = [self.size]
        while buckets > (got := float(np.prod([2.0 * w for w in self.widths]))):
            need = int(np.ceil(np.log2(max(2.0, buckets / got))))
            self.widths.append(min(self.size, max(1, 1 << (need - 1))))
            if len(self.widths) == 6:
                break
        rng = np.random.default_rng(seed)
        self.signs = rng.choice(np.array([-1, 1], np.float32), (tables, len(self.widths), 3, self.size))

    def turned(self, vectors: np.ndarray, table: int, number: int) -> np.ndarray:
        """The first coordinates of the rotated unit vectors."""
        v = np.zeros((len(vectors), self.size), np.float32)
        v[:, : self.dims] = vectors / np.sqrt((vectors.astype(float) ** 2).sum(axis=1))[:, None]
        for signs in self.signs[table, number]:
            v *= signs
            step = 1
            while step < self.size:
                w = v.reshape(len(v), -1, 2, step)
                v = np.stack([w[:, :, 0] + w[:, :, 1], w[:, :, 0] - w[:, :, 1]], axis=2).reshape(len(v), -1)
                step *= 2
            v /= np.float32(np.sqrt(self.size))
        return v[:, : self.widths[number]]

    def codes(self, vectors: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """(axis of the first rotation, axes of the others as one number); axis 2 i is coordinate i, 2 i + 1 its negative."""
        out = []
        for number in range(len(self.widths)):
            v = self.turned(vectors, table, number)
            i = np.abs(v).argmax(axis=1)
            out.append(2 * i + (v[np.arange(len(v)), i] < 0))
        rest = np.zeros(len(vectors), np.int64)
        for axis, width in zip(out[1:], self.widths[1:], strict=True):
            rest = rest * 2 * width + axis
        return out[0], rest

    def penalties(self, vectors: np.ndarray, table: int) -> list[np.ndarray]:
        """For each rotation the penalty of every axis."""
        out = []
        for number in range(len(self.widths)):
            v = self.turned(vectors, table, number)
            both = np.stack([v, -v], axis=2).reshape(len(v), -1)
            out.append((both.max(axis=1, keepdims=True) - both) ** 2)
        return out

    def probes(self, vectors: np.ndarray, table: int, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vector, first axis, the other axes as one number) of all buckets within the radius."""
        each = self.penalties(vectors, table)
        who, axis = np.nonzero(each[0] <= radius)
        left, rest = radius - each[0][who, axis], np.zeros(len(who), np.int64)
        for pen in each[1:]:
            own, more = np.nonzero(pen[who] <= left[:, None])
            left, rest, axis = left[own] - pen[who[own], more], rest[own] * pen.shape[1] + more, axis[own]
            who = who[own]
        return who, axis, rest

    def reach(self, queries: np.ndarray, found: np.ndarray) -> np.ndarray:
        """The least radius by which each query reaches the vector beside it, in any table."""
        best = np.full(len(queries), np.inf)
        for table in range(self.tables):
            axis, rest = self.codes(found, table)
            pens = self.penalties(queries, table)
            total = pens[0][np.arange(len(axis)), axis]
            for pen in pens[:0:-1]:
                rest, own = np.divmod(rest, pen.shape[1])
                total = total + pen[np.arange(len(own)), own]
            best = np.minimum(best, total)
        return best


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _ranked(who: np.ndarray, distance: np.ndarray, least: np.ndarray, most: int) -> np.ndarray:
    """Indices of the `most` nearest of each query, by distance and then the smaller id, together for each query."""
    order = np.lexsort((least, distance, who))
    own = who[order]
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, int)
    rank = np.arange(len(own)) - np.repeat(starts, np.diff(np.r_[starts, len(own)]))
    return order[rank < most]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a.astype(float) - b
    return np.sqrt((d * d).sum(axis=1))


def distinct_vectors(embeddings: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(rows: vec_id, rep; vectors: rep, vec, ids): each distinct vector with its `most` smallest ids, and who has it."""
    c = F.col("embedding").cast("array<float>")
    known = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), c.alias("vec"), F.col("embedding").cast("array<double>").alias("wide")).where("vec_id is not null")
    finite = F.forall("wide", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("wide", lambda v: v != 0)
    good = known.where(finite)
    lengths = good.groupBy(F.size("wide").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    # Adding zero makes -0.0 and 0.0 one value.
    rows = good.where(F.size("wide") == (lengths["dims"] if lengths else 0)).select("vec_id", F.transform("wide", lambda v: v + 0.0).alias("vec"))
    first = Window.partitionBy("vec").orderBy("vec_id")
    smallest = rows.distinct().withColumn("nr", F.row_number().over(first)).where(F.col("nr") <= most)
    vectors = smallest.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return rows, stored(vectors.select(F.monotonically_increasing_id().alias("rep"), "vec", "ids"), "vectors")


def _nearest_of_sample(vectors: DataFrame, queries: np.ndarray, reps: list[int], k: int) -> list[tuple[int, list[float]]]:
    """(query number, vector) of each sample query's k nearest other vectors: an exact pass over all, of which each task keeps the best."""
    own = np.array(reps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, dist, held, at = np.zeros(0, int), np.zeros(0), np.zeros((0, queries.shape[1])), np.zeros(0, np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 2_000):
                part = batch.slice(a, 2_000)
                v, rep = _matrix(part.column("vec")), part.column("rep").to_numpy()
                square = (queries**2).sum(axis=1)[:, None] + (v**2).sum(axis=1)[None] - 2 * queries @ v.T
                square[own[:, None] == rep[None]] = np.inf
                near = np.argpartition(square, min(k, len(v)) - 1, axis=1)[:, : min(k, len(v))]
                q = np.repeat(np.arange(len(queries)), near.shape[1])
                ok = np.isfinite(square[q, near.ravel()])
                who, dist = np.r_[who, q[ok]], np.r_[dist, square[q, near.ravel()][ok]]
                held, at = np.r_[held, v[near.ravel()[ok]]], np.r_[at, rep[near.ravel()[ok]]]
                keep = _ranked(who, dist, at, k)
                who, dist, held, at = who[keep], dist[keep], held[keep], at[keep]
        ends = np.arange(len(who) + 1, dtype=np.int32) * queries.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(who, pa.int32()), pa.array(dist), pa.array(at), pa.ListArray.from_arrays(pa.array(ends), pa.array(held.ravel()))], names=["q", "d", "rep", "vec"])

    best = vectors.select("rep", "vec").mapInArrow(run, "q int, d double, rep long, vec array<double>")
    ranked = best.withColumn("nr", F.row_number().over(Window.partitionBy("q").orderBy("d", "rep"))).where(F.col("nr") <= k)
    return [(r["q"], r["vec"]) for r in ranked.select("q", "vec").collect()]


def fit(vectors: DataFrame, queries: DataFrame, k: int, sample: int, goal: float) -> tuple[Rotations, float] | None:
    """The hash for so many vectors, and the radius that reaches the goal on a sample of the queries; None without vectors or queries."""
    n = vectors.count()
    some = queries.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("rep", "vec").collect()
    if not some:
        return None
    asked = np.array([r["vec"] for r in some])
    hashing = Rotations(asked.shape[1], n / FILL)
    found = _nearest_of_sample(vectors, asked, [r["rep"] for r in some], k)
    if not found:
        return hashing, 0.0
    reach = np.sort(hashing.reach(asked[[q for q, _ in found]], np.array([v for _, v in found])))
    return hashing, float(reach[min(len(reach) - 1, int(np.ceil(goal * len(reach))))]) * (1 + 1e-6)


def _hashed(vectors: DataFrame, hashing: Rotations, tables: int, whole: bool) -> DataFrame:
    """cell (table and first axis), rest, rep, vec, ids: every vector in every table; whole: in one cell, without a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 5_000):
                part = batch.slice(a, 5_000)
                v = _matrix(part.column("vec"))
                for table in range(tables):
                    axis, rest = (np.zeros(len(v), np.int64),) * 2 if whole else hashing.codes(v, table)
                    yield pa.RecordBatch.from_arrays([pa.array((axis + table * 2 * hashing.size).astype(np.int64)), pa.array(rest), *(part.column(c) for c in ("rep", "vec", "ids"))], names=["cell", "rest", "rep", "vec", "ids"])

    return vectors.select("rep", "vec", "ids").mapInArrow(run, "cell long, rest long, rep long, vec array<double>, ids array<long>")


def _probing(queries: DataFrame, hashing: Rotations, radius: float, tables: int, whole: bool) -> DataFrame:
    """cell, rep, vec, rest (the probed buckets of the cell, sorted): each query in every cell that it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                v = _matrix(part.column("vec"))
                for table in range(tables):
                    who, axis, rest = (np.arange(len(v)), np.zeros(len(v), int), np.zeros(len(v), np.int64)) if whole else hashing.probes(v, table, radius)
                    order = np.lexsort((rest, axis, who))
                    who, axis, rest = who[order], axis[order], rest[order]
                    starts = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (axis[1:] != axis[:-1])]) if len(who) else np.zeros(0, int)
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(rest)].astype(np.int32)), pa.array(rest))
                    own = part.take(pa.array(who[starts]))
                    yield pa.RecordBatch.from_arrays([pa.array((axis[starts] + table * 2 * hashing.size).astype(np.int64)), own.column("rep"), own.column("vec"), lists], names=["cell", "rep", "vec", "rest"])

    return queries.select("rep", "vec").mapInArrow(run, "cell long, rep long, vec array<double>, rest array<long>")


def _in_block(most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The `most` nearest candidates of each query of a block, from the buckets that it probes."""
    schema = pa.schema([("q", pa.int64()), ("rep", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])

    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        if not index.num_rows or not queries.num_rows:
            return schema.empty_table()
        order = np.argsort(index["rest"].to_numpy(), kind="stable")
        rest = index["rest"].to_numpy()[order]
        v, rep = _matrix(index["vec"].combine_chunks())[order], index["rep"].to_numpy()[order]
        ids = index["ids"].combine_chunks().take(pa.array(order))
        least = ids.values.to_numpy()[ids.offsets.to_numpy()[:-1]]
        asked, q_rep = _matrix(queries["vec"].combine_chunks()), queries["rep"].to_numpy()
        probes = queries["rest"].combine_chunks()
        wanted = probes.flatten().to_numpy()
        who = np.repeat(np.arange(len(q_rep)), np.diff(probes.offsets.to_numpy()))
        lo, hi = np.searchsorted(rest, wanted, "left"), np.searchsorted(rest, wanted, "right")
        some = hi > lo
        who, lo, hi = who[some], lo[some], hi[some]
        upto = np.cumsum(hi - lo)
        best: list[np.ndarray] = [np.zeros(0, int), np.zeros(0, int), np.zeros(0)]
        a = 0
        while a < len(who):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
            n = hi[a:b] - lo[a:b]
            row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[a:b], n)
            asking = np.repeat(who[a:b], n)
            for c in range(0, len(row), PAIRS):  # one large bucket, too, is taken in parts
                r, w = row[c : c + PAIRS], asking[c : c + PAIRS]
                got = [np.r_[x, y] for x, y in zip(best, (w, r, _distances(asked[w], v[r])), strict=True)]
                keep = _ranked(got[0], got[2], least[got[1]], most)
                best = [x[keep] for x in got]
            a = b
        return pa.Table.from_arrays([pa.array(q_rep[best[0]]), pa.array(rep[best[1]]), pa.array(best[2]), ids.take(pa.array(best[1]))], schema=schema)

    return run


def _grid(counts: DataFrame, most: int) -> dict[int, int]:
    """For each cell with more than `most` rows the number of parts: as many entries as tables have axes at most."""
    return {r["cell"]: -(-r["count"] // most) for r in counts.where(F.col("count") > most).collect()}


def _parts(parts: dict[int, int]) -> Column:
    if not parts:
        return F.lit(1)
    return F.coalesce(F.create_map(*[F.lit(x) for p in parts.items() for x in p])[F.col("cell")], F.lit(1))


def _search(vectors: DataFrame, queries: DataFrame, hashing: Rotations, radius: float, most: int, whole: bool = False) -> DataFrame:
    """q, near: the `most` nearest rows (score, vec_id) of each query vector, nearest first, as an array; q is its rep."""
    tables = 1 if whole else hashing.tables
    index, asked = _hashed(vectors, hashing, tables, whole), stored(_probing(queries, hashing, radius, tables, whole), "probes")
    rows = _grid(index.groupBy("cell").count(), BLOCK)
    columns = _grid(asked.groupBy("cell").count(), BLOCK_QUERIES)
    one, every = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    n_rows, n_columns = _parts(rows).cast("int"), _parts(columns).cast("int")
    index = index.withColumn("r", one(n_rows)).withColumn("c", every(n_columns))
    dealt = asked.withColumn("c", one(n_columns)).withColumn("r", every(n_rows))
    block = ["cell", "r", "c"]
    near = index.groupBy(*block).cogroup(dealt.groupBy(*block)).applyInArrow(_in_block(most), "q long, rep long, score double, ids array<long>")
    # The same vector comes from several tables: once is enough. Rows of a query are few for each block.
    once = near.groupBy("q", "rep").agg(F.first("score").alias("score"), F.first("ids").alias("ids"))
    each = once.select("q", "score", F.explode("ids").alias("vec_id"))
    best = each.withColumn("nr", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).where(F.col("nr") <= most)
    return best.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near"))


def nearest(embeddings: DataFrame, query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that `query` selects, among all rows but its own."""
    # One more than asked for: the query's own id may be among them.
    rows, vectors = distinct_vectors(embeddings, k + 1)
    asking = rows.where(query).distinct().join(vectors.select("vec", "rep"), "vec").select(F.col("vec_id").alias("query_id"), "rep")
    asking = stored(asking, "queries")
    asked = stored(vectors.join(asking.select("rep").distinct(), "rep", "left_semi").select("rep", "vec"), "query-vectors")
    fitted = fit(vectors, asked, k, SAMPLE, GOAL)
    if fitted is None:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = stored(_search(vectors, asked, *fitted, k + 1), "near")
    # Too few neighbours, though there are more rows: those queries search all vectors.
    there = vectors.agg(F.sum(F.size("ids")).alias("n")).first()["n"]
    short = asked.join(found.where(F.size("near") >= min(k + 1, there)).select(F.col("q").alias("rep")), "rep", "left_anti")
    if not short.isEmpty():
        more = _search(vectors, short, *fitted, k + 1, whole=True)
        found = stored(found.join(short.select(F.col("rep").alias("q")), "q", "left_anti").unionByName(more), "near-all")
    # A vector's many queries are dealt over SALT tasks, its one row of neighbours is sent to each.
    salt = 16
    far = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    own = asking.withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(salt)).cast("int"))
    joined = own.join(far, (F.col("rep") == F.col("q")) & (own["salt"] == far["salt"]))
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    each = joined.select("query_id", F.posexplode(others).alias("pos", "hit"))
    return each.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")
