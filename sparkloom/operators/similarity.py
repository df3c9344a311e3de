"""Vector and text similarity: cosine, pairs by edit distance from a segment index, density clusters by pivots."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .storage import stored


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def token_counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, n): words of each text with their numbers."""
    return texts.select(key, F.explode(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))


def sparse_cosine(counts: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """pairs(a, b) with the cosine of their token counts: joined on shared tokens of the pairs given only."""
    norms = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    x = counts.select(F.col(key).alias("a"), "token", F.col("n").alias("na"))
    y = counts.select(F.col(key).alias("b"), "token", F.col("n").alias("nb"))
    inner = pairs.join(x, "a").join(y, ["b", "token"]).groupBy("a", "b").agg(F.sum(F.col("na") * F.col("nb")).alias("dot"))
    full = pairs.join(inner, ["a", "b"], "left").join(norms.select(F.col(key).alias("a"), F.col("norm").alias("norm_a")), "a", "left").join(norms.select(F.col(key).alias("b"), F.col("norm").alias("norm_b")), "b", "left")
    return full.select("a", "b", F.coalesce(F.col("dot") / (F.col("norm_a") * F.col("norm_b")), F.lit(0.0)).alias("cosine"))


def _banded(texts: DataFrame, key: str, text: str, rate: float, within: list[str]) -> DataFrame:
    """Candidate pairs of texts whose lengths allow the rate: for rates of 50 and less, where edits can hit every part of a text."""
    n = F.greatest(F.length(text), F.lit(1))
    grown = texts.withColumn("_band", F.floor(F.log(n) / F.log(F.lit(max(1.05, rate and 100 / (rate - 0.05))))).cast("int"))
    x = grown.select(*within, F.col(key).alias("a"), F.col(text).alias("ta"), F.explode(F.array(F.col("_band") - 1, F.col("_band"), F.col("_band") + 1)).alias("_band"))
    return x.join(grown.select(*within, F.col(key).alias("b"), F.col(text).alias("tb"), "_band"), [*within, "_band"]).where("a < b")


def candidate_texts(texts: DataFrame, key: str, text: str, rate: float, within: list[str]) -> DataFrame:
    """a, ta, b, tb: pairs of texts that share a segment at a place where a matching rate of `rate` percent would leave it.

    A text of length l has partners of up to l / p code points (p: the rate as a share), so at most t = l (1 - p) / p edits
    from it; cut into t + 1 even segments, one of these is untouched in every such partner. A partner d code points longer
    has segment i at most i places from where it was, counted from the left, and t - i counted from the right. So texts
    are joined on (length of the shorter one, segment number, segment): an equal key for every pair sought, and a number
    of keys for each text that doesn't depend on how many texts there are. Pairs may come more than once.
    """
    if rate <= 50:
        return _banded(texts, key, text, rate, within)
    p = (rate - 0.05) / 100  # rates are rounded to one decimal
    edits = lambda n: F.floor(n * ((1 - p) / p) + 1e-9).cast("int")
    sized = texts.where(F.col(text).isNotNull()).select(*within, F.col(key).alias("_key"), F.col(text).alias("_text"), F.length(text).alias("_n")).where("_n > 0")
    begin = lambda i: F.floor(i * F.col("_l") / (F.col("_t") + 1)).cast("int")
    numbered = lambda df: df.withColumn("_t", edits(F.col("_l"))).select("*", F.explode(F.sequence(F.lit(0), F.col("_t"))).alias("_i")).withColumns({"_from": begin(F.col("_i")), "_size": begin(F.col("_i") + 1) - begin(F.col("_i"))})
    segment = lambda at: F.substring("_text", at + 1, F.col("_size")).alias("_segment")
    index = numbered(sized.withColumn("_l", F.col("_n"))).select(*within, F.col("_key").alias("a"), F.col("_text").alias("ta"), "_l", "_i", segment(F.col("_from")))
    shortest = F.greatest(F.ceil(F.col("_n") * p - 1e-9).cast("int"), F.lit(1))
    probe = numbered(sized.select("*", F.explode(F.sequence(shortest, F.col("_n"))).alias("_l"))).withColumn("_d", F.col("_n") - F.col("_l"))
    lo = F.greatest(F.lit(0), F.col("_from") - F.col("_i"), F.col("_from") + F.col("_d") - F.col("_t") + F.col("_i"))
    hi = F.least(F.col("_n") - F.col("_size"), F.col("_from") + F.col("_i"), F.col("_from") + F.col("_d") + F.col("_t") - F.col("_i"))
    placed = probe.withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi").select("*", F.explode(F.sequence("_lo", "_hi")).alias("_at"))
    probes = placed.select(*within, F.col("_key").alias("b"), F.col("_text").alias("tb"), F.col("_n").alias("_nb"), "_l", "_i", segment(F.col("_at"))).distinct()
    # Pairs of one length meet both ways: the smaller key comes first.
    return index.join(probes, [*within, "_l", "_i", "_segment"]).where("_l < _nb or a < b").select("a", "ta", "b", "tb")


def close_texts(texts: DataFrame, key: str, text: str, rate: float, within: list[str]) -> DataFrame:
    """Pairs (a, b), a < b, with the same `within` columns and a matching rate of at least `rate` percent.

    Candidates share a segment (see `candidate_texts`) and are confirmed by their edit distance. Null and empty texts have
    no partners. Texts that share one segment with very many others are compared with all of these: collapse equal texts
    first, as `text_groups` does.
    """
    from ..functions.texts import matching_rate

    found = candidate_texts(texts, key, text, rate, within).where(matching_rate(F.col("ta"), F.col("tb")) >= rate)
    return found.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def groups(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): groups of threshold pairs by their least member."""
    return components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")), nodes)


def text_groups(texts: DataFrame, key: str, text: str, rate: float) -> DataFrame:
    """(node, component): groups of all texts that pairs with a matching rate of at least `rate` percent link.

    Equal texts are one representative, their least key; all representatives are compared.
    """
    filled = texts.where(F.length(text) > 0).select(F.col(key).alias("b"), F.col(text).alias("_text"))
    reps = filled.groupBy("_text").agg(F.min("b").alias("a"))
    equal = filled.join(reps, "_text").where("a != b").select("a", "b")
    return groups(close_texts(reps, "a", "_text", rate, []).unionByName(equal), texts.select(F.col(key).alias("node")))


#: Points that stand for regions of space at most, and rows of one block of a region.
PIVOTS, BLOCK = 1024, 16_000
#: Comparisons that cost as much as dealing out one row.
COPY = 500


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _chosen(vectors: np.ndarray, eps: float, n: int) -> np.ndarray:
    """As many of the sampled vectors for pivots as make the n points' comparisons cheapest, told by the rest of the sample.

    Where distances are much alike, as in many dimensions, no pivot is far enough from any point to leave its region out:
    more pivots then only make more copies, and one region that is cut into blocks costs least.
    """
    rest = vectors[len(vectors) // 2 :]
    best, least = vectors[:1], float("inf")
    size = 1
    while size <= max(1, len(vectors) // 2):
        pivots = vectors[:size]
        far = np.sqrt(np.maximum(0, (rest**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None] - 2 * rest @ pivots.T))
        every = (far <= far.min(axis=1, keepdims=True) + 2 * eps).sum(axis=0) * (n / len(rest))
        own = np.bincount(far.argmin(axis=1), minlength=size) * (n / len(rest))
        # A row that is dealt out costs about as much as COPY comparisons.
        cost = (own * every).sum() + COPY * (own * np.ceil(every / BLOCK) + every * np.maximum(1, np.ceil(own / BLOCK))).sum()
        if cost < least:
            best, least = pivots, cost
        size *= 4
    return best


def _regions(points: DataFrame, pivots: np.ndarray, eps: float) -> DataFrame:
    """points with region and home: each point in the region of its nearest pivot (home), and in every region that has points within eps.

    A point within eps of one that is nearer to pivot j than to pivot i is at most 2 eps farther from j than from i: the
    triangle inequality both ways.
    """
    square = (pivots**2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2_000):
                part = batch.slice(a, 2_000)
                v = _matrix(pa.chunked_array([part.column("vec")]))
                far = np.sqrt(np.maximum(0, (v**2).sum(axis=1)[:, None] + square[None] - 2 * v @ pivots.T))
                near = far.argmin(axis=1)
                # A little more than 2 eps, for rounding: more regions never change a result.
                own, region = np.nonzero(far <= far.min(axis=1, keepdims=True) + 2 * eps + 1e-6 * (1 + far.max()))
                rows = part.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([pa.array(region.astype(np.int32)), pa.array(near[own] == region), *rows.columns], names=["region", "home", *rows.schema.names])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInArrow(run, f"region int, home boolean, {kinds}")


def _within(points: DataFrame, pivots: np.ndarray, eps: float, work: Callable[[pa.Table, pa.Table, Callable], pa.Table], schema: str, others: str = "true") -> DataFrame:
    """work(home points, those of the other points that `others` takes, near) on each block of a region; near(a) gives pairs (home, other) within eps of home points from a on.

    Regions with many rows are cut on both sides, so that a block has at most 2 x BLOCK rows on average.
    """
    dealt = _regions(points, pivots, eps)
    sizes = dealt.groupBy("region").agg(F.count("*").alias("all"), F.count_if("home").alias("own")).select("region", F.ceil(F.col("own") / BLOCK).cast("int").alias("rows"), F.ceil(F.col("all") / BLOCK).cast("int").alias("columns"))
    sized = dealt.join(F.broadcast(sizes), "region")  # a row for each pivot
    part = lambda c: F.pmod(F.xxhash64("rep"), F.greatest(c, F.lit(1))).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.greatest(c, F.lit(1)) - 1))
    own = sized.where("home").withColumn("r", part(F.col("rows"))).withColumn("c", every(F.col("columns")))
    sized = sized.select(*[F.col(c).alias(c) for c in sized.columns])  # columns of their own, so that both sides can be told apart
    other = sized.where(others).withColumn("c", part(F.col("columns"))).withColumn("r", every(F.col("rows")))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return work(left, right, lambda a: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
        x, y = _matrix(left["vec"]), _matrix(right["vec"])
        xx, yy = (x**2).sum(axis=1), (y**2).sum(axis=1)
        # Products of matrices leave out what is too far by more than their rounding; the rest is measured entry by entry.
        slack = lambda unit: 10 * unit * (x.shape[1] + 8) * (xx.max(initial=0.0) + yy.max(initial=0.0))
        short = slack(2.0**-24) < eps * eps / 4
        kind, limit = (np.float32, eps * eps + slack(2.0**-24)) if short else (np.float64, eps * eps * (1 + 1e-12) + slack(2.0**-53))
        u = np.c_[-2 * x, xx, np.ones(len(x))].astype(kind)
        w = np.ascontiguousarray(np.c_[y, np.ones(len(y)), yy].astype(kind).T)

        def near(a: int) -> tuple[np.ndarray, np.ndarray]:
            i, j = np.divmod(np.flatnonzero(~(u[a : a + 250] @ w > kind(limit))), len(y))
            exact = np.zeros(len(i))
            for k in range(x.shape[1]):
                exact += (x[i + a, k] - y[j, k]) ** 2
            close = np.sqrt(exact) <= eps
            return i[close] + a, j[close]

        return work(left, right, near)

    block = ["region", "r", "c"]
    return own.groupBy(*block).cogroup(other.groupBy(*block)).applyInArrow(run, schema)


def _counted(left: pa.Table, right: pa.Table, near: Callable) -> pa.Table:
    """Each home point with the number of points near it."""
    n, weight = np.zeros(left.num_rows, np.int64), right["n"].to_numpy()
    for a in range(0, left.num_rows, 250):
        i, j = near(a)
        np.add.at(n, i, weight[j])
    return pa.table({"rep": left["rep"], "near": n})


def _linked(left: pa.Table, right: pa.Table, near: Callable) -> pa.Table:
    """(rep, core, other): a forest of the links between core points of the block, and for each other point one core of every tree near it."""
    ids, other = left["rep"].to_numpy(), right["rep"].to_numpy()
    hard, other_hard = left["core"].to_numpy(zero_copy_only=False), right["core"].to_numpy(zero_copy_only=False)
    names, place = np.unique(np.r_[ids, other], return_inverse=True)
    root = np.arange(len(names))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out: set[tuple[int, bool, int]] = set()
    loose: list[tuple[np.ndarray, np.ndarray]] = []
    for a in range(0, left.num_rows, 250):
        i, j = near(a)
        both = hard[i] & other_hard[j]
        for p, q in zip(place[i[both]].tolist(), place[len(ids) + j[both]].tolist(), strict=True):
            x, y = top(p), top(q)
            if x != y:
                root[max(x, y)] = min(x, y)
                out.add((int(names[p]), True, int(names[q])))
        edge = ~hard[i] & other_hard[j]
        loose.append((i[edge], place[len(ids) + j[edge]]))
    for i, q in loose:
        out |= {(int(ids[p]), False, int(names[top(x)])) for p, x in zip(i.tolist(), q.tolist(), strict=True)}
    rows = sorted(out)
    return pa.table({"rep": pa.array([r[0] for r in rows], pa.int64()), "core": pa.array([r[1] for r in rows], pa.bool_()), "other": pa.array([r[2] for r in rows], pa.int64())})


def density_clusters(points: DataFrame, key: str, vector: str, eps: float, min_points: int = 2) -> DataFrame:
    """(node, component, core) of points in clusters: a point is core if `min_points` points, itself included, are within eps (Euclidean).

    Core points within eps of each other are one cluster, named by the least of them; a point that is not core belongs to the
    cluster of a core point within eps, of several the least; noise is dropped. Equal vectors are one representative that
    counts for all of them. Space is cut by pivots, a bounded sample of the points: each point is compared with those of
    its pivot's region and with copies of those within reach of its border. Blocks give back counts and forests, never
    their pairs. Rows with a null, empty or non-finite vector or one of another length than most take no part.
    """
    wide = points.select(F.col(key).alias("_node"), F.transform(F.col(vector).cast("array<double>"), lambda x: x + 0.0).alias("vec"))
    good = wide.where((F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.col("_node").isNotNull())
    usual = good.groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    good = good.where(F.size("vec") == (usual["dims"] if usual else 0))
    reps = stored(good.groupBy("vec").agg(F.count("*").alias("n"), F.min("_node").alias("least")).select(F.monotonically_increasing_id().alias("rep"), "vec", "n", "least"))
    total = reps.count()
    some = reps.orderBy(F.xxhash64("vec"), "rep").limit(2 * min(PIVOTS, int(total**0.5) + 1)).select("vec").collect()
    if not some:
        return good.select(F.col("_node").alias("node"), F.col("_node").alias("component"), F.lit(True).alias("core"))
    pivots = _chosen(np.array([r["vec"] for r in some]), eps, total)
    counts = _within(reps.select("rep", "vec", "n"), pivots, eps, _counted, "rep long, near long").groupBy("rep").agg(F.sum("near").alias("near"))
    known = stored(reps.join(counts, "rep").withColumn("core", F.col("near") >= min_points))
    links = stored(_within(known.select("rep", "vec", "core"), pivots, eps, _linked, "rep long, core boolean, other long", "core"))
    cores = known.where("core").select(F.col("rep").alias("node"))
    found = stored(components(links.where("core").select(F.col("rep").alias("src"), F.col("other").alias("dst")), cores))
    # A cluster's name is its least core point.
    border = links.where("not core").join(found, F.col("other") == F.col("node")).select("rep", "component")
    named = known.select("rep", "least", "core").join(found.withColumnRenamed("node", "rep"), "rep")
    names = named.groupBy("component").agg(F.min("least").alias("name"))
    edge = border.join(names, "component").groupBy("rep").agg(F.min("name").alias("name")).withColumn("core", F.lit(False))
    every = stored(named.join(names, "component").select("rep", "name", "core").unionByName(edge))
    return good.join(reps.join(every, "rep").select("vec", "name", "core"), "vec").select(F.col("_node").alias("node"), F.col("name").alias("component"), "core")
