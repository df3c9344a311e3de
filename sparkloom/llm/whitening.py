"""Whitening of embeddings: principal components from MLlib's computeSVD on centred distributed rows.

Entries become whole numbers, so sums are exact: n and the sums S of each dimension come first, then
the centred rows (n * x - S) / n go to `RowMatrix.computeSVD`, whose squared singular values divided
by n are the eigenvalues of the covariance (divisor n). The total variance, the trace, comes apart
from that from the rows' exact deviations, sums of (n * x - S)^2. The driver holds sums of each
dimension and one dims x dims matrix, whatever the number of rows.

Edge cases: rows drop whose vector is null, empty, holds null or non-finite entries or entries beyond
+-2^41 (whose whole numbers would leave a double's), or is of another length than most are (of
lengths equally frequent the longest counts). Null and repeated ids and repeated rows are rows like
any other. Components without variance (eigenvalues under 1e-12 of the first) can't be whitened and
are left out, so equal vectors, a single one or none give no rows. A deviation beyond a long is null
there and whole in `deviation_exact`. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Singular values below this share of the first are rounding, not variance.
RANK = 1e-6


def whole_numbers(rows: DataFrame) -> DataFrame:
    """vec_id, x: floor(1024 * c) + 100000 of each entry c, of the rows whose vectors count."""
    c = F.col("embedding").cast("array<double>")
    good = rows.select("vec_id", c.alias("c")).where((F.size("c") > 0) & F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 2.0**41)))
    lengths = good.groupBy(F.size("c").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    x = F.transform("c", lambda v: F.floor(v * 1024) + 100_000)
    return good.where(F.size("c") == (lengths["dims"] if lengths else 0)).select("vec_id", x.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def totals(rows: DataFrame) -> tuple[int, list[int], int]:
    """n, the sum of each dimension, and the largest absolute entry, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, most = 0, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            n, most = n + len(x), max(most, int(np.abs(x).max()))
            own = x.sum(axis=0) if most * len(x) < 1 << 62 else x.astype(object).sum(axis=0)
            sums = [a + int(b) for a, b in zip(sums or [0] * x.shape[1], own, strict=True)]
        if n:
            out = pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(sums)], pa.int32()), out), pa.array([most], pa.int64())], names=["n", "sums", "most"])

    parts = rows.select("x").mapInArrow(run, "n long, sums array<decimal(38,0)>, most long")
    each = parts.select(F.posexplode("sums").alias("dim", "part"), "n", "most").groupBy("dim").agg(F.sum("part").alias("s"), F.sum("n").alias("n"), F.max("most").alias("most")).orderBy("dim").collect()
    return (each[0]["n"], [int(r["s"]) for r in each], each[0]["most"]) if each else (0, [], 0)


def _centred(x: np.ndarray, n: int, sums: list[int], most: int) -> np.ndarray:
    """n * x - S: whole numbers, Python's where 64 bits don't hold them."""
    if 2 * most * n < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def components(rows: DataFrame, n: int, sums: list[int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the covariance (divisor n), falling, and their unit vectors as columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = (_centred(_matrix(batch.column("x")), n, sums, most) / n).astype(float)
                ends = np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(y.ravel()))], names=["y"])

    centred = rows.select("x").mapInArrow(run, "y array<double>").select(array_to_vector("y").alias("y"))
    # As many values as dimensions are asked for: the matrix is then decomposed as a whole, to double precision.
    found = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "y"), n, len(sums)).computeSVD(len(sums), computeU=False, rCond=RANK)
    sigma = found.s.toArray()
    return sigma**2 / n, found.V.toArray()[:, : len(sigma)]


def _projected(rows: DataFrame, n: int, sums: list[int], most: int, values: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """vec_id, deviation (exact), z: each row on the components, over the roots of their eigenvalues."""
    scaled = vectors / np.sqrt(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = _centred(_matrix(batch.column("x")), n, sums, most)
            z = (d / n).astype(float) @ scaled
            if d.dtype != object and float(np.abs(d).max()) ** 2 * d.shape[1] >= 2.0**62:
                d = d.astype(object)
            squares = [Decimal(int(v)) for v in (d * d).sum(axis=1)]
            ends = np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(squares, pa.decimal128(38, 0)), pa.ListArray.from_arrays(pa.array(ends), pa.array(z.ravel()))], names=["vec_id", "deviation", "z"])

    return rows.mapInArrow(run, "vec_id long, deviation decimal(38,0), z array<double>")


def _identity_error(rows: DataFrame, k: int) -> float:
    """The largest absolute entry of z's covariance (divisor n, centred first) less the identity."""
    z = [F.col("z")[i] for i in range(k)]
    mean = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(z)]).first()
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    got = rows.agg(*[F.avg((z[i] - mean[i]) * (z[j] - mean[j])).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, got, strict=True))


def whiten(embeddings: DataFrame, most_components: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact of each row and component."""
    spark = embeddings.sparkSession
    rows = whole_numbers(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    n, sums, most = totals(rows)
    values, vectors = components(rows, n, sums, most) if n > 1 else (np.zeros(0), np.zeros((0, 0)))
    k = min(most_components, len(values))
    if not k or values[0] <= 0:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)")
    kept = stored(_projected(rows, n, sums, most, values[:k], vectors[:, :k]), "whitened")
    # Exact deviations give the trace: their sum over n^3, in whole numbers until the division.
    whole = kept.agg(F.sum(F.col("deviation").cast("decimal(38,0)")).cast("string").alias("s")).first()["s"]
    trace = int(whole) / n**3 if whole is not None else float(kept.agg(F.sum(F.col("deviation").cast("double"))).first()[0]) / n**3
    error = _identity_error(kept, k)
    share = F.element_at(F.array(*[F.lit(float(v / trace)) for v in values[:k]]), F.col("component"))
    each = kept.select("vec_id", "deviation", F.posexplode("z").alias("pos", "whitened")).withColumn("component", (F.col("pos") + 1).cast("int"))
    return each.select("vec_id", "component", F.lit(n).cast("long").alias("n"), F.col("deviation").try_cast("long").alias("deviation"), "whitened", share.alias("explained"), F.lit(error).alias("identity_error"), F.col("deviation").alias("deviation_exact"))
