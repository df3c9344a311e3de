"""Connected components of a graph given as a table of links, without collecting links to the driver.

Alternating large-star and small-star steps (a published scheme for map-reduce) turn each component
into a star around its smallest node. Each task first replaces the links it holds by a spanning
forest, so that dense groups shrink before the first shuffle. Every step's result is written to the
shared folder, so that lineage stays short and lost executors cost one step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored

#: Links that a task turns into a forest at once.
FOREST_LINKS = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) pairs of the links a-b, by repeated hooking and pointer jumping."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        lo, hi = np.minimum(rx, ry), np.maximum(rx, ry)
        live = lo != hi
        if not live.any():
            break
        np.minimum.at(root, hi[live], lo[live])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _thinned(links: DataFrame) -> DataFrame:
    """The links of each task as a spanning forest: (a, b) with a > b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            a = np.concatenate([a, batch.column("a").to_numpy()])
            b = np.concatenate([b, batch.column("b").to_numpy()])
            if len(a) > FOREST_LINKS:
                a, b = forest(a, b)
                if len(a) > FOREST_LINKS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                    a, b = a[:0], b[:0]
        if len(a):
            a, b = forest(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(run, "a long, b long")


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) of every node with a link to a smaller one; component is the smallest node reachable.

    links: (a, b) in any direction, repeats and loops allowed. Nodes that are the smallest of their
    component have no row.
    """
    star = stored(_thinned(links.where("a != b")).distinct(), "links")
    for _ in range(rounds):
        before = star
        # Large star: every larger neighbour of u points to u's smallest neighbour (or u itself).
        both = star.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(star.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("_u")).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # Small star: u's smaller neighbours and u itself point to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_a"), "m")
        joined = large.join(low, F.col("a") == F.col("_a"))
        small = joined.select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        star = stored(_thinned(small.select("x.a", "x.b").where("a != b")).distinct(), "links")
        # Done when every node has one parent and no node is both a parent and a child.
        roles = star.select(F.col("a").alias("v"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(star.select(F.col("b").alias("v"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
        both = roles.groupBy("v").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
        done = both.where("child > 1 or (child > 0 and parent > 0)").isEmpty()
        drop_stored(before)
        if done:
            return star.select(F.col("a").alias("node"), F.col("b").alias("component"))
    raise RuntimeError(f"components not found in {rounds} rounds")
