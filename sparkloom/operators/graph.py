"""Graph operators on edge tables (src, dst): closures, fixpoints, components, paths.

Loops run on the driver over small counts only; the frames stay distributed and each round is
stored, so that plans don't grow and a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .storage import Growing, stored


def _edges(edges: DataFrame) -> DataFrame:
    """The edges, once each, stored: rounds read them instead of making them again."""
    return stored(edges.select("src", "dst").distinct())


def closure(edges: DataFrame, roots: DataFrame, max_depth: int = 80, max_nodes: int | None = None) -> DataFrame:
    """(node, depth): all nodes reachable from roots(node), roots included at depth 0, by least depth.

    max_nodes stops the walk after the round in which so many nodes are known; all nodes of that
    round are kept, so the result doesn't depend on any order.
    """
    return _walk(_edges(edges), roots, max_depth, max_nodes)


def _walk(e: DataFrame, roots: DataFrame, max_depth: int = 80, max_nodes: int | None = None) -> DataFrame:
    """closure() over edges that are stored: each round adds its nodes to the folder of those known."""
    seen = Growing(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, max_depth + 1):
        known = seen.frame()
        frontier = known.where(F.col("depth") == depth - 1)
        step = frontier.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        seen.add(step.join(known.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if seen.frame().where(F.col("depth") == depth).isEmpty():
            break
        if max_nodes is not None and seen.frame().count() > max_nodes:
            break
    return seen.frame()


def typed_closure(edges: DataFrame, roots: DataFrame, types: list[str], excluded_prefixes: list[str], max_depth: int = 80) -> DataFrame:
    """Closure along edges(type, src, dst) of the types given, never into nodes with an excluded prefix."""
    kept = edges.where(F.col("type").isin(types))
    for p in excluded_prefixes:
        kept = kept.where(~F.col("dst").startswith(p))
    return closure(kept, roots, max_depth)


def exclusive_nodes(edges: DataFrame, tree: DataFrame, entry: DataFrame) -> DataFrame:
    """Nodes of tree(node), entries aside, that have callers, all of them in the tree: one pass."""
    inside = tree.select(F.col("node").alias("src"), F.lit(True).alias("_in")).distinct()
    called = edges.select("src", "dst").distinct().join(inside, "src", "left")
    own = called.groupBy(F.col("dst").alias("node")).agg(F.bool_and(F.coalesce("_in", F.lit(False))).alias("all_in")).where("all_in").select("node")
    return own.join(tree.select("node").distinct(), "node", "left_semi").join(entry.select("node"), "node", "left_anti")


def removable_nodes(edges: DataFrame, roots: DataFrame, anchors: DataFrame | None = None, protect_roots: bool = True, max_depth: int = 80) -> DataFrame:
    """Greatest fixpoint: from the closure of roots, nodes with a caller outside or an anchor go until none is left to go."""
    every = _edges(edges)
    e = every.where("src != dst")
    left = _walk(every, roots, max_depth).select("node")
    if anchors is not None:
        fixed = anchors.select("node").join(roots.select("node"), "node", "left_anti") if protect_roots else anchors.select("node")
        left = stored(left.join(fixed, "node", "left_anti"))
    while True:
        inside = e.join(left.select(F.col("node").alias("dst")), "dst", "left_semi")
        bad = inside.join(left.select(F.col("node").alias("src")), "src", "left_anti").select(F.col("dst").alias("node")).distinct()
        if protect_roots:
            bad = bad.join(roots.select("node"), "node", "left_anti")
        bad = stored(bad)
        if bad.isEmpty():
            return left
        left = stored(left.join(bad, "node", "left_anti"))


def cascade_nodes(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Least fixpoint: from seeds, a node joins when all its callers (itself aside) are in the set."""
    e = _edges(edges).where("src != dst")
    got = Growing(seeds.select("node").distinct())
    while True:
        known = got.frame()
        inside = known.select(F.col("node").alias("src"), F.lit(True).alias("_in"))
        reached = e.join(inside, "src", "left").groupBy(F.col("dst").alias("node")).agg(F.bool_and(F.coalesce("_in", F.lit(False))).alias("ok")).where("ok").select("node")
        new = stored(reached.join(known, "node", "left_anti"))
        if new.isEmpty():
            return known
        got.add(new)


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the least node reachable along edges in either direction.

    Star contraction: in turn every node points its greater neighbours, then its smaller ones, to the least node that it
    knows, until all edges lead from a node to its component's least. Rounds grow with the logarithm of the nodes, not
    with a component's diameter. A hub's edges are reduced by partial minimums and joined to one row, which Spark may
    split; no task needs them together.
    """
    e = stored(edges.where("src != dst").select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).distinct())
    mark = lambda: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
    before = mark()
    while True:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("_u"), "m")
        small = large.join(low, F.col("hi") == F.col("_u")).select(F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("x"))
        e = stored(small.select("x.*").where("hi != lo").distinct())
        after = mark()
        if after == before:
            return nodes.select("node").distinct().join(e, F.col("node") == F.col("hi"), "left").select("node", F.coalesce("lo", "node").alias("component"))
        before = after


def shortest_paths(edges: DataFrame, source, rounds: int = 1000) -> DataFrame:
    """(node, dist) from source along edges(src, dst, w, pos); of edges given twice the last counts."""
    last = stored(edges.groupBy("src", "dst").agg(F.max_by("w", "pos").alias("w")))
    dist = stored(edges.sparkSession.createDataFrame([(source, 0)], "node long, dist long"))
    for _ in range(rounds):
        step = dist.join(last, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("dist"))
        new = stored(dist.unionByName(step).groupBy("node").agg(F.min("dist").alias("dist")))
        if new.exceptAll(dist).isEmpty():
            return new
        dist = new
    raise RuntimeError("a cycle of negative weight")


def network_delay(edges: DataFrame, nodes: DataFrame, source) -> DataFrame:
    """One row: the largest distance from source, or -1 if a node can't be reached."""
    reached = nodes.join(shortest_paths(edges, source), "node", "left")
    return reached.agg(F.when(F.count_if(F.col("dist").isNull()) > 0, F.lit(-1)).otherwise(F.max("dist")).cast("long").alias("delay"))


def _in_order(rows: DataFrame, fold, schema: StructType) -> DataFrame:
    """Run fold(state, levels, positions) over the rows of each tree in order of pos; it gives a column or mask of the batch.

    Rows stream through a task in sorted order: only the state of one tree is held, never a tree.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = []
        tree = object()
        for batch in batches:
            out = []
            for t, level, pos in zip(*(batch.column(c).to_pylist() for c in ("tree", "level", "pos")), strict=True):
                if t != tree:
                    tree, state = t, []
                out.append(fold(state, level, pos))
            if len(schema) == batch.num_columns:
                yield batch.filter(pa.array(out, pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, batch.schema.field("pos").type)], names=schema.names)

    return rows.repartition("tree").sortWithinPartitions("tree", "pos").mapInArrow(run, schema)


def levelled_parents(rows: DataFrame) -> DataFrame:
    """rows(tree, pos, level, content) with parent_pos: the nearest earlier row of the tree with a smaller level.

    A stack holds the open rows, at most one for each level.
    """

    def fold(stack: list, level: int, pos: int) -> int | None:
        while stack and stack[-1][0] >= level:
            stack.pop()
        parent = stack[-1][1] if stack else None
        stack.append((level, pos))
        return parent

    return _in_order(rows, fold, StructType([*rows.schema.fields, StructField("parent_pos", rows.schema["pos"].dataType)]))


def leaf_paths(rows: DataFrame, separator: str = "&") -> DataFrame:
    """(tree, pos, path) of each leaf: its content, then the contents from the root down to its parent."""
    keep = rows.withColumn("_next", F.lead("level").over(Window.partitionBy("tree").orderBy("pos")))
    linked = levelled_parents(keep)
    leaves = linked.where("_next is null or _next <= level").select("tree", F.col("pos").alias("leaf"), "content", "parent_pos").withColumn("above", F.array().cast("array<string>"))
    done = None
    parents = linked.select("tree", F.col("pos").alias("_p"), F.col("content").alias("_c"), F.col("parent_pos").alias("_up"))
    live = leaves
    while True:
        ended = live.where("parent_pos is null").select("tree", F.col("leaf").alias("pos"), F.concat_ws(separator, F.col("content"), F.concat_ws(separator, "above")).alias("path"), F.size("above").alias("_n"), "content")
        done = ended if done is None else done.unionByName(ended)
        step = live.where("parent_pos is not null").alias("l").join(parents.alias("p"), (F.col("l.tree") == F.col("p.tree")) & (F.col("parent_pos") == F.col("_p")))
        live = stored(step.select("l.tree", "leaf", "content", F.col("_up").alias("parent_pos"), F.concat(F.array("_c"), F.col("above")).alias("above")))
        if live.isEmpty():
            return done.select("tree", "pos", F.when(F.col("_n") == 0, F.col("content")).otherwise(F.col("path")).alias("path"))


def without_level_jumps(rows: DataFrame) -> DataFrame:
    """rows(tree, pos, level) without those more than one level below the last row kept: a fold in order, tree by tree."""

    def fold(last: list, level: int, pos: int) -> bool:
        if last and last[0] + 1 < level:
            return False
        last[:] = [level]
        return True

    return _in_order(rows, fold, rows.schema)


def annotated_tree(edges: DataFrame, roots: DataFrame, inside: DataFrame, retained: DataFrame, max_depth: int = 20) -> DataFrame:
    """(root, path, node, depth, cycle, retained): the call tree below each root.

    Children stay within inside(node); a node that stands on its own path is flagged as a cycle;
    neither it nor a retained node is expanded.
    """
    e = stored(edges.select("src", "dst").distinct().join(inside.select(F.col("node").alias("dst")), "dst", "left_semi"))
    keep = retained.select("node", F.lit(True).alias("_kept")).distinct()
    level = roots.select(F.col("node").alias("root"), F.array("node").alias("path"), "node", F.lit(0).alias("depth"), F.lit(False).alias("cycle")).join(keep, "node", "left").withColumn("retained", F.coalesce("_kept", F.lit(False))).drop("_kept")
    level = stored(level)
    out = level
    for depth in range(1, max_depth + 1):
        open_ = level.where("not cycle and not retained").select("root", "path", F.col("node").alias("src"))
        step = open_.join(e, "src").select("root", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("node"), F.lit(depth).alias("depth"), F.array_contains("path", F.col("dst")).alias("cycle"))
        level = stored(step.join(keep, "node", "left").withColumn("retained", F.coalesce("_kept", F.lit(False))).select(*out.columns))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def permutations(values: DataFrame, column: str) -> DataFrame:
    """All orders of a small set of distinct values, as arrays: one join per place."""
    n = values.count()
    out = values.select(F.array(column).alias("perm"))
    for _ in range(n - 1):
        out = out.join(values, ~F.array_contains("perm", F.col(column))).select(F.concat("perm", F.array(column)).alias("perm"))
    return out
