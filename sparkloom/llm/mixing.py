"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Documents of a source are queued in a hash-shuffled order; a document's virtual finish time is the
source's cumulative size up to and including it over the source's target. The queue of a source
may be served `max_repeats` times in a row. All finish times are sorted globally and the schedule
is cut at the total budget, so that every source comes out near its target.

Nothing is sorted in one task: running sums are taken per slice of the shuffled order and shifted
by prefix sums over the slices' totals, and the cut is found from a histogram of finish times and
an exact sort of the one bin that it falls in. The slices and bins grow with the input.

Edge cases: a null text has size 0; documents of size 0 are never taken; a null source is a source
of its own, last in order; a null doc_id shuffles as the empty string; repeated rows are queued one
after the other; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, inner, stored

#: Rows of the shuffled order in one slice of a source, and of the schedule in one bin, about.
SLICE_ROWS, BIN_ROWS = 2_000, 5_000


def source_targets(sizes: DataFrame, weights: list[float], share: float, max_repeats: int) -> DataFrame:
    """From (source, source_size): rank, weight and target; what a source can't take is shared anew by weight.

    The level at which the shares of the uncapped sources meet follows from running sums over the
    sources in order of the level at which each reaches its cap. One row per source goes through
    one task here, never rows of documents.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("source_rank", F.row_number().over(by_name) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(max_repeats)).withColumn("level", F.col("cap") / F.col("weight"))
    order = Window.orderBy("level", "source_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * float(share)
    free = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("free", free)
    met = F.min(F.when(F.col("free") <= F.col("level"), F.struct("level", "source_rank", "free"))).over(everything).getField("free")
    return ranked.withColumn("target", F.least(F.col("cap"), F.coalesce(met, F.col("level")) * F.col("weight"))).select("source", "source_rank", "source_size", "weight", "target")


def schedule(documents: DataFrame, weights: list[float], share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted), copies of every row."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    own = stored(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), key.alias("key")), "mix-sizes")
    n = own.count()
    digits = min(7, max(1, math.ceil(math.log(max(n / SLICE_ROWS, 1), 16))))
    own = own.withColumn("slice", F.conv(F.substring("key", 1, digits), 16, 10).cast("int"))
    per_slice = own.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    targets = source_targets(per_slice.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, share, max_repeats)
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    lead = per_slice.select(F.col("source").alias("_s"), F.col("slice").alias("_b"), F.coalesce(F.sum("slice_size").over(ahead), F.lit(0)).alias("_ahead"))
    lead = lead.join(targets.withColumnRenamed("source", "_t"), F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")
    within = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = own.withColumn("_run", F.sum("size").over(within)).join(lead, F.col("source").eqNullSafe(F.col("_s")) & (F.col("slice") == F.col("_b")))
    queued = stored(queued.select("doc_id", "source", "source_rank", "size", "key", (F.col("_ahead") + F.col("_run")).alias("cum"), "source_size", "target"), "mix-queue")
    # Virtual finish times of a document's services; a source without target is never served.
    services = [(F.col("cum") + F.col("source_size") * i) / F.nullif(F.col("target"), F.lit(0.0)) for i in range(max_repeats)]
    cut = _cut(queued, services, max(1, n * max_repeats // BIN_ROWS))
    place = lambda t: F.struct(t.alias("finish"), F.col("source_rank"), F.col("key"), F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("id"))
    served = [(place(t) <= cut) & t.isNotNull() if cut is not None else t.isNotNull() for t in services]
    copies = sum((F.when(x, 1).otherwise(0) for x in served), F.lit(0))
    copies = F.when(F.col("size") > 0, copies).otherwise(0)
    return queued.select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.cast("int").alias("copies"))


def _cut(queued: DataFrame, services: list, bins: int):
    """The last place of the schedule within the budget, as a struct literal; None if the whole schedule fits."""
    rows = queued.where("size > 0").withColumn("finish", F.explode(F.array(*services))).where("finish is not null")
    rows = rows.withColumn("bin", F.least(F.floor(F.col("finish") * bins), F.lit(4 * bins)).cast("long"))
    sums = rows.groupBy("bin").agg(F.sum("size").alias("words"))
    total = queued.groupBy("source_rank").agg(F.max("target").alias("target")).agg(F.sum("target")).first()[0]
    if total is None:
        return None
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    hit = sums.withColumn("upto", F.sum("words").over(upto)).where(F.col("upto") > total).orderBy("bin").first()
    if hit is None:
        return None
    ordered = Window.orderBy("finish", "source_rank", "key", "id")
    inside = rows.where(F.col("bin") == hit["bin"]).select("finish", "source_rank", "key", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "size")
    inside = inside.withColumn("upto", F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) + (hit["upto"] - hit["words"]))
    last = inside.where(F.col("upto") <= total).agg(F.max(F.struct("finish", "source_rank", "key", "id")).alias("x")).first()["x"]
    if last is None:
        last = (float(hit["bin"]) / bins, -1, "", -(1 << 63))
    return F.struct(F.lit(float(last[0])).alias("finish"), F.lit(int(last[1])).alias("source_rank"), F.lit(last[2]).alias("key"), F.lit(int(last[3])).cast("long").alias("id"))


def mix(documents: DataFrame, weights: list[float], share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """The mixed documents themselves: each row as often as the schedule takes it (0 to max_repeats times).

    Rows that agree in doc_id, source and size are taken alike.
    """
    doc, source, words, copies, nr = (inner(x) for x in ("doc", "source", "size", "copies", "nr"))
    plan = schedule(documents, weights, share, max_repeats).where("copies > 0").groupBy(F.col("doc_id").alias(doc), F.col("source").alias(source), F.col("size").alias(words)).agg(F.min("copies").alias(copies))
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    joined = documents.join(plan, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & F.col("source").cast("string").eqNullSafe(F.col(source)) & (size == F.col(words)))
    return joined.withColumn(nr, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(doc, source, words, copies, nr)
