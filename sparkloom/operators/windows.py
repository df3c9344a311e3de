"""Window-based operators: interval merging and gap detection."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged_intervals(rows: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
    """Whole-number intervals of each key, with overlapping and adjacent ones merged."""
    order = Window.partitionBy(key).orderBy(lo, hi)
    before = F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.withColumn("_new", F.when(F.col(lo) <= before + 1, 0).otherwise(1))
    numbered = opened.withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_g").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_g")


def gaps(rows: DataFrame, key: str, ts: str, order: list[str], seconds: float) -> DataFrame:
    """Rows that follow the key's row before by more than so many seconds, with the gap in seconds."""
    w = Window.partitionBy(key).orderBy(ts, *order)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = (micros(F.col(ts)) - micros(F.lag(ts).over(w))) / F.lit(1_000_000.0)
    return rows.withColumn("gap", gap).where(F.col("gap") > seconds)


def common_prefix(rows: DataFrame, key: str, text: str, separator: str = "/") -> DataFrame:
    """key, depth, prefix: the leading parts that all texts of a key share, however many, by one aggregation.

    With the separator behind every text, what the least and the greatest text share all texts between them share too.
    Null texts don't count; a key of nulls only has depth 0.
    """
    ended = F.concat(F.col(text), F.lit(separator))
    ends = rows.groupBy(key).agg(F.split(F.min(ended), re.escape(separator)).alias("_lo"), F.split(F.max(ended), re.escape(separator)).alias("_hi"))
    same = F.zip_with("_lo", "_hi", lambda a, b: F.coalesce(a == b, F.lit(False)))
    # The last part of each is the empty one behind the last separator; it's no part of a text.
    parts = F.least(F.size("_lo"), F.size("_hi")) - 1
    first = F.array_position(same, F.lit(False)).cast("int") - 1
    depth = F.coalesce(F.when(first >= 0, F.least(first, parts)).otherwise(parts), F.lit(0))
    found = ends.withColumn("depth", F.greatest(depth, F.lit(0)))
    return found.select(key, "depth", F.when(F.col("depth") > 0, F.array_join(F.slice("_lo", F.lit(1), F.col("depth")), separator)).otherwise(F.lit("")).alias("prefix"))
