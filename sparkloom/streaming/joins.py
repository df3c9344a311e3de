"""Two stateful steps in one stream: interval joins of two streams, exact distinct counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_counts(ticks: DataFrame, ts: str, key: str, width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """start, keys: exactly how many different keys each window has, once it is closed (append mode).

    The first step keeps one row of state for each key of a window, the second counts those that the first gives out when
    the window closes; both drop their state then. Ticks may come out of order by `late`.
    """
    timed = ticks.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    once = timed.groupBy(F.window(ts, width), key).agg(F.count("*").alias("ticks"))
    return once.groupBy(F.window(F.window_time("window"), width).alias("again")).agg(F.count(key).alias("keys")).select(F.col("again.start").alias("start"), "keys")


def while_subscribed(events: DataFrame, event: str, account: str, ts: str, commands: DataFrame, channel: str, at: str, lease: str, late: str = "1 hour") -> DataFrame:
    """event, channel: each event once for every channel that has subscribed to its account at that time.

    commands(account, channel, at) are a stream of their own: each holds from `at` for the lease, and may be renewed. Both
    sides carry watermarks, so that the join keeps an event for as long as a command can still be late, and a command for
    its lease; renewals that overlap give an event once.
    """
    left = events.select(F.col(event), F.col(account).alias("_account"), F.col(ts).cast("timestamp").alias("_ts")).withWatermark("_ts", late)
    right = commands.select(F.col(account).alias("_of"), F.col(channel), F.col(at).cast("timestamp").alias("_at")).withWatermark("_at", late)
    during = (F.col("_account") == F.col("_of")) & (F.col("_ts") >= F.col("_at")) & (F.col("_ts") < F.col("_at") + F.expr(f"interval {lease}"))
    return left.join(right, during).dropDuplicates([event, channel, "_ts"]).select(event, channel)


def latency(messages: DataFrame, sent: str, received: Column) -> DataFrame:
    """messages with latency, in milliseconds: when they were received less when they were sent (epoch milliseconds)."""
    return messages.withColumn("latency", received - F.col(sent))
