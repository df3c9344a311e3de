"""Streaming queries with several batches: the events table dealt into files by time and replayed one by one."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from ..sources import publisher
from ..streaming import caches, joins, ticks
from .registry import query
from .relational import table
from .streams import _drained, _work

SLICES = 3
#: Rows of one file of a slice, about.
FILE_ROWS = 100_000


def _cut(spark, d):
    """events with `slice`, 0 to SLICES - 1: even spans of time."""
    events = table(spark, d, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    span = events.agg(F.min("ms").alias("lo"), F.max("ms").alias("hi")).first()
    lo, width = span["lo"] or 0, ((span["hi"] or 0) - (span["lo"] or 0)) // SLICES + 1
    return events.withColumn("slice", F.floor((F.col("ms") - lo) / width).cast("int"))


def _replayed(spark, d):
    """The events as a stream of one batch for each slice, in order of time: as many files for each slice, all of them one batch."""
    folder, cut = _work(spark), _cut(spark, d)
    most = max((r["count"] for r in cut.groupBy("slice").count().collect()), default=0)
    files = max(1, -(-most // FILE_ROWS))
    for k in range(SLICES):
        path = f"{folder}/in/n={k}"
        cut.where(F.col("slice") == k).repartition(files, "event_id").write.parquet(path)
        # Parts without rows have no file: empty ones stand for them.
        for _ in range(files - len(spark.read.schema(cut.schema).parquet(path).inputFiles())):
            spark.createDataFrame([], cut.schema).write.mode("append").parquet(path)
        time.sleep(0.05)  # files are taken by the time of writing
    return spark.readStream.schema(cut.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in/n=*")


# The slices in SQL.
_SLICED = f"""e AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events), b AS (SELECT min(ms) AS lo, (max(ms) - min(ms)) // {SLICES} + 1 AS width FROM e),
c AS (SELECT e.*, ((ms - lo) // width)::INTEGER AS slice FROM e, b)"""


@query("a05_exact_distinct_stream", """SELECT start, keys FROM (SELECT date_trunc('hour', ts)::TIMESTAMP AS start, count(DISTINCT user_id) AS keys FROM events GROUP BY 1)
WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOURS FROM events)""")
def a05_stream(spark, d):
    counted = joins.distinct_counts(_replayed(spark, d), "ts", "user_id", "1 hour", "2 hours")
    return _drained(spark, counted, "append").select(F.col("start").cast("timestamp_ntz").alias("start"), "keys")


@query("j13_while_subscribed", """SELECT DISTINCT e.event_id, 'ch' || (floor(c.value)::BIGINT % 3) AS channel FROM events e JOIN events c ON c.event_type = 'click' AND c.user_id = e.user_id
AND e.ts >= c.ts AND e.ts < c.ts + INTERVAL 24 HOURS WHERE e.event_type = 'purchase'""")
def j13_stream(spark, d):
    # Clicks subscribe a channel to their user for a day; purchases are pushed.
    events = _replayed(spark, d).where("event_type = 'purchase'")
    commands = _replayed(spark, d).where("event_type = 'click'").select("user_id", F.concat(F.lit("ch"), F.floor("value") % 3).alias("channel"), F.col("ts").alias("at"))
    return _drained(spark, joins.while_subscribed(events, "event_id", "user_id", "ts", commands, "channel", "at", "24 hours"), "append").drop("_batch")


@query("r08_latency", "SELECT event_id, (user_id % 9) * 250 AS latency FROM events WHERE event_type = 'purchase'")
def r08_latency(spark, d):
    sent = _replayed(spark, d).where("event_type = 'purchase'").select("event_id", F.col("ms").alias("sendTime"), (F.col("ms") + (F.col("user_id") % 9) * 250).alias("received"))
    return _drained(spark, joins.latency(sent, "sendTime", F.col("received")).select("event_id", "latency"), "append").drop("_batch")


_HOUR = 3_600_000


@query("r13_loading_cache", f"""WITH RECURSIVE r AS (SELECT event_type || '-' || (event_id % 10) AS cache, event_id, (user_id % 12)::VARCHAR AS k, event_id::VARCHAR AS v, epoch_us(ts) // 1000 AS now,
  row_number() OVER (PARTITION BY event_type, event_id % 10 ORDER BY epoch_us(ts) // 1000, event_id) AS nr FROM events),
w AS (SELECT cache, 0::BIGINT AS nr, 0::BIGINT AS event_id, '' AS k, '' AS action, '' AS v, NULL::VARCHAR AS evicted, []::STRUCT(k VARCHAR, v VARCHAR, written BIGINT)[] AS held FROM (SELECT DISTINCT cache FROM r)
UNION ALL SELECT cache, nr, event_id, k, action, list_last(full_).v, CASE WHEN len(full_) > 8 THEN full_[1].k END, CASE WHEN len(full_) > 8 THEN full_[2:] ELSE full_ END
FROM (SELECT *, list_append(list_filter(live, lambda x: x.k <> y.k), CASE WHEN action = 'hit' THEN mine ELSE {{'k': y.k, 'v': y.v, 'written': y.now}} END) AS full_
  FROM (SELECT *, CASE WHEN mine IS NULL THEN 'load' WHEN now - mine.written >= {30 * _HOUR} THEN 'refresh' ELSE 'hit' END AS action
    FROM (SELECT *, list_filter(live, lambda x: x.k = z.k)[1] AS mine FROM (SELECT r.cache, r.nr, r.event_id, r.k, r.v, r.now, list_filter(w.held, lambda x: r.now - x.written < {60 * _HOUR}) AS live FROM w JOIN r ON r.cache = w.cache AND r.nr = w.nr + 1) z)) y))
SELECT cache, event_id, k, action, v, evicted FROM w WHERE nr > 0""")
def r13_stream(spark, d):
    asked = _replayed(spark, d).select(F.concat_ws("-", "event_type", (F.col("event_id") % 10).cast("string")).alias("cache"), "event_id", (F.col("user_id") % 12).cast("string").alias("k"), F.col("event_id").cast("string").alias("v"), "ms", F.col("ts").cast("timestamp").alias("ts"))
    with caches.state_store(spark):
        served = caches.loading_cache(asked.withWatermark("ts", "1 hour"), "cache", "k", "v", "ms", "event_id", 8, 60 * _HOUR, 30 * _HOUR)
        return _drained(spark, served, "append").drop("_batch")


_SOURCE = "SELECT c_custkey AS k, CASE WHEN (c_custkey + {0}) % 7 <> 0 THEN c_name || '-v{0}' END AS v FROM customer"


@query("r12_read_through", f"WITH {_SLICED}, " + ", ".join(
    f"s{n} AS ({_SOURCE.format(n)}), h{n} AS (SELECT k, v FROM s{n} WHERE v IS NOT NULL AND (k IN (SELECT user_id FROM c WHERE slice = {n})" + (f" OR k IN (SELECT k FROM h{n - 1})" if n else "") + "))" for n in range(SLICES)
) + " " + " UNION ALL ".join(f"SELECT {n}::INTEGER AS batch, k, v FROM h{n}" for n in range(SLICES)))
def r12_stream(spark, d):
    # The source has another version of every row at each batch, and leaves a seventh of the values out.
    customers, folder = table(spark, d, "customer"), _work(spark)

    def load(keys, number):
        value = F.when((F.col("c_custkey") + number) % 7 != 0, F.concat(F.col("c_name"), F.lit(f"-v{number}")))
        return customers.join(keys, F.col("c_custkey") == F.col("k"), "left_semi").select(F.col("c_custkey").alias("k"), value.alias("v"))

    asked = _replayed(spark, d).select(F.col("user_id").alias("k"))
    run = asked.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(caches.read_through(f"{folder}/cache", "k", load)).start()
    run.awaitTermination()
    states = [caches.cached(spark, f"{folder}/cache", "k", n + 1).select(F.lit(n).alias("batch"), "k", "v") for n in range(SLICES)]
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out


@query("k06_published", f"WITH {_SLICED} SELECT 'events-' || slice AS batch, event_type AS topic, event_id::VARCHAR AS body FROM c")
def k06_published(spark, d):
    spark.dataSource.register(publisher.PublishSink)
    folder = _work(spark)
    messages = _replayed(spark, d).select(F.col("event_type").alias("topic"), F.col("event_id").cast("string").alias("body"))
    run = messages.writeStream.format("publish").option("path", f"{folder}/out").option("batch", "events").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return publisher.published(spark, f"{folder}/out")


# A silence is told by the first slice without the key whose watermark, that of the slices before, is past its end; or after the last.
@query("r05_silent_keys", f"""WITH {_SLICED}, w AS (SELECT s.slice, (SELECT max(ms) FROM c WHERE c.slice <= s.slice) - 3600000 AS mark FROM (SELECT DISTINCT slice FROM c) s),
l AS (SELECT w.slice, w.mark, user_id, max(ms) AS last FROM w JOIN c ON c.slice <= w.slice GROUP BY ALL)
SELECT DISTINCT user_id::VARCHAR AS key, last FROM l WHERE last + 21600000 < mark AND NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = l.user_id AND c.slice = l.slice + 1)""")
def r05_silent(spark, d):
    # Users of whom nothing came for six hours, with an hour for late events.
    events = _replayed(spark, d).select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "1 hour")
    return _drained(spark, ticks.silent_keys(events, "key", "ts", 6 * 3600 * 1000), "append").drop("_batch")
