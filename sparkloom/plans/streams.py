"""Streaming queries: the events table replayed as a stream until it is read up, and the sink's final state."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.storage import stored
from ..sources import readers, replay, writers
from ..streaming import ticks
from .registry import query
from .relational import table


def _stream(spark, d):
    """The events table as a stream of files: its one file, or the files of its folder."""
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")


def _work(spark) -> str:
    """An unused folder below the shared one."""
    return stored(spark.range(1)).inputFiles()[0].rsplit("/", 2)[0] + f"/stream-{uuid.uuid4().hex}"


def _drained(spark, df, mode: str):
    """Run a stream to its end; the rows that its batches gave, with their batch number."""
    folder = _work(spark)

    def keep(batch, number):
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/out/n={number}")

    run = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
    run.awaitTermination()
    return spark.read.schema(df.withColumn("_batch", F.lit(0).cast("long")).schema).parquet(f"{folder}/out/n=*")


@query("r01_tumbling_counts", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def r01(spark, d):
    out = _drained(spark, ticks.tumbling_counts(_stream(spark, d), "ts", "event_type", "1 day", "1 hour"), "update")
    return out.groupBy("start", "event_type").agg(F.max_by("n", "_batch").alias("n")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("r02_running_totals", "SELECT user_id, count(*) AS total FROM events GROUP BY user_id")
def r02(spark, d):
    out = _drained(spark, ticks.running_totals(_stream(spark, d), "ts", "user_id"), "update")
    return out.groupBy("user_id").agg(F.max("total").alias("total"))


@query("r04_without_heartbeats", "SELECT event_id, event_type FROM events WHERE event_type <> 'signup'")
def r04(spark, d):
    return _drained(spark, ticks.without_heartbeats(_stream(spark, d), "event_type", "signup").select("event_id", "event_type"), "append").drop("_batch")


@query("r07_quotes", "SELECT event_id, (user_id % 3)::INTEGER AS market, 's' || user_id AS symbol, CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id END AS time FROM events WHERE event_id % 5 <> 0")
def r07(spark, d):
    k = F.col("user_id")
    time = F.when(F.col("event_id") % 4 == 0, F.lit("oops")).otherwise(k.cast("string"))
    line = F.when(F.col("event_id") % 5 == 0, F.lit("1_a,short")).otherwise(F.concat_ws(",", F.concat((k % 3).cast("string"), F.lit("_s"), k.cast("string")), *[F.lit("1.5")] * 7, F.lit("2"), time, *[F.lit("1.5")] * 2, *[F.lit("8")] * 2, *[F.lit("1.5")] * 2))
    rows = _stream(spark, d).select("event_id", ticks.quote(line).alias("q")).where("q is not null")
    out = rows.select("event_id", ticks.symbol_key(F.col("q.symbol")).alias("key"), F.col("q.time").alias("time"))
    return _drained(spark, out, "append").select("event_id", "key.market", "key.symbol", "time")


@query("r08_order_messages", "SELECT event_id AS account FROM events WHERE event_type = 'purchase' AND user_id % 8 IN (0, 1, 6)")
def r08(spark, d):
    payload = F.to_json(F.struct(F.col("event_id").alias("accountId"), (F.col("user_id") % 8).alias("dealReason")))
    body = F.to_json(F.struct(F.when(F.col("event_type") == "purchase", "ORDER_REFRESH").otherwise("OTHER").alias("cmd"), F.unix_millis(F.col("ts").cast("timestamp")).alias("sendTime"), payload.alias("data")))
    out = ticks.order_messages(_stream(spark, d).select(body.alias("body")), "body", "accountId long, dealReason int")
    return _drained(spark, out.select(F.col("order.accountId").alias("account")), "append").drop("_batch")


@query("r09_last_subscriptions", "SELECT user_id::VARCHAR AS channel, arg_max(CASE WHEN event_type = 'error' THEN '' ELSE event_type END, event_id) AS accounts FROM events GROUP BY 1")
def r09(spark, d):
    commands = _stream(spark, d).select(F.col("user_id").cast("string").alias("channel"), F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("accounts"), F.col("event_id").alias("at"))
    out = _drained(spark, ticks.last_subscriptions(commands, "channel", "accounts", "at"), "update")
    return out.groupBy("channel").agg(F.max_by("accounts", "at").alias("accounts"))


@query("r11_ttl_counts", """SELECT min(ts)::TIMESTAMP AS start, user_id, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM
(SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, g""")
def r11(spark, d):
    return ticks.ttl_counts(table(spark, d, "events"), "ts", "user_id", "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("r12_cache_refresh", "SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'old' END AS v FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 <> 0")
def r12(spark, d):
    c = table(spark, d, "customer")
    cache = c.select(F.col("c_custkey").alias("k"), F.lit("old").alias("v"))
    fresh = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("v"))
    return ticks.refreshed(cache, fresh, "k")


@query("s10_subscriber", "SELECT event_id AS number, event_type || ',' || user_id AS body FROM events WHERE event_type <> 'view' AND event_type <> 'error'")
def s10(spark, d):
    # The events as a subscriber's messages: views are heartbeats, errors come as empty messages.
    spark.dataSource.register(readers.MessageSource)
    folder = _work(spark)
    body = F.when(F.col("event_type") == "view", "HEARTBEAT").when(F.col("event_type") != "error", F.concat_ws(",", "event_type", F.col("user_id").cast("string")))
    replay.write(table(spark, d, "events").select(F.col("event_id").alias("number"), body.alias("body")), f"{folder}/log")
    named = {"factory": "sparkloom.sources.replay:read", "count": "sparkloom.sources.replay:count", "argument": f"{folder}/log", "spans": "4"}
    messages = spark.readStream.format("messages").options(**named).load()
    return _drained(spark, ticks.without_heartbeats(messages, "body"), "append").drop("_batch")


@query("s12_topic_tags", "SELECT event_id FROM events WHERE user_id % 2 = 0 AND event_type IN ('click', 'view')")
def s12(spark, d):
    topic = F.when(F.col("user_id") % 2 == 0, "orders").otherwise("quotes")
    messages = _stream(spark, d).select("event_id", topic.alias("topic"), F.col("event_type").alias("tag"))
    return _drained(spark, readers.selected(messages, "orders", "click || view").select("event_id"), "append").drop("_batch")


@query("s13_commands", "SELECT event_id::VARCHAR AS data FROM events WHERE event_type = 'click' AND event_id % 5 <> 0")
def s13(spark, d):
    cmd = F.when(F.col("event_type") == "click", 200).otherwise(100)
    body = F.when(F.col("event_id") % 5 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(cmd.alias("cmd"), F.col("event_id").cast("string").alias("data"))))
    return _drained(spark, readers.accepted(_stream(spark, d).select(body.alias("line")), "line").select("data"), "append").drop("_batch")


@query("s14_delayed_queue", """SELECT event_id, event_type AS body, epoch_us(ts) // 1000 + (event_id % 10) * 3600000 AS due FROM events
WHERE epoch_us(ts) // 1000 + (event_id % 10) * 3600000 < (SELECT max(epoch_us(ts) // 1000) - 3600000 FROM events)""")
def s14(spark, d):
    sent = _stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    held = sent.select("event_id", F.col("event_type").alias("body"), (F.unix_millis("ts") + (F.col("event_id") % 10) * 3600000).alias("due"), "ts")
    return _drained(spark, ticks.delayed(held, "event_id", "body", "due"), "append").drop("_batch")


@query("r03_exact_distinct_counts", "SELECT date_trunc('second', ts)::TIMESTAMP AS start, user_id, count(*) AS n FROM events GROUP BY 1, 2")
def r03(spark, d):
    out = _drained(spark, ticks.tumbling_counts(_stream(spark, d), "ts", "user_id"), "update")
    return out.groupBy("start", "user_id").agg(F.max_by("n", "_batch").alias("n")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("r06_fan_out", "SELECT 'all' AS sink, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events UNION ALL SELECT 'clicks', count(*), sum(event_id)::BIGINT FROM events WHERE event_type = 'click'")
def r06(spark, d):
    folder = _work(spark)
    everything = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/all/n={n}")
    clicks = lambda batch, n: batch.where("event_type = 'click'").write.mode("overwrite").parquet(f"{folder}/clicks/n={n}")
    run = _stream(spark, d).select("event_id", "event_type").writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(writers.fan_out(everything, clicks)).start()
    run.awaitTermination()
    one, two = (spark.read.parquet(f"{folder}/{sink}/n=*").agg(F.lit(sink).alias("sink"), F.count("*").alias("n"), F.sum("event_id").alias("ids")) for sink in ("all", "clicks"))
    return one.unionByName(two)


@query("r13_bounded_cache", """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
WHERE n = 1 AND ts + INTERVAL 1 DAY > (SELECT max(ts) FROM events) ORDER BY ts DESC, event_id DESC LIMIT 8""")
def r13(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id", "ts")
    now = F.lit(events.agg(F.max("ts")).first()[0])
    return ticks.bounded_cache(events, "user_id", "ts", ["event_id"], now, 8, "1 day").select("user_id", "event_id")


@query("r14_every_consumer", "SELECT g AS consumer, event_id FROM events, (VALUES ('one'), ('two')) v(g) WHERE event_type = 'purchase'")
def r14(spark, d):
    # Each consumer is a stream with a checkpoint of its own, so that both see every message.
    seen = [_drained(spark, _stream(spark, d).where("event_type = 'purchase'").select("event_id"), "append").select(F.lit(name).alias("consumer"), "event_id") for name in ("one", "two")]
    return seen[0].unionByName(seen[1])
