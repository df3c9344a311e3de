"""Streaming sources and keyed state, run until the input is read up."""

import datetime

from pyspark.sql import functions as F

from sparkloom.sources import readers, writers
from sparkloom.streaming import ticks


def drained(df, tmp_path, mode):
    out = []

    def keep(batch, number):
        out.extend(r.asDict() for r in batch.collect())

    q = df.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return out


def test_message_source(spark, tmp_path):
    spark.dataSource.register(readers.MessageSource)
    stream = spark.readStream.format("messages").option("factory", "tests.messages:read").option("count", "tests.messages:count").load()
    q = ticks.without_heartbeats(stream, "body").writeStream.format("memory").queryName("got").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["number"], r["body"]) for r in spark.table("got").collect()) == [(0, "a,1"), (2, "b,2"), (4, "c,3")]


def test_silent_keys(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    for n, rows in enumerate([[("a", at(0)), ("b", at(0))], [("b", at(10))], [("b", at(20))]]):
        spark.createDataFrame(rows, "k string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / f"n={n}"))
    stream = spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "n=*")).withWatermark("ts", "1 minute")
    got = drained(ticks.silent_keys(stream, "k", "ts", 120_000), tmp_path, "append")
    assert {r["k"] for r in got} >= {"a"}


def test_fan_out_reads_once(spark, tmp_path):
    seen = []
    write = writers.fan_out(lambda b, n: seen.append(("one", n, b.count())), lambda b, n: seen.append(("two", n, b.count())))
    write(spark.range(5), 3)
    assert seen == [("one", 3, 5), ("two", 3, 5)]
    writers.upsert_parquet(str(tmp_path / "kv"), "k", "v")(spark.createDataFrame([(1, 1), (1, 2), (2, 5)], "k int, v int"), 0)
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(str(tmp_path / "kv" / "batch=0")).collect()) == [(1, 2), (2, 5)]


def test_refresh_deletes_what_the_source_lacks(spark):
    cache = spark.createDataFrame([(1, "old"), (2, "old"), (3, "old")], "k int, v string")
    source = spark.createDataFrame([(1, "new"), (2, None)], "k int, v string")
    assert sorted(map(tuple, ticks.refreshed(cache, source, "k").collect())) == [(1, "new"), (3, "old")]
    assert ticks.due_messages(spark.range(5), "id", F.lit(2)).count() == 3


def test_spans_cover_each_number_once():
    reader = readers._MessageReader({"spans": "3"})
    for n in (0, 1, 2, 3, 10):
        spans = [(p.start, p.end) for p in reader.partitions({"at": 5}, {"at": 5 + n})]
        assert [i for a, b in spans for i in range(a, b)] == list(range(5, 5 + n))
        assert len(spans) == min(3, n)


def test_upserts_merge_and_expire(spark, tmp_path):
    write = writers.upsert_parquet(str(tmp_path / "kv"), "k", "at")
    rows = lambda *r: spark.createDataFrame(r, "k int, at int, v string")
    write(rows((1, 1, "a"), (2, 1, "b")), 0)
    write(rows((1, 5, "c"), (3, 4, "d")), 1)
    write(rows((1, 5, "c"), (3, 4, "d")), 1)
    write(rows((1, 3, "late")), 2)
    got = lambda df: sorted(map(tuple, df.collect()))
    assert got(writers.upserted(spark, str(tmp_path / "kv"), "k", "at")) == [(1, 5, "c"), (2, 1, "b"), (3, 4, "d")]
    assert got(writers.upserted(spark, str(tmp_path / "kv"), "k", "at", F.col("at") > 4)) == [(1, 5, "c")]
    writers.compact(spark, str(tmp_path / "kv"), "k", "at", str(tmp_path / "next"))
    assert got(spark.read.parquet(str(tmp_path / "next" / "batch=0"))) == [(1, 5, "c"), (2, 1, "b"), (3, 4, "d")]


def test_delayed_messages_wait_for_their_time(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    ms = lambda m: int(at(m).replace(tzinfo=datetime.UTC).timestamp() * 1000)
    for n, rows in enumerate([[(1, "soon", at(0), ms(2)), (2, "later", at(0), ms(30))], [(3, "tick", at(10), ms(50))], [(4, "tick", at(20), ms(20))]]):
        spark.createDataFrame(rows, "id int, body string, ts timestamp, due long").coalesce(1).write.parquet(str(tmp_path / "in" / f"n={n}"))
    stream = spark.readStream.schema("id int, body string, ts timestamp, due long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "n=*")).withWatermark("ts", "0 seconds")
    got = drained(ticks.delayed(stream, "id", "body", "due"), tmp_path, "append")
    assert [(r["id"], r["body"], r["due"]) for r in got] == [(1, "soon", ms(2))]


def test_random_delays_are_whole_seconds(spark):
    sent = spark.range(200).select(F.timestamp_millis(F.lit(1_000_000)).alias("ts"))
    assert {r["due"] - 1_000_000 for r in ticks.with_delay(sent, "ts").collect()} <= {1000 * k for k in range(10)}


def test_selected_and_accepted(spark):
    m = spark.createDataFrame([("t", "a", 1), ("t", "b", 2), ("t", None, 3), ("u", "a", 4)], "topic string, tag string, n int")
    assert [r["n"] for r in readers.selected(m, "t", "a || b").collect()] == [1, 2]
    assert [r["n"] for r in readers.selected(m, "t").collect()] == [1, 2, 3]
    frames = spark.createDataFrame([('{"cmd":200,"data":"x"}',), ('{"cmd":100}',), ("{",), (None,)], "line string")
    assert [r["data"] for r in readers.accepted(frames, "line").collect()] == ["x"]


def test_stamped_name(spark):
    assert spark.range(1).select(writers.stamped("out").alias("n")).where(r"n rlike '^out-\\d{8}-\\d{2}-\\d{2}-\\d{2}$'").count() == 1


def shards_held(df, tmp_path):
    """The rows of a stream and the most states that it held at once."""
    out = []
    q = df.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda b, n: out.extend(map(tuple, b.collect()))).start()
    q.awaitTermination()
    return out, max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress)


def test_delayed_states_do_not_grow_with_messages(spark, tmp_path):
    start = 1_704_067_200_000
    rows = spark.range(3000).select(F.when(F.col("id") != 7, F.col("id") + 2**60).alias("id"), F.format_string("b%d", "id").alias("body"), F.timestamp_millis(F.lit(start) + F.col("id") * 1000).alias("ts"), (F.lit(start) + F.col("id") * 1000 + F.col("id") % 3 * 1_000_000).alias("due"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "0 seconds")
    got, states = shards_held(ticks.delayed(stream, "id", "body", "due"), tmp_path)
    assert states <= ticks.SHARDS + 1
    assert sorted(got, key=repr) == sorted(map(tuple, rows.where(F.col("due") < start + 2_999_000).select("id", "body", "due").collect()), key=repr) and any(r[0] is None for r in got)


def test_silent_states_do_not_grow_with_keys(spark, tmp_path):
    start = 1_704_067_200_000
    for n in range(3):  # every third key comes once more at each turn
        spark.range(2000).where(F.col("id") % 3 >= n).select(F.when(F.col("id") != 6, F.col("id").cast("string")).alias("k"), F.timestamp_millis(F.lit(start + n * 600_000)).alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in" / f"n={n}"))
    stream = spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "n=*")).withWatermark("ts", "1 minute")
    got, states = shards_held(ticks.silent_keys(stream, "k", "ts", 120_000), tmp_path)
    assert states <= ticks.SHARDS + 1
    want = [(None if i == 6 else str(i), start + i % 3 * 600_000) for i in range(2000) if i % 3 < 2]
    assert sorted(got, key=repr) == sorted(want, key=repr)
