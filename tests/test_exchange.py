"""Sinks that commit or abort as a whole, caches and chained streams, run until the input is read up."""

import datetime
import json
import socketserver
import threading

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import publisher
from sparkloom.streaming import caches, joins

START = datetime.datetime(2024, 1, 1)
EPOCH = 1_704_067_200_000  # the same in milliseconds


class Failing(publisher.Folder):
    """Sends all but the message `bad`, of which tasks fail; sends fail once for each name on the first try."""

    tried: set = set()

    def send(self, name, frames):
        if any(json.loads(f)["body"] == "bad" for f in frames):
            raise ValueError("a message that can't be sent")
        if name not in Failing.tried:
            Failing.tried.add(name)
            raise OSError("the connection is lost")
        super().send(name, frames)


@pytest.fixture
def sink(spark):
    spark.dataSource.register(publisher.PublishSink)
    return lambda df, path, **more: df.write.format("publish").mode("append").options(path=str(path), **more).save()


def bodies(spark, path):
    return sorted(r["body"] for r in publisher.published(spark, str(path)).collect())


def test_publish_all_or_nothing(spark, sink, tmp_path):
    rows = spark.range(40).repartition(4).select(F.col("id").cast("string").alias("body"))
    sink(rows, tmp_path, batch="one", transport="tests.test_exchange:Failing", chunk="7")
    assert bodies(spark, tmp_path) == sorted(str(i) for i in range(40))
    bad = rows.select(F.when(F.col("body") == "17", "bad").otherwise(F.concat(F.lit("x"), "body")).alias("body"))
    with pytest.raises(Exception, match="can't be sent"):
        sink(bad, tmp_path, batch="two", transport="tests.test_exchange:Failing")
    assert bodies(spark, tmp_path) == sorted(str(i) for i in range(40))
    assert not (tmp_path / "published" / "two.json").exists()
    sink(rows, tmp_path, batch="one")  # the same batch again publishes nothing
    assert len(bodies(spark, tmp_path)) == 40
    odd = spark.createDataFrame([("a\nb", "t"), ("", None), (None, "t"), ('"quoted"', "ü")], "body string, topic string")
    sink(odd, tmp_path, batch="three")
    got = {(r["topic"], r["body"]) for r in publisher.published(spark, str(tmp_path)).where("batch = 'three'").collect()}
    assert got == {("t", "a\nb"), (None, ""), ("t", None), ("ü", '"quoted"')}


def test_publish_a_stream_once(spark, tmp_path):
    spark.dataSource.register(publisher.PublishSink)
    for n in range(3):
        spark.range(n * 10, n * 10 + 10).select(F.col("id").cast("string").alias("body")).coalesce(1).write.parquet(str(tmp_path / "in" / f"n={n}"))

    def run(state):
        stream = spark.readStream.schema("body string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "n=*"))
        stream.writeStream.format("publish").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / state)).trigger(availableNow=True).start().awaitTermination()

    run("state")
    assert bodies(spark, tmp_path / "out") == sorted(str(i) for i in range(30))
    run("another-state")  # the same batches, as after a crash between a commit and the checkpoint
    assert bodies(spark, tmp_path / "out") == sorted(str(i) for i in range(30))


def test_publish_to_a_socket(spark, sink, tmp_path):
    staged, delivered, seen = {}, [], []
    lock = threading.Lock()

    class Server(socketserver.StreamRequestHandler):
        def handle(self):
            with lock:
                seen.append(1)
                if len(seen) == 2:
                    return  # hangs up once: the sender tries again
                for line in self.rfile:
                    f = json.loads(line)
                    if "commit" in f:
                        delivered.extend(json.loads(x)["body"] for n in f["staged"] for x in staged.pop(n, {}).values())
                    elif "drop" in f:
                        staged.pop(f["drop"], None)
                    else:
                        staged.setdefault(f["staged"], {})[f["place"]] = f["frame"]
                self.wfile.write(b"ok\n")

    with socketserver.ThreadingTCPServer(("127.0.0.1", 0), Server) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        sink(spark.range(25).repartition(3).select(F.col("id").cast("string").alias("body")), tmp_path, transport="socket", host="127.0.0.1", port=str(server.server_address[1]))
        server.shutdown()
    assert sorted(delivered, key=int) == [str(i) for i in range(25)]


def replay(spark, tmp_path, batches, schema, name="in"):
    import time

    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name / f"n={n}"))
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "n=*"))


def drained(df, tmp_path, name="state"):
    out = []
    df.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).foreachBatch(lambda b, n: out.extend(tuple(r) for r in b.collect())).start().awaitTermination()
    return out


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def test_loading_cache(spark, tmp_path):
    """Loads, hits, refreshes from 5 seconds on, expiry from 10, eviction of the one used longest ago, across batches."""
    asked = [[(0, "a"), (1, "b"), (2, "a")], [(4, "c"), (5, "a"), (6, "b"), (9, "a")], [(14, "c"), (15, "b"), (40, "a")]]
    rows, nr = [], 0
    for batch in asked:
        rows.append([("x", k, f"v{nr + i}", EPOCH + s * 1000, nr + i, at(s)) for i, (s, k) in enumerate(batch)])
        nr += len(batch)
    stream = replay(spark, tmp_path, rows, "cache string, k string, v string, ms long, nr long, ts timestamp").withWatermark("ts", "1 second")
    with caches.state_store(spark):
        got = drained(caches.loading_cache(stream, "cache", "k", "v", "ms", "nr", size=2), tmp_path)
    assert sorted((r[1], r[3], r[4], r[5]) for r in got) == [
        (0, "load", "v0", None), (1, "load", "v1", None), (2, "hit", "v0", None),
        (3, "load", "v3", "b"), (4, "refresh", "v4", None), (5, "load", "v5", "c"), (6, "hit", "v4", None),
        (7, "load", "v7", "b"), (8, "load", "v8", None), (9, "load", "v9", None),
    ]


def test_read_through_deletes_and_reruns(spark, tmp_path):
    source = {0: [(1, "a"), (2, "b")], 1: [(1, "a2"), (2, None), (3, "c")], 2: [(2, "b3"), (3, "c3")]}
    asked = [[(1,), (2,), (9,), (None,)], [(3,)], [(2,), (2,)]]
    write = caches.read_through(str(tmp_path / "c"), "k", lambda keys, n: spark.createDataFrame(source[n], "k long, v string").join(keys, "k", "left_semi"))
    want = [{(1, "a"), (2, "b")}, {(1, "a2"), (3, "c")}, {(2, "b3"), (3, "c3")}]
    for n, rows in enumerate(asked):
        for _ in range(2):  # a batch that runs again leaves the same
            write(spark.createDataFrame(rows, "k long"), n)
            assert {tuple(r) for r in caches.cached(spark, str(tmp_path / "c"), "k", n + 1).select("k", "v").collect()} == want[n]


def test_distinct_counts_with_late_rows(spark, tmp_path):
    rows = [[(at(0), "a"), (at(3), "a"), (at(4), "b")], [(at(12), "a"), (at(8), "c"), (at(9), "b")], [(at(60), "z")], [(at(70), "z")], [(at(2), "late")], [(at(120), "z")]]
    got = drained(joins.distinct_counts(replay(spark, tmp_path, rows, "ts timestamp, k string"), "ts", "k", "10 seconds", "5 seconds"), tmp_path)
    assert sorted(got) == [(at(0), 3), (at(10), 1), (at(60), 1), (at(70), 1)]


def test_while_subscribed(spark, tmp_path):
    events = replay(spark, tmp_path, [[(1, 7, at(5)), (2, 7, at(50))], [(3, 7, at(75)), (4, 8, at(20)), (5, 7, at(30))]], "id long, account long, ts timestamp", "events")
    commands = replay(spark, tmp_path, [[(7, "x", at(10))], [(7, "x", at(20)), (7, "y", at(5)), (8, "x", at(21)), (7, "x", at(75))]], "account long, channel string, at timestamp", "commands")
    got = drained(joins.while_subscribed(events, "id", "account", "ts", commands, "channel", "at", "30 seconds"), tmp_path)
    assert sorted(got) == [(1, "y"), (3, "x"), (5, "x"), (5, "y")]


def test_slices_are_one_batch_of_several_files(spark, tmp_path, monkeypatch):
    """Slices of 1000, 3 and 400 events in files of about 50: each slice is one batch, and no file holds it whole."""
    from sparkloom.plans import exchange

    monkeypatch.setattr(exchange, "FILE_ROWS", 50, raising=False)
    at = F.expr("case when id < 1000 then id when id < 1003 then 400000 + id else 800000 + id end")
    events = spark.range(1403).select(F.col("id").alias("event_id"), F.timestamp_seconds(at + EPOCH // 1000).cast("timestamp_ntz").alias("ts"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    stream = exchange._replayed(spark, str(tmp_path)).select("event_id", "slice", F.input_file_name().alias("file"))
    got = exchange._drained(spark, stream, "append")
    assert {(r["_batch"], r["slice"]): (r["n"], r["files"] > 1) for r in got.groupBy("_batch", "slice").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files")).collect()} == {(0, 0): (1000, True), (1, 1): (3, True), (2, 2): (400, True)}
