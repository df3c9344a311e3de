"""Caches on streams: a bounded loading cache as keyed state, and read-through of a table kept as versioned deltas."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in the store that state with maps and timers needs."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class _LoadingCache(StatefulProcessor):
    """One cache: its entries are a map state (key -> value, written, used), timers drop those that have expired."""

    def __init__(self, names: tuple[str, str, str, str, str], size: int, expire_ms: int, refresh_ms: int):
        self.names, self.size, self.expire, self.refresh = names, size, expire_ms, refresh_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "key string", "value string, written long, used long")

    def _forget(self, now: int) -> dict[str, tuple]:
        """The entries that haven't expired; the others go."""
        live = {}
        for (key,), entry in list(self.entries.iterator()):
            if now - entry[1] >= self.expire:
                self.entries.removeKey((key,))
            else:
                live[key] = entry
        return live

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        cache, entry_key, value, ts, order = self.names
        asked = pd.concat(list(rows)).sort_values([ts, order], kind="stable")
        live = self._forget(int(asked[ts].iloc[0]))
        before = dict(live)
        out = []
        for k, v, now, nr in zip(asked[entry_key], asked[value], asked[ts], asked[order], strict=True):
            now, evicted = int(now), None
            live = {x: e for x, e in live.items() if now - e[1] < self.expire}
            held = live.pop(k, None)
            action = "load" if held is None else "refresh" if now - held[1] >= self.refresh else "hit"
            live[k] = (held[0], held[1], now) if action == "hit" else (v, now, now)  # the last used stands last
            if len(live) > self.size:
                evicted = min(live, key=lambda x: (live[x][2], list(live).index(x)))
                del live[evicted]
            out.append((key[0], nr, k, action, live[k][0], evicted))
        for k in before.keys() - live.keys():
            self.entries.removeKey((k,))
        for k, entry in live.items():
            if before.get(k) != entry:
                self.entries.updateValue((k,), entry)
        # One timer for what expires first; when it fires, the next is set.
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(min(e[1] for e in live.values()) + self.expire)
        yield pd.DataFrame(out, columns=[cache, order, entry_key, "action", value, "evicted"], dtype=object)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        live = self._forget(expiredTimerInfo.getExpiryTimeInMs())
        if live:
            self.handle.registerTimer(min(e[1] for e in live.values()) + self.expire)
        yield pd.DataFrame({n: [] for n in (self.names[0], self.names[4], self.names[1], "action", self.names[2], "evicted")}, dtype=object)

    def close(self) -> None:
        pass


def loading_cache(requests: DataFrame, cache: str, key: str, value: str, ts: str, order: str, size: int = 8, expire_ms: int = 10_000, refresh_ms: int = 5_000) -> DataFrame:
    """cache, order, key, action, value, evicted of each request(cache, key, value, ts, order); ts: event time, that of the watermark, in epoch milliseconds.

    A request for a key that is held serves the value held (`hit`), or the request's own where it was written refresh_ms
    ago or earlier (`refresh`); a key that isn't held, or expired (written expire_ms ago or earlier), is loaded (`load`).
    Beyond `size` entries the one used longest ago is evicted. requests carry a watermark; each cache is a state of its
    own with at most `size` entries. Run the stream inside `state_store`.
    """
    kinds = dict(requests.dtypes)
    schema = f"{cache} {kinds[cache]}, {order} {kinds[order]}, {key} string, action string, {value} string, evicted string"
    processor = _LoadingCache((cache, key, value, ts, order), size, expire_ms, refresh_ms)
    return requests.groupBy(cache).transformWithStateInPandas(processor, schema, "append", "eventTime")


def read_through(path: str, key: str, load: Callable[[DataFrame, int], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps a cached table of the keys asked for, as one delta for each batch below path.

    load(keys, batch) gives the source's rows of some keys, as of that batch; keys that it leaves out, or gives with nulls
    only, are deleted from the cache. Every batch refreshes the keys held and loads those asked for first, both by one
    call. Deltas hold (key, values, _gone); a batch that runs again replaces its own delta and nothing else.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        asked = batch.select(key).where(F.col(key).isNotNull()).distinct()
        held = asked if number == 0 else asked.unionByName(cached(spark, path, key, number).select(key)).distinct()
        fresh = load(held, number)
        values = [c for c in fresh.columns if c != key]
        found = held.join(fresh, key, "left").withColumn("_gone", F.coalesce(*[F.col(c).cast("string") for c in values]).isNull())
        found.withColumn("_at", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def cached(spark: SparkSession, path: str, key: str, before: int) -> DataFrame:
    """The rows that the cache below path holds before a batch: each key's latest, unless that says it is gone."""
    deltas = spark.read.parquet(*[f"{path}/batch={n}" for n in range(before)])
    last = deltas.groupBy(key).agg(F.max_by(F.struct(*deltas.columns), "_at").alias("row")).select("row.*")
    return last.where(~F.col("_gone")).drop("_gone", "_at")
