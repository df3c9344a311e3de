"""Structured Streaming operators on quote ticks, messages and counters.

The original counts by processing time and can lose ticks between read and reset; here event time
with a watermark is used, so that counts are exact and state is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Fields of a quote line, in order, with their kinds.
QUOTE_FIELDS = "symbol string, pre decimal(20,8), ask decimal(20,8), bid decimal(20,8), open decimal(20,8), close decimal(20,8), high decimal(20,8), low decimal(20,8), spread int, time long, change decimal(20,8), change_rate decimal(20,8), timezone int, precision int, vol decimal(20,8), turnover decimal(20,8), tick_type int"

#: Keyed states of an operator that holds many keys. A running stream can't change it.
SHARDS = 256


def quote(c: Column) -> Column:
    """A quote line as a struct; null if fewer than 16 fields or no market in the symbol, null fields where a number is malformed."""
    row = F.from_csv(c, QUOTE_FIELDS, {"mode": "PERMISSIVE"})
    enough = F.size(F.split(c, ",")) >= 16
    return F.when(enough & F.contains(row["symbol"], F.lit("_")), row)


def symbol_key(c: Column) -> Column:
    return F.struct(F.split_part(c, F.lit("_"), F.lit(1)).try_cast("int").alias("market"), F.split_part(c, F.lit("_"), F.lit(2)).alias("symbol"))


def without_heartbeats(lines: DataFrame, column: str, mark: str = "HEARTBEAT") -> DataFrame:
    return lines.where(~F.col(column).startswith(mark))


def tumbling_counts(ticks: DataFrame, ts: str, key: str, width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """start, key, n: ticks of each key in each window of event time."""
    timed = ticks.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def distinct_per_window(ticks: DataFrame, ts: str, key: str, width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """start, keys: about how many keys each window has (a sketch; exact counts aren't kept in a stream)."""
    timed = ticks.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width)).agg(F.approx_count_distinct(key, 0.01).alias("keys")).select(F.col("window.start").alias("start"), "keys")


def ttl_counts(hits: DataFrame, ts: str, key: str, ttl: str, late: str = "1 minute") -> DataFrame:
    """start, key, n: hits of a key that follow each other within the time to live, renewed by each hit."""
    timed = hits.withColumn(ts, F.col(ts).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark(ts, late)
    return timed.groupBy(F.session_window(ts, ttl), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), key, "n")


def running_totals(ticks: DataFrame, ts: str, key: str, late: str = "10 seconds") -> DataFrame:
    """key, total of all ticks so far, as state of a stream (complete or update mode)."""
    return ticks.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(key).agg(F.count("*").alias("total"))


def last_subscriptions(commands: DataFrame, channel: str, accounts: str, ts: str) -> DataFrame:
    """The last command's accounts of each channel; an empty list clears. State per channel, last write wins."""

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, now = state.get if state.exists else (-1, "")
        for frame in frames:
            for t, a in zip(frame[ts], frame[accounts], strict=True):
                if t >= at:
                    at, now = int(t), a or ""
        state.update((at, now))
        yield pd.DataFrame({channel: [key[0]], accounts: [now], ts: [at]})

    return commands.select(channel, accounts, ts).groupBy(channel).applyInPandasWithState(keep, f"{channel} string, {accounts} string, {ts} long", "at long, accounts string", "update", GroupStateTimeout.NoTimeout)


def _shard(key: str) -> Column:
    """The shard of a key: keyed state holds a share of the keys each, as a state for every key would cost a call of Python each. Nulls have their own."""
    return F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(key), F.lit(SHARDS))).cast("int").alias("_shard")


def silent_keys(ticks: DataFrame, key: str, ts: str, timeout_ms: int) -> DataFrame:
    """key, last of keys from which nothing came for timeout_ms of event time; each silence is told once.

    ticks carry a watermark on ts. A state holds the keys of one shard.
    """

    def watch(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {k: (last, due) for k, last, due in zip(*state.get, strict=True)} if state.exists else {}
        mark, seen = state.getCurrentWatermarkMs(), {}
        for frame in () if state.hasTimedOut else frames:
            for k, last in zip(frame[key].tolist(), (frame[ts].astype("datetime64[ns]").astype("int64") // 1_000_000).tolist(), strict=True):
                seen[k] = max(last, seen.get(k, last))
        # What came now isn't told in the same batch, however old it is.
        gone = [k for k, (_, due) in held.items() if due < mark and k not in seen]
        told = pd.DataFrame({key: gone, "last": [held.pop(k)[0] for k in gone]})
        for k, last in seen.items():
            last = max(last, held[k][0]) if k in held else last
            held[k] = last, max(last + timeout_ms, mark + 1)
        if held:
            state.update((list(held), [last for last, _ in held.values()], [due for _, due in held.values()]))
            state.setTimeoutTimestamp(min(due for _, due in held.values()))
        elif state.exists:
            state.remove()
        yield told

    named = ticks.withColumn(key, F.col(key).cast("string")).select(key, ts, _shard(key))
    return named.groupBy("_shard").applyInPandasWithState(watch, f"{key} string, last long", f"{key} array<string>, last array<long>, due array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def due_messages(messages: DataFrame, due: str, now: Column) -> DataFrame:
    """Messages whose delay is over, for delayed delivery by batches."""
    return messages.where(F.col(due) <= now)


def delayed(messages: DataFrame, key: str, body: str, due: str) -> DataFrame:
    """key, body, due of each message once event time has passed its due time (epoch milliseconds), as state with timers.

    messages carry a watermark on their time of sending. A state holds the messages of one shard of the keys; each leaves it
    on delivery. Of messages with one key that wait together, the last is delivered.
    """

    def hold(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {k: rest for k, *rest in zip(*state.get, strict=True)} if state.exists else {}
        mark, sent = state.getCurrentWatermarkMs(), {}
        for frame in () if state.hasTimedOut else frames:
            sent |= {k: (text, at, max(at, mark + 1)) for k, text, at in zip(frame[key].astype(object).where(frame[key].notna(), None).tolist(), frame[body].tolist(), frame[due].tolist(), strict=True)}
        # What came now waits for the next batch, however early it was due.
        ripe = [k for k, (_, _, timer) in held.items() if timer < mark and k not in sent]
        out = [(k, *held.pop(k)[:2]) for k in ripe]
        held |= sent
        if held:
            texts, dues, timers = zip(*held.values(), strict=True)
            state.update((list(held), list(texts), list(dues), list(timers)))
            state.setTimeoutTimestamp(min(timers))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[key, body, due])

    kind = messages.schema[key].dataType.simpleString()
    dealt = messages.select("*", _shard(key))
    return dealt.groupBy("_shard").applyInPandasWithState(hold, f"{key} {kind}, {body} string, {due} long", f"{key} array<{kind}>, {body} array<string>, {due} array<long>, timer array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def with_delay(messages: DataFrame, ts: str, longest: int = 9) -> DataFrame:
    """messages with `due`, epoch milliseconds: 0 to `longest` whole seconds, at random, after their time of sending."""
    return messages.withColumn("due", F.unix_millis(F.col(ts).cast("timestamp")) + F.floor(F.rand() * (longest + 1)) * 1000)


def order_messages(bodies: DataFrame, column: str, payload: str) -> DataFrame:
    """Envelope(cmd, sendTime, data) and its payload, both from JSON: refreshed orders for reasons 0, 1 or 6 with a payload."""
    envelope = bodies.select(F.from_json(column, "cmd string, sendTime long, data string").alias("e"))
    full = envelope.where("e.cmd = 'ORDER_REFRESH' and trim(e.data) != ''").select("e.sendTime", F.from_json("e.data", payload).alias("order"))
    return full.where(F.col("order.dealReason").isin(0, 1, 6))


def bounded_cache(loads: DataFrame, key: str, ts: str, order: list[str], now: Column, size: int = 8, expire: str = "10 seconds") -> DataFrame:
    """The rows that a cache of bounded size holds at a time: the last load of each key, not expired, the latest `size` of them."""
    past = loads.where(F.col(ts) <= now)
    last = past.groupBy(key).agg(F.max_by(F.struct(*loads.columns), F.struct(ts, *order)).alias("row")).select("row.*")
    return last.where(F.col(ts) + F.expr(f"interval {expire}") > now).orderBy(F.desc(ts), *[F.desc(c) for c in order]).limit(size)


def refreshed(cache: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """A cache after a refresh from its source: source rows win, keys that the source has with nulls only are deleted."""
    values = [c for c in source.columns if c != key]
    gone = source.where(F.coalesce(*[F.col(c).cast("string") for c in values]).isNull()).select(key)
    live = source.join(gone, key, "left_anti")
    return cache.join(source.select(key), key, "left_anti").unionByName(live, allowMissingColumns=True)
