"""Writers: delimited text, lines, tables, compressed files, and fan-out of stream batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sheet(df: DataFrame, path: str, headers: dict[str, str] | None = None) -> None:
    """A spreadsheet as CSV with shown names; nulls as empty cells."""
    named = df.withColumnsRenamed(headers or {})
    named.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def quoted_csv(df: DataFrame, path: str, always: bool = True) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", always).option("escape", '"').csv(path)


def lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def stamped(name: str) -> Column:
    """A file name with the time of writing."""
    return F.concat(F.lit(name + "-"), F.date_format(F.current_timestamp(), "yyyyMMdd-HH-mm-ss"))


def table_by_jdbc(df: DataFrame, url: str, name: str, properties: dict[str, str], batch: int = 200) -> None:
    """Replace a table's rows, in batches."""
    df.write.mode("overwrite").option("truncate", True).option("batchsize", batch).jdbc(url, name, properties=properties)


def compressed_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.base64(F.col(column).cast("binary"))).write.mode("overwrite").option("compression", "deflate").text(path)


def report(df: DataFrame) -> DataFrame:
    """Rows as JSON texts."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def fan_out(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that gives each batch to several sinks, reading it once."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for sink in sinks:
                sink(kept, number)
        finally:
            kept.unpersist()

    return write


def upsert_parquet(path: str, key: str, version: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes the latest row of each key of a batch as the delta `batch=n` below path.

    A batch that runs again replaces its own delta; `upserted` merges the deltas.
    """

    def write(batch: DataFrame, number: int) -> None:
        _latest(batch, key, version).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def _latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), version).alias("row")).select("row.*")


def upserted(spark: SparkSession, path: str, key: str, version: str, alive: Column | None = None) -> DataFrame:
    """The latest row of each key over all deltas that `upsert_parquet` wrote; `alive` tells which rows' time to live isn't over.

    An old row of a key whose latest one has expired doesn't come back.
    """
    merged = _latest(spark.read.parquet(f"{path}/batch=*"), key, version)
    return merged if alive is None else merged.where(alive)


def compact(spark: SparkSession, path: str, key: str, version: str, target: str, alive: Column | None = None) -> None:
    """Write the merged rows as the first delta below another folder, for a sink to go on from."""
    upserted(spark, path, key, version, alive).write.mode("overwrite").parquet(f"{target}/batch=0")


def pushed(batch: DataFrame, subscriptions: DataFrame, account: str) -> DataFrame:
    """Rows of a batch for each channel whose accounts hold the row's; subscriptions(channel, accounts)."""
    return batch.join(subscriptions.select("channel", F.explode("accounts").alias(account)), account)
