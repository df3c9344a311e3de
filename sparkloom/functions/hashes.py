"""Digests, ciphers and the consistent-hash ring."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def md5_hex(*cols: Column) -> Column:
    return F.md5(F.concat(*[c.cast("string") for c in cols]).cast("binary"))


def hmac_sha256(key: bytes):
    """A function column -> Base64 of its HMAC-SHA256; there is no built-in, so batches go through pandas."""

    @F.pandas_udf("string")
    def sign(c: pd.Series) -> pd.Series:
        import base64
        import hmac

        return c.map(lambda x: None if x is None else base64.b64encode(hmac.new(key, x.encode(), "sha256").digest()).decode())

    return sign


def aes_base64(c: Column, key: bytes, iv: bytes) -> Column:
    """AES-CBC with PKCS padding and a given start vector, Base64; the engine's copy of the vector in front is cut off."""
    sealed = F.aes_encrypt(c.cast("binary"), F.lit(key), F.lit("CBC"), F.lit("PKCS"), F.lit(iv))
    return F.base64(F.substring(sealed, 17, 1 << 30))


def aes_text(c: Column, key: bytes, iv: bytes) -> Column:
    return F.aes_decrypt(F.concat(F.lit(iv), F.unbase64(c)), F.lit(key), F.lit("CBC"), F.lit("PKCS")).cast("string")


def ring_hash(c: Column) -> Column:
    """First four bytes of the MD5, little-endian, as an unsigned number."""
    h = F.md5(c.cast("string").cast("binary"))
    return F.conv(F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2)), 16, 10).cast("long")


def ring_signed(c: Column) -> Column:
    h = ring_hash(c)
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)


def ring_lookup(keys: DataFrame, key: str, nodes: DataFrame, node: str, replicas: int = 8, bits: int = 12) -> DataFrame:
    """keys with ring_node: the node of the first ring place at or after the key's hash, or else the first place.

    Keys and places are sorted together, backwards, within 2 ** bits slices of the ring (an as-of search by
    window, each row once); a slice without a place at or after a key takes the first place of the slices that follow.
    """
    places = nodes.select(F.col(node).alias("_node"), F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))).alias("_i"))
    places = places.select(ring_signed(F.concat(F.col("_node").cast("string"), F.col("_i").cast("string"))).alias("_h"), "_node")
    part = F.shiftright(F.col("_h"), 32 - bits).alias("_part")
    firsts = places.groupBy(part).agg(F.min(F.struct("_h", "_node")).alias("_first"))
    # 2 ** bits slices: what follows each of them is a small table.
    follow = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    slices = keys.sparkSession.range(-(1 << bits - 1), 1 << bits - 1).select(F.col("id").alias("_part")).join(firsts, "_part", "left")
    start = F.min("_first").over(Window.partitionBy())
    slices = slices.select("_part", F.coalesce(F.last("_first", ignorenulls=True).over(follow), start).getField("_node").alias("_later"))
    hashed = keys.withColumn("_h", ring_signed(F.col(key)))
    both = hashed.withColumn("_node", F.lit(None).cast(places.schema["_node"].dataType)).withColumn("_kind", F.lit(0)).unionByName(places.withColumn("_kind", F.lit(1)), allowMissingColumns=True).withColumn("_part", part)
    ahead = Window.partitionBy("_part").orderBy(F.desc("_h"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_at", F.last("_node", ignorenulls=True).over(ahead)).where("_kind = 0")
    return found.join(F.broadcast(slices), "_part", "left").select(*keys.columns, F.coalesce("_at", "_later").alias("ring_node"))
