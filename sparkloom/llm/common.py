"""Shared helpers of the training-data operators: shared storage, hashing, held-out folds."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of the word definition `[^\x20\x09-\x0D]+`; `bytes.split()` uses the same six.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`; a local one only where that is unset and Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = getattr(spark.sparkContext, "_sparkloom_shared", None)
        if not folder:
            folder = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
            spark.sparkContext._sparkloom_shared = folder
    return folder.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    """An unused folder name below the shared one."""
    return f"{shared_dir(spark)}/sparkloom/{kind}-{uuid.uuid4().hex}"


#: Spark deletes a write's shuffle files when it ends: what was written is read from there.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, kind: str) -> DataFrame:
    """Write df below the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, kind)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    found = spark.read.schema(df.schema).parquet(path)
    found._sparkloom_path = path
    return found


def inner(name: str) -> str:
    """The name of a column that an operator adds for itself: no column of a caller's table is called so."""
    return f"__sparkloom_{name}"


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder below the shared one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_stored(*frames: DataFrame) -> None:
    """Delete the folders of frames made by stored(), or selected from one, once nothing reads them any more."""
    for df in frames:
        own = getattr(df, "_sparkloom_path", None)
        for folder in [own] if own else {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/sparkloom/" in folder:
                drop_folder(df.sparkSession, folder)


#: Code points of a text that a model may be fitted on; longer ones are left out of the sample (never of the results).
TRAIN_CHARS = 100_000


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """At most so many rows of (doc_id, text, ...), those of the smallest hash of id and text: a sample for the driver that repeated ids can't swell."""
    short = rows.where(F.length("text") <= TRAIN_CHARS)
    return short.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text", *[c for c in rows.columns if c not in ("doc_id", "text")]).limit(most)


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id's decimal text modulo parts; a null id falls into fold 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % parts, F.lit(0))


def release() -> None:
    """Give memory that a Python worker has freed back to the system: workers live on and serve later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # there is no such call outside of glibc
        ctypes.CDLL(None).malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x = x * np.uint64(0x9E3779B97F4A7C15)
        x = x ^ (x >> np.uint64(29))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))
