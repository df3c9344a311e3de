"""Cutting the lineage of loops: each round's frame goes to the shared folder and is read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """An unused folder below `spark.checkpoint.dir`; a local one only where that is unset and Spark runs in one process."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = getattr(spark.sparkContext, "_sparkloom_rounds", None) or "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext._sparkloom_rounds = top
    return f"{top.rstrip('/')}/sparkloom-rounds/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to a folder that driver and executors share, and read back."""
    path = _folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Growing:
    """A stored frame that rounds add rows to: each round's rows are written once, to a folder of their own."""

    def __init__(self, df: DataFrame):
        self.path, self.schema, self.spark, self.rounds = _folder(df.sparkSession), df.schema, df.sparkSession, 0
        self.add(df)

    def add(self, df: DataFrame) -> None:
        df.write.parquet(f"{self.path}/{self.rounds}")
        self.rounds += 1

    def frame(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{k}" for k in range(self.rounds)])
