"""Database files: round trips, and the JDBC query where executors are apart from the driver."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest
from pyspark.sql import functions as F

from sparkloom.sources import database

APART = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__
home, sf = sys.argv[1:]
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.checkpoint.dir", f"file://{home}/shared").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", f"{home}/warehouse").getOrCreate()
print(sorted(map(tuple, __spark_entry__.queries()["k05_jdbc"](spark, sf).collect())))
spark.stop()
"""


def test_executors_apart(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    home = tmp_path / "home"  # executors log below Spark's home
    home.mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():
        (home / p.name).symlink_to(p)
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_", "SPARK_"))} | {"SPARK_HOME": str(home), "PYTHONPATH": str(Path(__file__).parents[1]), "PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, "-c", APART, str(tmp_path), sf], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    want = sorted(map(tuple, spark.read.parquet(f"{sf}/nation.parquet").where("n_regionkey = 1").select("n_nationkey", "n_name").collect()))
    assert run.returncode == 0 and run.stdout.strip() == str(want), run.stderr[-3000:]


def test_round_trip(spark, tmp_path):
    path, schema = str(tmp_path / "d"), 'i long, `s "x"` string, x double, b boolean, raw binary'
    rows = [(1, "a 'b'", 1.25, True, b"\0\1"), (-(2**63), "", None, False, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema).repartition(3)
    for n in (1, 2):  # rows are replaced
        database.write(df, path, "t one")
        assert sorted(map(repr, map(tuple, database.read(spark, path, 'SELECT * FROM "t one"', schema).collect()))) == sorted(map(repr, rows)), n
    assert [r[0] for r in database.read(spark, path, 'SELECT x FROM "t one" WHERE i = 1', "x double").collect()] == [1.25]
    database.write(df.limit(0), path, "t one")
    assert database.read(spark, path, 'SELECT * FROM "t one"', schema).collect() == []
    with pytest.raises(Exception, match="the database has no"):
        database.write(df.select(F.array("i").alias("i")), path, "t one")


def test_failed_tasks_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "d")
    database.write(spark.range(1000), path, "t")
    bad = spark.range(100).repartition(4).withColumn("id", F.when(F.col("id") == 77, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="stop"):
        database.write(bad, path, "t")
    assert database.read(spark, path, "SELECT id FROM t", "id long").count() == 1000 and all(f.endswith(".sqlite") for f in os.listdir(path))
