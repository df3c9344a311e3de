"""Source and sink queries: each writes or parses and reads back, so that results can be compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.storage import stored
from ..sources import database, readers, workbook, writers
from .registry import query
from .relational import table


def _folder(spark, name: str) -> str:
    """A folder for files that a query writes, below the shared one."""
    import uuid

    probe = stored(spark.range(1)).inputFiles()[0]
    return f"{probe.rsplit('/', 2)[0]}/{name}-{uuid.uuid4().hex}"


@query("s01_sheet", "SELECT c_custkey, c_name, nullif(c_mktsegment, '') AS c_mktsegment FROM customer")
def s01(spark, d):
    path = _folder(spark, "sheet")
    writers.sheet(table(spark, d, "customer").select("c_custkey", F.concat(F.lit(" "), "c_name").alias("c_name"), "c_mktsegment"), path)
    return readers.sheet(spark, path, "c_custkey long, c_name string, c_mktsegment string")


@query("s01_workbook", "SELECT c_custkey, c_name, c_acctbal, nullif(trim(c_mktsegment), '') AS c_mktsegment, c_custkey::DOUBLE::VARCHAR AS shown FROM customer")
def s01_workbook(spark, d):
    path = _folder(spark, "workbook")
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit(" "), "c_name").alias("c_name"), "c_acctbal", "c_mktsegment", F.col("c_custkey").alias("shown"))
    workbook.write(rows, path, {"c_custkey": "Number", "c_name": "Name"})
    return workbook.read(spark, path, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string, shown string")


@query("k01_workbook", """SELECT event_id, epoch_us(ts) // 1000 AS ms, date_trunc('milliseconds', ts) AS at, user_id, event_type, value, nullif(trim(props), '') AS props FROM events""")
def k01_workbook(spark, d):
    # Times come back as numbers of milliseconds, and as times.
    path = _folder(spark, "workbook")
    workbook.write(table(spark, d, "events").select("event_id", F.col("ts").alias("ms"), F.col("ts").alias("at"), "user_id", "event_type", "value", "props"), path)
    return workbook.read(spark, path, "event_id long, ms long, at timestamp_ntz, user_id long, event_type string, value double, props string")


@query("s02_csv_records", "SELECT p_partkey::VARCHAR AS k, p_name AS name FROM part WHERE p_partkey % 3 = 0")
def s02(spark, d):
    lines = table(spark, d, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(",", F.col("p_partkey").cast("string"), F.concat(F.lit('"'), "p_name", F.lit('"')), F.lit("x"))).when(F.col("p_partkey") % 3 == 1, " ").otherwise("short").alias("line"))
    return readers.csv_records(lines, "line", 3, 0).select(F.element_at("fields", 1).alias("k"), F.element_at("fields", 2).alias("name"))


@query("s03_csv_fields", "SELECT n_nationkey, n_name || ' \"x\", y' AS name FROM nation")
def s03(spark, d):
    line = F.concat(F.lit('"'), F.col("n_name"), F.lit(' ""x"", y",z'))
    return table(spark, d, "nation").select("n_nationkey", F.element_at(readers.csv_fields(line, 2), 1).alias("name"))


@query("s04_json_body", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(props->>'k' AS BIGINT) END AS k FROM events")
def s04(spark, d):
    broken = F.when(F.col("event_id") % 5 == 0, F.lit("{nope")).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", readers.json_body(broken, "k long").k.alias("k"))


@query("s05_json_file", "SELECT n_name FROM nation WHERE contains(n_name, 'A')")
def s05(spark, d):
    path = _folder(spark, "json")
    table(spark, d, "nation").agg(F.to_json(F.collect_list(F.struct("n_name"))).alias("value")).write.text(path)
    return readers.json_file_lines(spark, path, "n_name", "A")


@query("s06_json_keys", "SELECT event_id, 'k' AS name FROM events")
def s06(spark, d):
    return table(spark, d, "events").select("event_id", F.explode(readers.json_keys(F.concat(F.lit('{"paths":'), "props", F.lit("}")), "$.paths")).alias("name"))


@query("s08_file_tree", "SELECT n_nationkey, n_name FROM nation")
def s08(spark, d):
    path = _folder(spark, "tree")
    table(spark, d, "nation").select(F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name").alias("value"), "n_regionkey").write.partitionBy("n_regionkey").text(path)
    files = readers.source_files(spark, path, "*.txt")
    lines = files.select(F.explode(F.split(F.rtrim(F.regexp_replace("text", "\n$", "")), "\n")).alias("line"))
    return lines.select(F.split_part("line", F.lit(","), F.lit(1)).cast("int").alias("n_nationkey"), F.split_part("line", F.lit(","), F.lit(2)).alias("n_name"))


@query("s09_mapper_xml", "SELECT n_nationkey, 'find' || n_nationkey AS id, 'select a from t where n = 1' AS sql FROM nation")
def s09(spark, d):
    k = F.col("n_nationkey").cast("string")
    xml = F.concat(F.lit('<mapper namespace="m"><select id="find'), k, F.lit('">select a\n from t  where n = 1</select></mapper>'))
    return table(spark, d, "nation").select("n_nationkey", F.inline(readers.mapper_statements(xml))).select("n_nationkey", "id", "sql")


@query("s15_binary_files", "SELECT n_name, length(n_name) + 1 AS length FROM nation")
def s15(spark, d):
    path = _folder(spark, "binary")
    # One file a folder, each with one name and a line feed.
    table(spark, d, "nation").select("n_name", F.col("n_name").alias("name")).write.partitionBy("name").text(path)
    files = readers.binary_files(spark, f"{path}/name=*", "*.txt")
    return files.select(F.rtrim(F.regexp_replace(F.col("content").cast("string"), "\n$", "")).alias("n_name"), "length")


@query("s16_one_hop", "SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem WHERE l_suppkey = 1")
def s16(spark, d):
    e = table(spark, d, "lineitem").select(F.lit("SUPPLIES").alias("type"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")).distinct()
    return readers.one_hop(e, spark.createDataFrame([("s1",)], "node string"), "SUPPLIES")


@query("k03_quoted_csv", "SELECT p_partkey, p_name FROM part")
def k03(spark, d):
    path = _folder(spark, "quoted")
    writers.quoted_csv(table(spark, d, "part").select("p_partkey", "p_name"), path)
    return spark.read.csv(path, schema="p_partkey long, p_name string", header=True, escape='"')


@query("k04_lines", "SELECT n_name AS value FROM nation")
def k04(spark, d):
    path = _folder(spark, "lines")
    writers.lines(table(spark, d, "nation"), "n_name", path)
    return spark.read.text(path)


@query("k10_compressed", "SELECT n_name FROM nation")
def k10(spark, d):
    path = _folder(spark, "compressed")
    writers.compressed_lines(table(spark, d, "nation"), "n_name", path)
    return spark.read.text(path).select(F.unbase64("value").cast("string").alias("n_name"))


@query("k05_jdbc", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def k05(spark, d):
    # The database that spark.sparkloom.jdbc names; without one an embedded database in memory, which lives in one process, or where
    # executors are apart from the driver, database files that they share. Rows are replaced, then read with the filter pushed down.
    alone = spark.sparkContext.master.partition("[")[0] == "local"
    url = spark.conf.get("spark.sparkloom.jdbc", "jdbc:derby:memory:sparkloom;create=true" if alone else None)
    rows = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    path = None if url else _folder(spark, "database")
    for part in (rows.limit(3), rows):
        if url:
            writers.table_by_jdbc(part, url, "sparkloom_nation", {})
        else:
            database.write(part, path, "sparkloom_nation")
    if url:
        return readers.table_by_jdbc(spark, url, "sparkloom_nation", {}).where("n_regionkey = 1").select("n_nationkey", "n_name")
    return database.read(spark, path, "SELECT n_nationkey, n_name FROM sparkloom_nation WHERE n_regionkey = 1", rows.select("n_nationkey", "n_name").schema)


@query("k09_upsert", """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events)
WHERE n = 1 AND ts + INTERVAL 7 DAY > (SELECT max(ts) FROM events)""")
def k09(spark, d):
    path = _folder(spark, "upsert")
    events = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    write = writers.upsert_parquet(path, "user_id", "event_id")
    for number in (0, 1, 2, 1):  # the second batch is given again after a failure
        write(events.where(F.col("event_id") % 3 == number), number)
    newest = events.agg(F.max("ts")).first()[0]
    alive = F.col("ts") + F.expr("interval 7 days") > F.lit(newest)
    target = _folder(spark, "compacted")
    writers.compact(spark, path, "user_id", "event_id", target)
    return writers.upserted(spark, target, "user_id", "event_id", alive).select("user_id", "event_id", "event_type")


@query("k07_pushed", "SELECT event_id, 'ch' || c AS channel FROM events JOIN (VALUES (0), (1)) v(c) ON user_id IN (c, c + 2)")
def k07(spark, d):
    subs = spark.createDataFrame([(f"ch{c}", [c, c + 2]) for c in range(2)], "channel string, accounts array<long>")
    return writers.pushed(table(spark, d, "events"), subs, "user_id").select("event_id", "channel")


@query("k12_report", """SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS json FROM region""")
def k12(spark, d):
    return writers.report(table(spark, d, "region").select("r_regionkey", "r_name"))
