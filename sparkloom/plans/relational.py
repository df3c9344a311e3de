"""Relational queries: projections, filters, joins, aggregates, windows and sets on the generated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys in many tasks however few bytes it has: for joins that make many rows of few."""
    return df.repartition(max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


# Projections and filters


@query("p01_concat_sorted", "SELECT r_regionkey::VARCHAR || '#' || r_name AS entry FROM region")
def p01(spark, d):
    return table(spark, d, "region").orderBy("r_regionkey").select(F.concat_ws("#", F.col("r_regionkey").cast("string"), "r_name").alias("entry"))


@query("p02_not_like", "SELECT p_partkey, p_name FROM part WHERE NOT contains(p_name, '.') AND NOT starts_with(p_type, 'PROMO') AND NOT starts_with(p_type, 'SMALL')")
def p02(spark, d):
    c = F.col("p_type")
    return table(spark, d, "part").where(~F.contains("p_name", F.lit(".")) & ~c.startswith("PROMO") & ~c.startswith("SMALL")).select("p_partkey", "p_name")


@query("p03_replace_chain", "SELECT page_id, replace(replace(replace(replace(url, 'https://', ''), 'http://', ''), 'www.', ''), 'example', 'site') AS short FROM pages")
def p03(spark, d):
    c = F.col("url")
    for old, new in (("https://", ""), ("http://", ""), ("www.", ""), ("example", "site")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return table(spark, d, "pages").select("page_id", c.alias("short"))


@query("p04_array_element_text", "SELECT event_id, split(floor(value)::BIGINT::VARCHAR || ',' || (event_id % 3)::VARCHAR, ',')[2] AS second FROM events WHERE split(floor(value)::BIGINT::VARCHAR || ',' || (event_id % 3)::VARCHAR, ',')[2] <> '0'")
def p04(spark, d):
    arr = F.split(F.concat_ws(",", F.floor("value").cast("string"), (F.col("event_id") % 3).cast("string")), ",")
    return table(spark, d, "events").select("event_id", F.element_at(arr, 2).alias("second")).where("second != '0'")


@query("p05_first_segment", "SELECT DISTINCT split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 2) AS segment FROM pages")
def p05(spark, d):
    return table(spark, d, "pages").select(F.split_part(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("/"), F.lit(2)).alias("segment")).distinct()


@query("p06_map_values", "SELECT event_id, v AS item FROM (SELECT event_id, unnest([event_type, user_id::VARCHAR]) AS v FROM events)")
def p06(spark, d):
    m = F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    return table(spark, d, "events").select("event_id", F.explode(F.map_values(m)).alias("item"))


@query("p07_extract_or_null", "SELECT event_id, nullif(regexp_extract(props, '\"k\": ([0-9])[0-9]', 1), '') AS tens FROM events")
def p07(spark, d):
    from ..functions.texts import extracted

    return table(spark, d, "events").select("event_id", extracted(F.col("props"), '"k": ([0-9])[0-9]').alias("tens"))


@query("p08_extract_all", "SELECT item_id, split_part(trim(w), ' ', 1) AS word FROM (SELECT item_id, unnest(regexp_extract_all(text, '([A-Z][a-z]+ [a-z]+)', 1)) AS w FROM benchmark)")
def p08(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+ [a-z]+)"), F.lit(1))).alias("w")).select("item_id", F.split_part("w", F.lit(" "), F.lit(1)).alias("word"))


@query("p09_next_of_kind", """SELECT event_id, (SELECT min(e2.event_id) FROM events e2 WHERE e2.user_id = e.user_id AND e2.event_type = 'click' AND e2.event_id > e.event_id) AS next_click
FROM events e WHERE event_type = 'view'""")
def p09(spark, d):
    # Backwards, so that the frame only grows and each row costs the same.
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    click = F.when(F.col("event_type") == "click", F.col("event_id"))
    return table(spark, d, "events").withColumn("next_click", F.last(click, ignorenulls=True).over(w)).where("event_type = 'view'").select("event_id", "next_click")


@query("p10_not_containing", "SELECT page_id FROM pages WHERE NOT contains(url, '/en/')")
def p10(spark, d):
    return table(spark, d, "pages").where(~F.contains("url", F.lit("/en/"))).select("page_id")


@query("p11_tuple_in", "SELECT c_custkey, c_name FROM customer WHERE (c_nationkey, c_mktsegment) IN ((1, 'BUILDING'), (2, 'MACHINERY'), (3, 'AUTOMOBILE'))")
def p11(spark, d):
    pairs = [(1, "BUILDING"), (2, "MACHINERY"), (3, "AUTOMOBILE")]
    any_of = F.lit(False)
    for n, s in pairs:
        any_of = any_of | ((F.col("c_nationkey") == n) & (F.col("c_mktsegment") == s))
    return table(spark, d, "customer").where(any_of).select("c_custkey", "c_name")


@query("p12_present_concat", "SELECT doc_id, source || '.' || lang AS k FROM documents WHERE source IS NOT NULL AND source <> ''")
def p12(spark, d):
    return table(spark, d, "documents").where("source is not null and source != ''").select("doc_id", F.concat("source", F.lit("."), "lang").alias("k"))


@query("p13_typed_message", "SELECT event_id, value FROM events WHERE event_type = 'purchase' AND user_id % 10 IN (0, 1, 6) AND trim(props) <> ''")
def p13(spark, d):
    return table(spark, d, "events").where((F.col("event_type") == "purchase") & (F.col("user_id") % 10).isin(0, 1, 6) & (F.trim("props") != "")).select("event_id", "value")


@query("p14_prefixes", "SELECT p_partkey, p_type FROM part WHERE starts_with(p_type, 'ECONOMY') OR starts_with(p_type, 'STANDARD')")
def p14(spark, d):
    c = F.col("p_type")
    return table(spark, d, "part").where(c.startswith("ECONOMY") | c.startswith("STANDARD")).select("p_partkey", "p_type")


@query("p15_any_contains", "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'nickel') THEN 'excluded' WHEN contains(lower(p_type), 'brass') OR contains(lower(p_type), 'steel') THEN 'metal' ELSE p_type END AS kind FROM part")
def p15(spark, d):
    low = F.lower("p_type")
    some = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, F.lower(w)))
    return table(spark, d, "part").select("p_partkey", F.when(some(["Nickel"]), "excluded").when(some(["Brass", "Steel"]), "metal").otherwise(F.col("p_type")).alias("kind"))


@query("p16_first_rule", "SELECT page_id, CASE WHEN regexp_matches(url, '/en/') THEN 'english' WHEN regexp_matches(url, '[?]') THEN 'query' WHEN regexp_matches(url, '^https') THEN 'secure' ELSE 'other' END AS kind FROM pages")
def p16(spark, d):
    from ..functions.texts import first_match

    return table(spark, d, "pages").select("page_id", first_match(F.col("url"), [("english", "/en/"), ("query", "[?]"), ("secure", "^https")], "other").alias("kind"))


@query("p17_present_of_columns", "SELECT o_orderkey, list_filter([o_orderstatus, nullif(o_orderpriority, '1-URGENT'), ''], lambda x: x IS NOT NULL AND trim(x) <> '') AS present FROM orders")
def p17(spark, d):
    arr = F.array("o_orderstatus", F.nullif("o_orderpriority", F.lit("1-URGENT")), F.lit(""))
    return table(spark, d, "orders").select("o_orderkey", F.filter(arr, lambda x: x.isNotNull() & (F.trim(x) != "")).alias("present"))


@query("p18_list_of_text", "SELECT p_partkey, list_filter(str_split(p_type || ' ', ' '), lambda x: trim(x) <> '') AS words FROM part")
def p18(spark, d):
    return table(spark, d, "part").select("p_partkey", F.filter(F.split(F.concat("p_type", F.lit(" ")), " "), lambda x: F.trim(x) != "").alias("words"))


@query("p19_codes_to_names", "SELECT c_custkey, (SELECT r_name FROM region WHERE r_regionkey = c_nationkey % 5) || ',' || (SELECT r_name FROM region WHERE r_regionkey = (c_nationkey + 1) % 5) AS names FROM customer")
def p19(spark, d):
    dim = table(spark, d, "region").agg(F.map_from_entries(F.collect_list(F.struct(F.col("r_regionkey").cast("int"), "r_name"))).alias("dim"))
    codes = F.transform(F.split(F.concat_ws(":", (F.col("c_nationkey") % 5).cast("string"), ((F.col("c_nationkey") + 1) % 5).cast("string")), ":"), lambda x: F.element_at(F.col("dim"), x.cast("int")))
    # One row: the dimension of five regions as a map.
    return table(spark, d, "customer").join(F.broadcast(dim), F.lit(True)).select("c_custkey", F.array_join(codes, ",").alias("names"))


@query("p20_array_to_columns", "SELECT p_partkey, str_split(p_type, ' ')[1] AS part1, str_split(p_type, ' ')[2] AS part2, str_split(p_type, ' ')[3] AS part3, str_split(p_type, ' ')[4] AS part4 FROM part")
def p20(spark, d):
    arr = F.split("p_type", " ")
    return table(spark, d, "part").select("p_partkey", *[F.get(arr, F.lit(i)).alias(f"part{i + 1}") for i in range(4)])


@query("p21_row_pick", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 2")
def p21(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").withColumn("n", F.row_number().over(w)).where("n = 2").select("o_custkey", "o_orderkey")


@query("p22_enum_member", "SELECT event_id, lower(event_type) IN ('click', 'view') AND user_id % 4 IN (1, 2) AS known FROM events")
def p22(spark, d):
    return table(spark, d, "events").select("event_id", (F.lower("event_type").isin("click", "view") & (F.col("user_id") % 4).isin(1, 2)).alias("known"))


@query("p23_fill_from", "SELECT c.c_custkey, coalesce(nullif(c.c_mktsegment, 'BUILDING'), n.n_name) AS filled FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey")
def p23(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select("c_custkey", F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), "n_name").alias("filled"))


@query("p24_renamed", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance FROM supplier")
def p24(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))


@query("p25_gateway", "SELECT event_id, CASE WHEN value < 3 THEN 'short' WHEN value >= 3 THEN 'long' END AS branch FROM events")
def p25(spark, d):
    return table(spark, d, "events").select("event_id", F.when(F.col("value") < 3, "short").when(F.col("value") >= 3, "long").alias("branch"))


@query("p26_finished_latest", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def p26(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").orderBy(F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "o_orderdate")


@query("p27_first_failing_rule", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 45 THEN 'quantity' WHEN l_discount > 0.08 THEN 'discount' WHEN l_tax > 0.07 THEN 'tax' END AS failed FROM lineitem")
def p27(spark, d):
    rules = [("quantity", F.col("l_quantity") > 45), ("discount", F.col("l_discount") > 0.08), ("tax", F.col("l_tax") > 0.07)]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(*[F.when(c, F.lit(n)) for n, c in rules]).alias("failed"))


# Joins


@query("j01_equi_join", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 40")
def j01(spark, d):
    return table(spark, d, "lineitem").where("l_quantity > 40").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey")


@query("j02_union_of_resolutions", """SELECT DISTINCT c_custkey, n_nationkey FROM (
SELECT c_custkey, n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT c_custkey, n_nationkey FROM customer JOIN nation ON c_nationkey % 5 = n_regionkey AND n_nationkey < 5
UNION ALL SELECT c_custkey, n_nationkey FROM customer JOIN nation ON c_custkey % 25 = n_nationkey)""")
def j02(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    ways = [c.c_nationkey == n.n_nationkey, (c.c_nationkey % 5 == n.n_regionkey) & (n.n_nationkey < 5), c.c_custkey % 25 == n.n_nationkey]
    out = [c.join(n, w).select("c_custkey", "n_nationkey") for w in ways]
    return out[0].unionByName(out[1]).unionByName(out[2]).distinct()


@query("j03_anti_ordered", "SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1-%')")
def j03(spark, d):
    used = table(spark, d, "orders").where(F.col("o_orderpriority").startswith("1-"))
    return table(spark, d, "customer").join(used, F.col("c_custkey") == F.col("o_custkey"), "left_anti").orderBy("c_nationkey", "c_mktsegment", "c_name", "c_acctbal", "c_custkey").select("c_custkey", "c_nationkey")


@query("j04_anti", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 48)")
def j04(spark, d):
    used = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 48")
    return table(spark, d, "part").join(used, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("j05_retained_reasons", """SELECT c_custkey, list_sort(list(DISTINCT reason)) AS reasons FROM (
SELECT o_custkey AS c_custkey, 'order' AS reason FROM orders WHERE o_totalprice > 300000
UNION ALL SELECT c_custkey, 'balance' FROM customer WHERE c_acctbal > 9000) GROUP BY c_custkey""")
def j05(spark, d):
    a = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"), F.lit("order").alias("reason"))
    b = table(spark, d, "customer").where("c_acctbal > 9000").select("c_custkey", F.lit("balance").alias("reason"))
    return a.unionByName(b).groupBy("c_custkey").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))


@query("j06_expansion_union", """SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem
UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier""")
def j06(spark, d):
    a = table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))
    b = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("dst"))
    return a.unionByName(b).distinct()


@query("j07_anti_ignoring_contracts", """SELECT c_custkey FROM customer WHERE NOT EXISTS (
SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'P' AND o_custkey % 7 <> o_orderkey % 7)""")
def j07(spark, d):
    real = table(spark, d, "orders").where("o_orderstatus != 'P' and o_custkey % 7 != o_orderkey % 7")
    return table(spark, d, "customer").join(real, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("j08_lookup", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def j08(spark, d):
    return table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name")


@query("j09_theta_pairs", """SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey
WHERE (1 - levenshtein(a.p_type, b.p_type)::DOUBLE / greatest(length(a.p_type), length(b.p_type))) * 100 >= 70""")
def j09(spark, d):
    # Types of one brand and size are compared once each; then those near each other are given their parts.
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_type")
    types = p.select("p_brand", "p_size", "p_type").distinct()
    a, b = types.withColumnRenamed("p_type", "ta"), types.withColumnRenamed("p_type", "tb")
    rate = (1 - F.levenshtein("ta", "tb").cast("double") / F.greatest(F.length("ta"), F.length("tb"))) * 100
    near = a.join(b, ["p_brand", "p_size"]).where(rate >= 70)
    left = near.join(p.select(F.col("p_partkey").alias("a"), "p_brand", "p_size", F.col("p_type").alias("ta")), ["p_brand", "p_size", "ta"])
    right = p.select(F.col("p_partkey").alias("b"), "p_brand", "p_size", F.col("p_type").alias("tb"))
    keys = ["p_brand", "p_size", "tb"]
    return _spread(left, *keys).join(_spread(right, *keys), keys).where("a < b").select("a", "b")


@query("j09_similar_names", """WITH t AS (SELECT p_name, min(p_partkey) AS low FROM part WHERE p_name <> '' GROUP BY p_name)
SELECT a.low AS a, b.low AS b FROM t a JOIN t b ON a.low < b.low AND round((1 - levenshtein(a.p_name, b.p_name)::DOUBLE / greatest(length(a.p_name), length(b.p_name))) * 100, 1) >= 70""")
def j09_names(spark, d):
    from ..operators.similarity import close_texts

    names = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("low"))
    return close_texts(names, "low", "p_name", 70.0, [])


# Paths with their host as the first part, and two templates from each: its host with any language and page, and any host with its own.
_PATHS = r"""p AS (SELECT page_id, '/' || regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', '') AS path FROM pages),
s AS (SELECT split_part(path, '/', 2) AS host, split_part(path, '/', 3) AS lang, split_part(path, '/', 4) AS page FROM p),
t AS (SELECT DISTINCT unnest(['/' || host || '/{lang}/{page}', '/{host}/' || lang || '/' || page, '/' || host || '/' || lang || '/{page}.html']) AS template FROM s)"""


@query("j10_template_masks", rf"WITH {_PATHS} SELECT page_id, template FROM p JOIN t ON regexp_full_match(path, regexp_replace(regexp_replace(template, '([.+*?^$()|])', '\\\1', 'g'), '\{{[^}}]*\}}', '[^/]+', 'g'))")
def j10_masks(spark, d):
    from ..operators.templates import match_templates

    bare = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "^[a-z]+://", "")
    paths = table(spark, d, "pages").select("page_id", F.concat(F.lit("/"), bare).alias("path"))
    host, lang, page = (F.split_part("path", F.lit("/"), F.lit(i)) for i in (2, 3, 4))
    kinds = F.array(F.concat(F.lit("/"), host, F.lit("/{lang}/{page}")), F.concat(F.lit("/{host}/"), lang, F.lit("/"), page), F.concat(F.lit("/"), host, F.lit("/"), lang, F.lit("/{page}.html")))
    return match_templates(paths, "path", paths.select(F.explode(kinds).alias("template")), "template").select("page_id", "template")


@query("j10_path_templates", """SELECT page_id, t AS template FROM (SELECT page_id, '/' || split_part(regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '^[a-z]+://', ''), '/', 2) || '/' || split_part(regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '^[a-z]+://', ''), '/', 3) AS path FROM pages)
JOIN (VALUES ('/en/{id}', '^/en/[^/]+$'), ('/{lang}/825', '^/[^/]+/825$'), ('/fr/{id}', '^/fr/[^/]+$')) v(t, p) ON regexp_matches(path, p)""")
def j10(spark, d):
    from ..functions.texts import template_pattern

    bare = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "^[a-z]+://", "")
    path = F.concat(F.lit("/"), F.split_part(bare, F.lit("/"), F.lit(2)), F.lit("/"), F.split_part(bare, F.lit("/"), F.lit(3)))
    templates = spark.createDataFrame([("/en/{id}",), ("/{lang}/825",), ("/fr/{id}",)], "template string").withColumn("_p", template_pattern(F.col("template")))
    # Three templates: a small fixed table.
    return table(spark, d, "pages").select("page_id", path.alias("path")).join(F.broadcast(templates), F.expr("path rlike _p")).select("page_id", "template")


@query("j11_overlap", "SELECT p_partkey FROM part WHERE list_has_any(str_split(p_type, ' '), ['BRASS', 'COPPER'])")
def j11(spark, d):
    return table(spark, d, "part").where(F.arrays_overlap(F.split("p_type", " "), F.array(F.lit("BRASS"), F.lit("COPPER")))).select("p_partkey")


@query("j12_group_by_membership", "SELECT c_custkey, CASE WHEN c_nationkey IN (1, 2, 3) THEN 0 WHEN c_nationkey IN (3, 4, 5) THEN 1 END AS grp FROM customer")
def j12(spark, d):
    members = spark.createDataFrame([(0, [1, 2, 3]), (1, [3, 4, 5])], "grp int, members array<int>").select("grp", F.explode("members").alias("m")).groupBy("m").agg(F.min("grp").alias("grp"))
    return table(spark, d, "customer").join(F.broadcast(members), F.col("c_nationkey") == F.col("m"), "left").select("c_custkey", "grp")


@query("j13_subscriptions", "SELECT event_id, 'ch' || c AS channel FROM events JOIN (VALUES (0), (1), (2)) v(c) ON user_id % 5 IN (c, c + 1)")
def j13(spark, d):
    subs = spark.createDataFrame([(f"ch{c}", [c, c + 1]) for c in range(3)], "channel string, accounts array<int>").select("channel", F.explode("accounts").alias("account"))
    return table(spark, d, "events").withColumn("_k", (F.col("user_id") % 5).cast("int")).join(F.broadcast(subs), F.col("_k") == F.col("account")).select("event_id", "channel")


@query("j14_enum_dimension", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' WHEN 'P' THEN 'pending' END AS status FROM orders")
def j14(spark, d):
    dim = spark.createDataFrame([("F", "finished"), ("O", "open"), ("P", "pending")], "code string, status string")
    return table(spark, d, "orders").join(F.broadcast(dim), F.col("o_orderstatus") == F.col("code"), "left").select("o_orderkey", "status")


@query("j15_both_directions", "SELECT n_nationkey AS src, n_regionkey + 100 AS dst FROM nation UNION SELECT n_regionkey + 100, n_nationkey FROM nation")
def j15(spark, d):
    e = table(spark, d, "nation").select(F.col("n_nationkey").alias("src"), (F.col("n_regionkey") + 100).alias("dst"))
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


#: Tasks for the keys of one brand.
J16_PARTS = 16


@query("j16_resolved_and_named", """SELECT DISTINCT a.p_partkey AS impl, b.p_partkey AS base FROM part a JOIN part b
ON b.p_partkey = a.p_partkey // 2 WHERE a.p_size > 40
UNION SELECT a.p_partkey, b.p_partkey FROM part a JOIN part b ON a.p_brand = b.p_brand AND b.p_size = 1 AND a.p_size = 50""")
def j16(spark, d):
    p = table(spark, d, "part")
    # The brands of each key on either side: a pair that several brands name comes by the least, so no pairs are kept to find it again.
    brands = lambda size, name: p.where(F.col("p_size") == size).where("p_brand is not null").groupBy(F.col("p_partkey").alias(name)).agg(F.collect_set("p_brand").alias(f"{name}_brands"))
    impl, base = brands(50, "impl"), brands(1, "base")
    shared = F.array_intersect("impl_brands", "base_brands")
    single = (F.size("impl_brands") == 1) & (F.size("base_brands") == 1)
    # One brand's keys are dealt out to J16_PARTS tasks on one side, and go to all of these on the other.
    dealt = impl.select("*", F.explode("impl_brands").alias("brand"), F.pmod(F.xxhash64("impl"), F.lit(J16_PARTS)).alias("part"))
    copied = base.select("*", F.explode("base_brands").alias("brand"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(J16_PARTS - 1).cast("long"))).alias("part"))
    named = _spread(dealt, "brand", "part").join(_spread(copied, "brand", "part"), ["brand", "part"]).where(single | (F.array_min(shared) == F.col("brand"))).select("impl", "base")
    a, b = p.where("p_size > 40").select(F.col("p_partkey").alias("impl")), p.select(F.col("p_partkey").alias("base"))
    resolved = a.distinct().join(b.distinct(), F.expr("base = impl div 2")).join(impl, "impl", "left").join(base, "base", "left")
    return resolved.where(F.coalesce(~F.arrays_overlap("impl_brands", "base_brands"), F.lit(True))).select("impl", "base").unionByName(named)


@query("j17_best_candidate", """SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'R' DESC, l_quantity DESC, l_linenumber) AS n FROM lineitem) WHERE n = 1""")
def j17(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy((F.col("l_returnflag") == "R").desc(), F.desc("l_quantity"), "l_linenumber")
    return table(spark, d, "lineitem").withColumn("n", F.row_number().over(w)).where("n = 1").select("l_orderkey", "l_linenumber")


# Aggregates


@query("a01_group_count", "SELECT count(*)::VARCHAR || '::' || event_type AS entry FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
def a01(spark, d):
    counts = table(spark, d, "events").where("event_type is not null").groupBy("event_type").count()
    return counts.orderBy("count", "event_type").select(F.concat_ws("::", F.col("count").cast("string"), "event_type").alias("entry"))


@query("a02_key_counts", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def a02(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))


_DAILY = "SELECT date_trunc('day', ts)::DATE AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1"


def _daily(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("a03_running_total", f"SELECT day, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS total FROM ({_DAILY})")
def a03(spark, d):
    # One row a day goes through the window, after partial aggregation.
    return _daily(spark, d).select("day", F.sum("n").over(Window.orderBy("day")).alias("total"))


@query("a04_delta_of_snapshots", f"SELECT day, n - coalesce(lag(n) OVER (ORDER BY day), 0) AS delta FROM ({_DAILY})")
def a04(spark, d):
    return _daily(spark, d).select("day", (F.col("n") - F.coalesce(F.lag("n").over(Window.orderBy("day")), F.lit(0))).alias("delta"))


@query("a05_distinct_per_interval", f"SELECT day, users FROM ({_DAILY})")
def a05(spark, d):
    return _daily(spark, d).select("day", "users")


@query("a06_rank_list", "SELECT list_reverse(list_sort(list(n))) AS counts, CAST(sum(n) AS BIGINT) AS total FROM (SELECT count(*) AS n FROM events GROUP BY event_type)")
def a06(spark, d):
    n = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.agg(F.sort_array(F.collect_list("n"), False).alias("counts"), F.sum("n").alias("total"))


@query("a07_ratio", "SELECT round(count(*) FILTER (WHERE event_type = 'click')::DOUBLE / count(*), 9) AS ratio FROM events")
def a07(spark, d):
    return table(spark, d, "events").agg(F.round(F.count_if(F.col("event_type") == "click") / F.count("*"), 9).alias("ratio"))


@query("a08_joined_texts", "SELECT n_regionkey, string_agg(n_name, '##' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def a08(spark, d):
    table(spark, d, "nation").createOrReplaceTempView("_nation")
    return spark.sql("SELECT n_regionkey, listagg(n_name, '##') WITHIN GROUP (ORDER BY n_name) AS names FROM _nation GROUP BY n_regionkey")


@query("a09_rows_by_group", "SELECT c_nationkey, list_sort(list(c_custkey)) AS custs FROM customer GROUP BY c_nationkey")
def a09(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_list("c_custkey")).alias("custs"))


@query("a10_distinct", "SELECT DISTINCT p_brand, p_size FROM part")
def a10(spark, d):
    return table(spark, d, "part").select("p_brand", "p_size").distinct()


@query("a11_common_prefix", """SELECT string_agg(part, '/' ORDER BY i) AS prefix FROM (SELECT i, min(part) AS part, bool_and(lo) OVER (ORDER BY i) AS ok FROM
(SELECT i, min(p) AS part, count(DISTINCT p) = 1 AND count(*) = (SELECT count(*) FROM customer) AS lo FROM (SELECT unnest([1, 2]) AS i, unnest(str_split(c_name, '#')[1:2]) AS p FROM customer) GROUP BY i) GROUP BY i, lo) WHERE ok""")
def a11(spark, d):
    c = table(spark, d, "customer").select(F.posexplode(F.slice(F.split("c_name", "#"), 1, 2)).alias("i", "p"), F.lit(1).alias("_one"))
    total = table(spark, d, "customer").agg(F.count("*").alias("total"))
    level = c.groupBy("i").agg(F.min("p").alias("part"), F.max("p").alias("hi"), F.count("*").alias("n")).join(F.broadcast(total), F.lit(True))
    ok = level.withColumn("ok", F.bool_and((F.col("part") == F.col("hi")) & (F.col("n") == F.col("total"))).over(Window.orderBy("i"))).where("ok")
    # sort_array of (position, part) restores the order; groups are path depths.
    return ok.agg(F.nullif(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "part"))), lambda x: x["part"]), "/"), F.lit("")).alias("prefix"))


_SPANS = "SELECT user_id, event_id // 7 AS lo, event_id // 7 + event_id % 5 AS hi FROM events"


@query("a11_prefix_of_groups", """WITH u AS (SELECT page_id % 40 AS grp, str_split(split_part(url, '?', 1), '/') AS parts FROM pages WHERE url IS NOT NULL), n AS (SELECT grp, count(*) AS n FROM u GROUP BY grp),
p AS (SELECT grp, i, count(*) AS c, count(DISTINCT part) AS k, min(part) AS part FROM (SELECT grp, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS part FROM u) GROUP BY grp, i),
o AS (SELECT p.*, bool_and(c = n AND k = 1) OVER (PARTITION BY grp ORDER BY i) AS ok FROM p JOIN n USING (grp))
SELECT grp, count(i) FILTER (WHERE ok)::INTEGER AS depth, coalesce(string_agg(part, '/' ORDER BY i) FILTER (WHERE ok), '') AS prefix FROM o GROUP BY grp""")
def a11_groups(spark, d):
    from ..operators.windows import common_prefix

    urls = table(spark, d, "pages").where("url is not null").select((F.col("page_id") % 40).alias("grp"), F.split_part("url", F.lit("?"), F.lit(1)).alias("path"))
    return common_prefix(urls, "grp", "path")


@query("a12_merged_intervals", f"""SELECT user_id, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM
(SELECT *, CASE WHEN lo <= coalesce(max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -10) + 1 THEN 0 ELSE 1 END AS new FROM ({_SPANS}))) GROUP BY user_id, g""")
def a12(spark, d):
    from ..operators.windows import merged_intervals

    return merged_intervals(table(spark, d, "events").select("user_id", F.expr("event_id div 7").alias("lo"), F.expr("event_id div 7 + event_id % 5").alias("hi")), "user_id", "lo", "hi")


@query("a13_least_indent", "SELECT doc_id, min(length(regexp_extract(line, '^[ \\t]*'))) AS indent FROM (SELECT doc_id, unnest(str_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY doc_id")
def a13(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("trim(line) != ''")
    return lines.groupBy("doc_id").agg(F.min(F.length(F.regexp_extract("line", r"^[ \t]*", 0)).cast("long")).alias("indent"))


@query("a14_max", "SELECT max(l_extendedprice) AS top, max(l_shipdate) AS last FROM lineitem")
def a14(spark, d):
    return table(spark, d, "lineitem").agg(F.max("l_extendedprice").alias("top"), F.max("l_shipdate").alias("last"))


@query("a15_token_counts", "SELECT doc_id, token, count(*) AS n FROM (SELECT item_id AS doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS token FROM benchmark) WHERE token <> '' GROUP BY 1, 2")
def a15(spark, d):
    from ..operators.similarity import token_counts

    return token_counts(table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), "doc_id", "text")


@query("a16_every_member", "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_returnflag <> 'R') AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def a16(spark, d):
    every = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.every(F.col("l_returnflag") != "R").alias("ok")).where("ok")
    return every.join(table(spark, d, "orders").where("o_orderstatus = 'P'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("l_orderkey")


@query("a17_conditional_counts", "SELECT split_part(p_type, ' ', 1) AS module, count(*) AS files, count(*) FILTER (WHERE p_size < 10) AS small, count(*) FILTER (WHERE p_brand = 'Brand#11') AS brand11 FROM part GROUP BY 1")
def a17(spark, d):
    return table(spark, d, "part").groupBy(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("module")).agg(F.count("*").alias("files"), F.count_if(F.col("p_size") < 10).alias("small"), F.count_if(F.col("p_brand") == "Brand#11").alias("brand11")).orderBy("module")


@query("a18_classified_lists", "SELECT CASE WHEN r_name LIKE 'A%' THEN 'a' WHEN r_name LIKE 'E%' THEN 'e' ELSE 'other' END AS kind, list_sort(list(n_name)) AS names, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def a18(spark, d):
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.groupBy(F.when(F.col("r_name").like("A%"), "a").when(F.col("r_name").like("E%"), "e").otherwise("other").alias("kind")).agg(F.sort_array(F.collect_list("n_name")).alias("names"), F.count("*").alias("n"))


@query("a19_inverted_index", "SELECT word, list_sort(list(DISTINCT item_id)) AS items FROM (SELECT item_id, unnest(regexp_extract_all(text, '([A-Z][a-z]+)', 1)) AS word FROM benchmark) GROUP BY word")
def a19(spark, d):
    w = table(spark, d, "benchmark").select("item_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+)"), F.lit(1))).alias("word"))
    return w.groupBy("word").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


@query("a20_summary", "SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS value FROM orders")
def a20(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.round(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0)), 2).alias("value"))


# Windows, sorts, limits and sets


@query("w01_prefix_sums", "SELECT user_id, event_id, CAST(sum(event_id % 11) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto, CAST(sum(event_id % 11) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS around FROM events")
def w01(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    x = F.sum(F.col("event_id") % 11)
    return table(spark, d, "events").select("user_id", "event_id", x.over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), x.over(w.rowsBetween(-2, 2)).alias("around"))


@query("w02_previous", "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events")
def w02(spark, d):
    return table(spark, d, "events").select("event_id", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("before"))


@query("o01_sort_keys", "SELECT n_nationkey, n_name FROM nation")
def o01(spark, d):
    return table(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_name")


@query("o02_sort_desc", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def o02(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand")


@query("o03_five_keys", "SELECT p_partkey FROM part WHERE p_size < 5")
def o03(spark, d):
    return table(spark, d, "part").where("p_size < 5").orderBy("p_brand", "p_type", "p_size", "p_name", "p_partkey").select("p_partkey")


@query("o04_flag_first", "SELECT o_orderkey, o_orderstatus = 'F' AS finished FROM orders WHERE o_totalprice > 250000")
def o04(spark, d):
    return table(spark, d, "orders").where("o_totalprice > 250000").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("finished")).orderBy(F.desc("finished"), "o_orderkey")


@query("o05_top_eight", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders WHERE o_totalprice > 0) WHERE n <= 8")
def o05(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").where("o_totalprice > 0").withColumn("n", F.row_number().over(w)).where("n <= 8").select("o_custkey", "o_orderkey")


@query("o06_tail_joined", "SELECT p_partkey, array_to_string(str_split(p_type, ' ')[2:], '&') AS tail FROM part")
def o06(spark, d):
    arr = F.split("p_type", " ")
    return table(spark, d, "part").select("p_partkey", F.array_join(F.slice(arr, F.lit(2), F.size(arr)), "&").alias("tail"))


@query("o07_first_present", "SELECT o_orderkey, list_filter([nullif(o_orderstatus, 'F'), nullif(o_orderstatus, 'O'), o_orderpriority], lambda x: x IS NOT NULL)[1] AS first FROM orders")
def o07(spark, d):
    arr = F.array(F.nullif("o_orderstatus", F.lit("F")), F.nullif("o_orderstatus", F.lit("O")), F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", F.get(F.filter(arr, lambda x: x.isNotNull()), F.lit(0)).alias("first"))


@query("o08_eight_references", "SELECT l_suppkey, list_sort(list(DISTINCT l_partkey))[1:8] AS parts FROM lineitem GROUP BY l_suppkey")
def o08(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.slice(F.sort_array(F.collect_set("l_partkey")), 1, 8).alias("parts"))


@query("u01_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def u01(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_custkey"))


@query("u02_array_sets", "SELECT p_partkey, len(list_intersect(str_split(p_type, ' '), ['PROMO', 'BRASS', 'TIN'])) AS common, list_has_all(['PROMO', 'BRASS', 'TIN', 'STEEL'], str_split(p_type, ' ')) AS subset FROM part")
def u02(spark, d):
    words = F.split("p_type", " ")
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    return table(spark, d, "part").select("p_partkey", F.size(F.array_intersect(words, lit(["PROMO", "BRASS", "TIN"]))).cast("long").alias("common"), F.forall(words, lambda w: F.array_contains(lit(["PROMO", "BRASS", "TIN", "STEEL"]), w)).alias("subset"))


@query("u03_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def u03(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))).distinct()


@query("u04_split_callers", """SELECT o_custkey, list_sort(list(DISTINCT o_orderkey) FILTER (WHERE k IS NOT NULL)) AS inside, list_sort(list(DISTINCT o_orderkey) FILTER (WHERE k IS NULL)) AS outside
FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 45) ON o_orderkey = k GROUP BY o_custkey""")
def u04(spark, d):
    big = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("k")).distinct()
    both = table(spark, d, "orders").join(big, F.col("o_orderkey") == F.col("k"), "left")
    some = lambda c: F.sort_array(F.collect_set(F.when(c, F.col("o_orderkey"))))
    inside, outside = some(F.col("k").isNotNull()), some(F.col("k").isNull())
    none = lambda a: F.when(F.size(a) > 0, a)
    return both.groupBy("o_custkey").agg(none(inside).alias("inside"), none(outside).alias("outside"))
