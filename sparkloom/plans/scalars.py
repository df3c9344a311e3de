"""Queries of scalar functions: numbers, dates, texts, hashes, JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, diffs, hashes, numbers, texts
from .registry import query
from .relational import table


@query("m01_add", "SELECT event_id, coalesce(nullif(event_id % 3, 0), 0) + coalesce(nullif(user_id % 4, 0), 0) AS total FROM events")
def m01(spark, d):
    return table(spark, d, "events").select("event_id", numbers.add(F.nullif(F.col("event_id") % 3, F.lit(0)), F.nullif(F.col("user_id") % 4, F.lit(0))).cast("long").alias("total"))


@query("m02_subtract_multiply", "SELECT l_orderkey, l_linenumber, round(l_extendedprice - l_tax - l_discount, 6) AS less, round(l_extendedprice * l_discount, 6) AS product FROM lineitem")
def m02(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(numbers.subtract(F.col("l_extendedprice"), F.col("l_tax"), F.col("l_discount")), 6).alias("less"), F.round(numbers.multiply(F.col("l_extendedprice"), F.col("l_discount")), 6).alias("product"))


@query("m03_variadic_product", "SELECT p_partkey, p_size::BIGINT * 2 * (p_partkey % 5) AS product FROM part")
def m03(spark, d):
    return table(spark, d, "part").select("p_partkey", numbers.multiply(F.col("p_size").cast("long"), F.lit(2), F.col("p_partkey") % 5).alias("product"))


@query("m04_divide", "SELECT o_orderkey, round(o_totalprice / 7, 9) AS part FROM orders")
def m04(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(numbers.divide(F.col("o_totalprice"), F.lit(7)).cast("double"), 9).alias("part"))


@query("m05_power", "SELECT p_partkey, pow(p_size, 2.0::DOUBLE) AS squared FROM part")
def m05(spark, d):
    return table(spark, d, "part").select("p_partkey", numbers.power(F.col("p_size"), F.lit(2)).alias("squared"))


@query("m06_plain_decimal", "SELECT o_orderkey, regexp_replace(CAST(o_totalprice::DECIMAL(18,4) AS VARCHAR), '\\.?0+$', '') AS shown FROM orders")
def m06(spark, d):
    return table(spark, d, "orders").select("o_orderkey", numbers.plain(F.col("o_totalprice").cast("decimal(18,4)")).alias("shown"))


@query("m07_side_prices", "SELECT event_id, CASE WHEN user_id % 7 IN (0, 2, 4) THEN value WHEN user_id % 7 IN (1, 3, 5) THEN value + 1 END AS opened, CASE WHEN user_id % 7 IN (0, 2, 4) THEN value + 1 WHEN user_id % 7 IN (1, 3, 5) THEN value END AS closed FROM events")
def m07(spark, d):
    side, bid, ask = F.col("user_id") % 7, F.col("value"), F.col("value") + 1
    return table(spark, d, "events").select("event_id", numbers.open_price(side, bid, ask).alias("opened"), numbers.close_price(side, bid, ask).alias("closed"))


@query("m08_below_market", "SELECT event_id, greatest(value - 20, 0.0::DOUBLE) AS price FROM events")
def m08(spark, d):
    return table(spark, d, "events").select("event_id", numbers.below_market(F.col("value"), F.lit(20)).alias("price"))


@query("m09_random_ids")
def m09(spark, d):
    return table(spark, d, "nation").select("n_nationkey", numbers.random_int(1, 7).alias("dice"), numbers.random_id(8).alias("id"))


@query("d01_formats", "SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS compact, strftime(ts, '%H%M') AS hhmm, strftime(ts, '%m/%d/%Y') AS us_day, strftime(ts, '%Y/%m/%d %H:%M:%S') AS stamp FROM events")
def d01(spark, d):
    return table(spark, d, "events").select("event_id", *[dates.formatted(F.col("ts"), n).alias(a) for n, a in (("compact", "compact"), ("hour", "hhmm"), ("us_day", "us_day"), ("full", "stamp"))])


@query("d02_from_millis", "SELECT o_orderkey, strftime(make_timestamp((o_orderkey * 1000003 + 1700000000000) * 1000), '%Y/%m/%d %H:%M:%S') AS shown FROM orders")
def d02(spark, d):
    return table(spark, d, "orders").select("o_orderkey", dates.from_millis(F.col("o_orderkey") * 1000003 + 1700000000000).alias("shown"))


@query("d03_now_in_zone")
def d03(spark, d):
    return table(spark, d, "region").select("r_regionkey", dates.now_in("Asia/Shanghai").alias("now"))


@query("d04_day_bounds", "SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS lo, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS hi FROM events")
def d04(spark, d):
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", dates.start_of_day(ts).cast("timestamp_ntz").alias("lo"), dates.end_of_day(ts).cast("timestamp_ntz").alias("hi"))


@query("d05_survey_window", "SELECT event_id, day(ts) >= 25 OR day(ts) <= 5 AS open FROM events")
def d05(spark, d):
    return table(spark, d, "events").select("event_id", dates.in_survey_window(F.col("ts"), 25, 5).alias("open"))


@query("d06_older_than", "SELECT event_id, floor((event_id % 300) / 60.0) > 1 AS stale FROM events")
def d06(spark, d):
    return table(spark, d, "events").select("event_id", dates.older_than_minutes(F.col("event_id") % 300).alias("stale"))


@query("t01_names", "SELECT item_id, regexp_replace(regexp_replace('  java.util.List<' || item_id || '>  ', '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS folded, 'List' AS short, 'run' AS bare FROM benchmark")
def t01(spark, d):
    raw = F.concat(F.lit("  java.util.List<"), F.col("item_id").cast("string"), F.lit(">  "))
    return table(spark, d, "benchmark").select("item_id", texts.folded(raw).alias("folded"), texts.short_name(texts.trimmed(raw)).alias("short"), texts.without_receiver(F.lit("this.run")).alias("bare"))


@query("t02_type_like", "SELECT p_partkey, regexp_matches(split_part(p_name, ' ', 1), '^[A-Za-z_$][A-Za-z0-9_$.]*$') AND (regexp_matches(p_name, '^[A-Z]') OR contains(split_part(p_name, ' ', 1), '.')) AS is_type FROM part")
def t02(spark, d):
    return table(spark, d, "part").select("p_partkey", texts.is_type_like(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("is_type"))


_ROUTE = "regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''), '/+', '/', 'g')"


@query("t03_routes", f"SELECT page_id, CASE WHEN length(r) > 1 THEN regexp_replace(r, '/$', '') ELSE r END AS route FROM (SELECT page_id, CASE WHEN starts_with(b, '/') THEN b ELSE '/' || b END AS r FROM (SELECT page_id, {_ROUTE} AS b FROM pages))")
def t03(spark, d):
    return table(spark, d, "pages").select("page_id", texts.route(F.regexp_replace("url", "^[a-z]+://[^/?#]*", "")).alias("route"))


@query("t04_path_text", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN '/a' || p_size ELSE '/a' || p_size || '/b' END AS path FROM part")
def t04(spark, d):
    size = F.col("p_size").cast("string")
    raw = F.when(F.col("p_size") % 3 == 0, F.lit("")).when(F.col("p_size") % 3 == 1, F.concat(F.lit("a"), size, F.lit("/"))).otherwise(F.concat(F.lit("/a"), size, F.lit("/b")))
    return table(spark, d, "part").select("p_partkey", texts.path_text(raw).alias("path"))


@query("t05_sql_lines", "SELECT p_partkey, regexp_replace(replace('  ' || chr(9) || p_name || '  ', chr(9), '    '), '\\s+$', '') AS line, substr(regexp_replace('   ' || p_name, '^   ', ' '), 1) AS shifted FROM part")
def t05(spark, d):
    return table(spark, d, "part").select("p_partkey", texts.sql_line(F.concat(F.lit("  \t"), F.col("p_name"), F.lit("  "))).alias("line"), texts.without_indent(F.concat(F.lit("   "), F.col("p_name")), F.lit(2)).alias("shifted"))


@query("t06_edit_distance", "SELECT p_partkey, levenshtein(p_type, p_brand)::BIGINT AS distance FROM part")
def t06(spark, d):
    return table(spark, d, "part").select("p_partkey", F.levenshtein("p_type", "p_brand").cast("long").alias("distance"))


@query("t07_matching_rate", "SELECT p_partkey, round((1 - levenshtein(p_type, p_brand)::DOUBLE / greatest(length(p_type), length(p_brand))) * 100, 1) AS rate FROM part")
def t07(spark, d):
    return table(spark, d, "part").select("p_partkey", texts.matching_rate(F.col("p_type"), F.col("p_brand")).alias("rate"))


_TOKENS = r"list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[\s/_.\-{{}}]+'), lambda w: w <> ''))"


@query("t08_route_similarity", rf"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''), '/+', '/', 'g') AS bare FROM pages),
l AS (SELECT page_id, CASE WHEN starts_with(bare, '/') THEN bare ELSE '/' || bare END AS led FROM p),
r AS (SELECT page_id, CASE WHEN length(led) > 1 THEN regexp_replace(led, '/$', '') ELSE led END AS a, '/en/825/view' AS b FROM l),
t AS (SELECT *, {_TOKENS.format("a")} AS x, {_TOKENS.format("b")} AS y, list_reverse(string_split(regexp_replace(a, '^/', ''), '/')) AS pa, list_reverse(string_split(regexp_replace(b, '^/', ''), '/')) AS pb FROM r),
s AS (SELECT *, len(list_intersect(x, y)) AS shared, len(list_distinct(list_concat(x, y))) AS n, list_transform(range(1, least(len(pa), len(pb)) + 1), lambda i: pa[i] = pb[i]) AS same FROM t)
SELECT page_id, round(CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE 3 * (shared::DOUBLE / n) END + 2 * coalesce(list_position(same, false) - 1, len(same)) / greatest(len(pa), len(pb))::DOUBLE
+ CASE WHEN contains(a, b) THEN 1.0::DOUBLE WHEN contains(b, a) THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END, 6) AS likeness FROM s""")
def t08(spark, d):
    route = texts.route(F.regexp_replace("url", "^[a-z]+://[^/?#]*", ""))
    return table(spark, d, "pages").select("page_id", route.alias("route")).select("page_id", texts.route_similarity(F.col("route"), F.lit("/en/825/view")).alias("likeness"))


_STATEMENTS = [
    ("plain", "select a, b from orders o where o.id = 1", ["orders"]),
    ("joined", "SELECT * FROM orders o LEFT JOIN customer c ON o.c = c.id INNER JOIN nation n ON n.id = c.n", ["orders", "customer", "nation"]),
    ("changed", "UPDATE part SET size = 1 WHERE id IN (SELECT id FROM supplier)", ["part", "supplier"]),
    ("deleted", "delete from lineitem where k = 2", ["lineitem"]),
    ("added", "insert into region (id) values (1) on duplicate key update name = 'x'", ["region"]),
    ("noted", "select 1 -- from nowhere\nfrom events /* from hidden */ join events e2", ["events"]),
]


def _statements(spark):
    return spark.createDataFrame([(n, s) for n, s, _ in _STATEMENTS], "name string, statement string")


@query("t09_sql_tables", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {t})" for n, _, t in _STATEMENTS) + ") v(name, tables)")
def t09(spark, d):
    return _statements(spark).select("name", texts.sql_tables(F.col("statement")).alias("tables"))


@query("t10_sql_tables_or_contained", "SELECT * FROM (VALUES ('a', ['orders']), ('b', ['part'])) v(name, tables)")
def t10(spark, d):
    rows = spark.createDataFrame([("a", "select x from orders"), ("b", "truncate part")], "name string, statement string")
    return rows.select("name", texts.sql_tables_or_contained(F.col("statement"), ["part", "nation"]).alias("tables"))


# Statements made of the rows of a table, with names in comments, strings of several lines and other cases of letters.
_STATEMENT = """'/* from x */ Select k -- join nothing' || chr(10) || 'FROM ' || upper(event_type) || ' e Join `users_' || (user_id % 9) || '` u ON e.k = u.k' || CASE WHEN event_id % 2 = 0 THEN ' join ' || event_type || ' again' ELSE '' END"""


@query("t09_statement_tables", "SELECT event_id, [event_type, 'users_' || (user_id % 9)] AS tables FROM events")
def t09_statements(spark, d):
    return table(spark, d, "events").select("event_id", texts.sql_tables(F.expr(_STATEMENT)).alias("tables"))


@query("t10_statement_tables", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN [event_type] ELSE ['users_' || (user_id % 9)] END AS tables FROM events")
def t10_statements(spark, d):
    # Half of the statements are of a kind that names no table behind a keyword: then the known names that they contain count.
    events = table(spark, d, "events")
    statement = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("truncate "), "event_type")).otherwise(F.concat(F.lit("select 1 from users_"), (F.col("user_id") % 9).cast("string")))
    return events.select("event_id", texts.sql_tables_or_contained(statement, ["click", "view", "purchase", "error", "signup"]).alias("tables"))


@query("t11_placeholders", "SELECT item_id, 'id = ''REPLACED'' and n = ''REPLACED''' AS filled FROM benchmark")
def t11(spark, d):
    return table(spark, d, "benchmark").select("item_id", texts.placeholders_filled(F.concat(F.lit("id = #{"), F.col("item_id").cast("string"), F.lit("} and n = ${n}"))).alias("filled"))


@query("t12_sheet_name", "SELECT doc_id, regexp_replace(substr(text, 1, 31), '[\\\\/?*\\[\\]:]', '_', 'g') AS sheet FROM documents")
def t12(spark, d):
    return table(spark, d, "documents").select("doc_id", texts.sheet_name(F.col("text")).alias("sheet"))


@query("t13_address", "SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(c_name || ', Main St.'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')).replace(' st', ' street') AS place FROM customer")
def t13(spark, d):
    return table(spark, d, "customer").select("c_custkey", texts.address(F.concat("c_name", F.lit(", Main St.")), {"st": "street"}).alias("place"))


@query("t14_point_zero", "SELECT p_partkey, regexp_replace(p_size::VARCHAR || '.0', '\\.0$', '') AS shown FROM part")
def t14(spark, d):
    return table(spark, d, "part").select("p_partkey", texts.without_point_zero(F.concat(F.col("p_size").cast("string"), F.lit(".0"))).alias("shown"))


@query("t15_fuzzy_label", "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'brass') THEN 'Brass' WHEN contains(lower(p_type), 'tin') THEN 'TIN' END AS label FROM part")
def t15(spark, d):
    return table(spark, d, "part").select("p_partkey", texts.fuzzy_label(F.col("p_type"), ["Brass", "TIN"]).alias("label"))


@query("t16_line_diff", r"""WITH l AS (SELECT item_id, string_split(text, chr(10)) AS x FROM benchmark), c AS (SELECT *, len(x) AS n, least(len(x), 3) AS k FROM l)
SELECT item_id, list_concat(['@@ -' || (n - k + 1) || CASE WHEN k = 1 THEN '' ELSE ',' || k END || ' +' || (n - k + 1) || ',' || (k + 1) || ' @@'], list_transform(x[n - k + 1:], lambda v: ' ' || v), ['+end']) AS diff FROM c""")
def t16(spark, d):
    return table(spark, d, "benchmark").select("item_id", diffs.line_diff(F.col("text"), F.concat("text", F.lit("\nend"))).alias("diff"))


# Texts against themselves without every fifth line and with their first lines once more at the end. The SQL has the lengths of
# longest common subsequences, a row of the table a round: each entry is the highest up to it of those above and the diagonals.
@query("t16_shortest_script", r"""WITH RECURSIVE l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
t AS (SELECT doc_id, x, list_concat(list_filter(x, lambda v, i: i % 5 <> 4), x[:2]) AS y FROM l),
g AS (SELECT doc_id, x, y, 0 AS i, list_transform(y, lambda v: 0) AS r FROM t
UNION ALL SELECT doc_id, x, y, i + 1, list_transform(c, lambda v, j: list_max(c[:j])) FROM (SELECT *, list_transform(r, lambda v, j: greatest(v, CASE WHEN y[j] = x[i + 1] THEN CASE WHEN j = 1 THEN 0 ELSE r[j - 1] END + 1 ELSE 0 END)) AS c FROM g WHERE i < len(x)))
SELECT doc_id, len(x) - r[len(r)] AS removed, len(y) - r[len(r)] AS added, md5(array_to_string(y, chr(10))) AS made FROM g WHERE i = len(x)""")
def t16_script(spark, d):
    x, y = F.col("x"), F.col("y")
    both = table(spark, d, "documents").select("doc_id", diffs.lines(F.col("text")).alias("x"))
    both = both.withColumn("y", F.concat(F.filter(x, lambda _, i: i % 5 != 3), F.slice(x, 1, 2)))
    found = both.withColumn("script", diffs.edit_script(x, y))
    total = lambda size: F.aggregate("script", F.lit(0).cast("long"), lambda n, s: n + size(s))
    return found.select("doc_id", total(lambda s: s["removed"]).alias("removed"), total(lambda s: F.size(s["added"])).alias("added"), F.md5(F.array_join(diffs.patched(x, F.col("script")), "\n")).alias("made"))


@query("h01_md5", "SELECT c_custkey, md5(c_name || 'salt') AS digest FROM customer")
def h01(spark, d):
    return table(spark, d, "customer").select("c_custkey", hashes.md5_hex(F.col("c_name"), F.lit("salt")).alias("digest"))


@query("h02_hmac")
def h02(spark, d):
    return table(spark, d, "nation").select("n_nationkey", hashes.hmac_sha256(b"example key")("n_name").alias("sign"))


@query("h03_aes", "SELECT n_nationkey, n_name AS back FROM nation")
def h03(spark, d):
    key, iv = b"0123456789abcdef", b"fedcba9876543210"
    sealed = hashes.aes_base64(F.col("n_name"), key, iv)
    return table(spark, d, "nation").select("n_nationkey", hashes.aes_text(sealed, key, iv).alias("back"))


_LE = "substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)"
_SIGNED = f"CASE WHEN ('0x' || {_LE})::BIGINT >= 2147483648 THEN ('0x' || {_LE})::BIGINT - 4294967296 ELSE ('0x' || {_LE})::BIGINT END"


@query("h04_ring", f"""WITH k AS (SELECT c_custkey, {_SIGNED} AS v FROM (SELECT c_custkey, md5(c_custkey::VARCHAR) AS h FROM customer)),
p AS (SELECT n_name, {_SIGNED} AS v FROM (SELECT n_name, md5(n_name || i::VARCHAR) AS h FROM nation, range(8) t(i)))
SELECT c_custkey, coalesce((SELECT min_by(n_name, p.v) FROM p WHERE p.v >= k.v), (SELECT min_by(n_name, v) FROM p)) AS ring_node FROM k""")
def h04(spark, d):
    return hashes.ring_lookup(table(spark, d, "customer").select("c_custkey"), "c_custkey", table(spark, d, "nation"), "n_name").select("c_custkey", "ring_node")


@query("h07_tokens", "SELECT c_custkey, c_custkey::VARCHAR AS id, true AS same FROM customer")
def h07(spark, d):
    # A token is the cipher text of an id; equal ids have equal tokens.
    key, iv = b"0123456789abcdef", b"fedcba9876543210"
    sealed = hashes.aes_base64(F.col("c_custkey").cast("string"), key, iv)
    tokens = table(spark, d, "customer").select("c_custkey", sealed.alias("token"), sealed.alias("again"))
    return tokens.select("c_custkey", hashes.aes_text(F.col("token"), key, iv).alias("id"), ((F.col("token") == F.col("again")) & F.col("token").rlike("^[A-Za-z0-9+/]{22}==$")).alias("same"))


@query("h05_short_uuid")
def h05(spark, d):
    return table(spark, d, "region").select("r_regionkey", numbers.random_id(32).alias("id"))


@query("h06_time_ids", "SELECT o_orderkey, ((o_orderkey * 17) << 14) | ((o_custkey % 32) << 9) | (o_orderkey % 512) AS id, o_custkey % 32 AS machine FROM orders")
def h06(spark, d):
    at = F.lit(numbers.ID_EPOCH_MS) + F.col("o_orderkey") * 17 * 1000
    built = numbers.compose_id(at, F.col("o_custkey") % 32, F.col("o_orderkey") % 512)
    return table(spark, d, "orders").select("o_orderkey", built.alias("id")).select("o_orderkey", "id", numbers.decode_id(F.col("id")).machine.alias("machine"))


@query("n01_json", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def n01(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long").k.alias("k"))


@query("n02_multi_values", "SELECT event_id, [event_type] AS kinds FROM events")
def n02(spark, d):
    m = texts.multi_values(F.create_map(F.lit("kind"), F.col("event_type")))
    return table(spark, d, "events").select("event_id", F.element_at(m, "kind").alias("kinds"))


@query("n03_cache_key", "SELECT c_custkey, 'cust:id:' || c_custkey || ':nation:' || c_nationkey AS k FROM customer")
def n03(spark, d):
    return table(spark, d, "customer").select("c_custkey", texts.cache_key("cust", ("id", F.col("c_custkey")), ("nation", F.col("c_nationkey"))).alias("k"))


@query("n04_try_cast", "SELECT p_partkey, try_cast(substr(p_brand, 7) AS INTEGER) AS number, try_cast(p_name AS INTEGER) AS none FROM part")
def n04(spark, d):
    return table(spark, d, "part").select("p_partkey", F.substring("p_brand", 7, 20).try_cast("int").alias("number"), F.col("p_name").try_cast("int").alias("none"))


@query("n05_array_tests", "SELECT p_partkey, list_reverse(str_split(p_type, ' ')) AS turned, list_contains(str_split(p_type, ' '), 'TIN') AS any_tin, NOT list_contains(str_split(p_type, ' '), 'PROMO') AS no_promo FROM part")
def n05(spark, d):
    arr = F.split("p_type", " ")
    return table(spark, d, "part").select("p_partkey", F.reverse(arr).alias("turned"), F.exists(arr, lambda w: w == "TIN").alias("any_tin"), F.forall(arr, lambda w: w != "PROMO").alias("no_promo"))


@query("n06_message_lookup", "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE n_name END AS message FROM nation")
def n06(spark, d):
    dim = spark.createDataFrame([(0, "zero"), (1, "one")], "k int, msg string")
    return table(spark, d, "nation").join(F.broadcast(dim), F.col("n_regionkey") == F.col("k"), "left").select("n_nationkey", F.coalesce("msg", "n_name").alias("message"))
