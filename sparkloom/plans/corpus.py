"""Statement shapes of an embedded SQL corpus: text that the original only parses for table names, here run on our tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query
from .relational import table

_SAME = {
    "corpus_left_join_distinct": "SELECT c_nationkey, count(DISTINCT o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_nationkey",
    "corpus_inner_join_keys": "SELECT o_orderkey, l_linenumber FROM orders INNER JOIN lineitem ON o_orderkey = l_orderkey AND o_orderkey % 3 = l_linenumber % 3",
    "corpus_comma_join": "SELECT s_suppkey, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey AND n_regionkey = 2",
    "corpus_group_by": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS qty FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "corpus_sum_nested_default": "SELECT o_custkey, round(coalesce(sum(coalesce(o_totalprice, 0)), 0), 2) AS total, max(coalesce(o_orderstatus, '')) AS top FROM orders GROUP BY o_custkey",
    "corpus_exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
    "corpus_not_exists": "SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)",
    "corpus_in_list": "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_custkey NOT IN (1, 2, 3)",
    "corpus_not_in_subquery": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 3 AND l_partkey IS NOT NULL)",
    "corpus_between_like": "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_type LIKE '%BRASS%'",
    "corpus_case_join_key": "SELECT c_custkey, r_name FROM customer JOIN region ON CASE WHEN c_acctbal > 0 THEN c_nationkey % 5 ELSE 0 END = r_regionkey",
    "corpus_concat_join_key": "SELECT a.c_custkey, b.s_suppkey FROM customer a JOIN supplier b ON concat(a.c_nationkey, '-', a.c_custkey % 10) = concat(b.s_nationkey, '-', b.s_suppkey % 10)",
    "corpus_scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders)",
    "corpus_order_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "corpus_distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
}


def _shape(sql: str):
    def run(spark, d):
        for name in ("customer", "orders", "lineitem", "part", "supplier", "nation", "region"):
            if name in sql:
                table(spark, d, name).createOrReplaceTempView(name)
        return spark.sql(sql)

    return run


for _name, _sql in _SAME.items():
    query(_name, _sql)(_shape(_sql))


@query("corpus_regexp", "SELECT page_id FROM pages WHERE regexp_matches(url, 'example\\.(com|org)/(en|fr)/[0-9]+')")
def corpus_regexp(spark, d):
    return table(spark, d, "pages").where(F.col("url").rlike(r"example\.(com|org)/(en|fr)/[0-9]+")).select("page_id")


@query("corpus_group_concat", "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ';' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY c_nationkey")
def corpus_group_concat(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_set("c_mktsegment")), ";").alias("segments"))


@query("corpus_date_format", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def corpus_date_format(spark, d):
    return table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
