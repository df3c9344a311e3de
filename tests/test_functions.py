"""Unit vectors of functions and operators, and graph operators against plain versions on cyclic graphs."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import dates, hashes, numbers, texts
from sparkloom.operators import graph, windows
from sparkloom.sources import readers
from sparkloom.streaming import ticks


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_numbers(spark):
    null = F.lit(None).cast("int")
    r = one(spark, numbers.add(null, F.lit(2), F.lit(3)), numbers.add(), numbers.multiply(F.lit(2), F.lit(3)), numbers.plain(F.lit(Decimal("1.500"))), numbers.plain(F.lit(Decimal("100"))), numbers.below_market(F.lit(1.0), F.lit(3)))
    assert list(r) == [5, 0, 6, "1.5", "100", 0.0]
    q = one(spark, numbers.divide(F.lit(Decimal("1")), F.lit(Decimal("3"))), numbers.divide(F.lit(Decimal("2")), F.lit(Decimal("3"))))
    assert list(q) == [Decimal("0.3333333333333"), Decimal("0.6666666666667")]


def test_matching_rate(spark):
    r = one(spark, texts.matching_rate(F.lit("GF5091236880004"), F.lit("GF50912336880004")), texts.matching_rate(F.lit(""), F.lit("")))
    assert list(r) == [93.8, 0.0]


def test_ring_hash(spark):
    assert list(one(spark, hashes.ring_hash(F.lit("Node10")), hashes.ring_signed(F.lit("Node10")))) == [3460828609, -834138687]


def test_ids(spark):
    at = numbers.ID_EPOCH_MS + 5000
    r = one(spark, numbers.compose_id(F.lit(at), F.lit(3), F.lit(7)))
    assert r[0] == (5 << 14) | (3 << 9) | 7
    back = one(spark, numbers.decode_id(F.lit(r[0])))[0]
    assert (back["at_ms"], back["machine"], back["sequence"]) == (at, 3, 7)


def test_templates(spark):
    p = texts.template_pattern(F.lit("/a/{id}"))
    r = spark.range(1).select(p.alias("p")).select(F.expr("'/a/1' rlike p"), F.expr("'/a/1/b' rlike p")).first()
    assert list(r) == [True, False]


def test_paths_and_dates(spark):
    r = one(spark, texts.route(F.lit("a//b/?x=1#y")), texts.path_text(F.lit(None).cast("string")), texts.path_text(F.lit("a/")), dates.older_than_minutes(F.lit(119)), dates.older_than_minutes(F.lit(120)))
    assert list(r) == ["/a/b", "", "/a", False, True]


def test_hmac(spark):
    import base64
    import hmac

    got = spark.createDataFrame([("x",), (None,)], "s string").select(hashes.hmac_sha256(b"k")("s")).collect()
    assert got[0][0] == base64.b64encode(hmac.new(b"k", b"x", "sha256").digest()).decode() and got[1][0] is None


@pytest.fixture(scope="module")
def graphs(spark):
    make = lambda pairs: spark.createDataFrame(pairs, "src string, dst string")
    nodes = lambda *n: spark.createDataFrame([(x,) for x in n], "node string")
    return make([("R", "A"), ("A", "B"), ("B", "A")]), make([("R", "A"), ("X", "A"), ("A", "B")]), nodes


def names(df):
    return {r["node"] for r in df.collect()}


def test_cyclic_sets(graphs):
    cyc, fork, nodes = graphs
    r = nodes("R")
    assert names(graph.exclusive_nodes(cyc, graph.closure(cyc, r), r)) == {"A", "B"}
    assert names(graph.removable_nodes(cyc, r)) == {"R", "A", "B"}
    assert names(graph.cascade_nodes(cyc, r)) == {"R"}
    assert names(graph.exclusive_nodes(fork, graph.closure(fork, r), r)) == {"B"}
    assert names(graph.removable_nodes(fork, r)) == {"R"}
    assert names(graph.cascade_nodes(fork, r)) == {"R"}


def test_shortest_paths(spark):
    e = spark.createDataFrame([(1, 2, 9, 0), (1, 2, 1, 1), (2, 3, 2, 2), (1, 3, 9, 3)], "src long, dst long, w long, pos long")
    assert {(r["node"], r["dist"]) for r in graph.shortest_paths(e, 1).collect()} == {(1, 0), (2, 1), (3, 3)}
    n = spark.createDataFrame([(1,), (2,), (3,), (4,)], "node long")
    assert graph.network_delay(e, n, 1).first()[0] == -1


def test_leaf_paths(spark):
    rows = [(0, p, lv, f"c{p}") for p, lv in enumerate([0, 1, 2, 3, 1, 2, 3, 4, 1, 2, 3])]
    got = graph.leaf_paths(spark.createDataFrame(rows, "tree int, pos int, level int, content string")).collect()
    assert {r["path"] for r in got} == {"c3&c0&c1&c2", "c7&c0&c4&c5&c6", "c10&c0&c8&c9"}


def test_level_jumps(spark):
    rows = [(0, 0, 0), (0, 1, 2), (0, 2, 1), (0, 3, 2), (0, 4, 4)]
    got = graph.without_level_jumps(spark.createDataFrame(rows, "tree int, pos int, level int")).collect()
    assert sorted(r["pos"] for r in got) == [0, 2, 3]


def test_prefix_sum_range(spark):
    from pyspark.sql import Window

    vals = [3, 2, -1, 6, 5, 4, -3, 3, 7, 2, 3]
    df = spark.createDataFrame(list(enumerate(vals)), "i int, v int")
    assert df.where("i between 3 and 6").agg(F.sum("v")).first()[0] == 12
    up = df.withColumn("s", F.sum("v").over(Window.orderBy("i"))).collect()
    assert [r["s"] for r in up] == [sum(vals[: i + 1]) for i in range(len(vals))]


def test_intervals(spark):
    df = spark.createDataFrame([(1, 1, 3), (1, 2, 5), (1, 6, 7), (1, 9, 9)], "k int, lo int, hi int")
    assert sorted((r["lo"], r["hi"]) for r in windows.merged_intervals(df, "k", "lo", "hi").collect()) == [(1, 7), (9, 9)]


def test_quote_line(spark):
    good = ",".join(["1_EURUSD"] + ["1.1"] * 7 + ["2", "1700000000"] + ["1.1"] * 2 + ["8", "5"] + ["1.1"] * 2)
    r = spark.createDataFrame([(good,), ("x",), (None,)], "line string").select(ticks.quote(F.col("line")).alias("q")).collect()
    assert r[0]["q"]["time"] == 1700000000 and r[1]["q"] is None and r[2]["q"] is None


def test_csv_fields_keep_empties(spark):
    assert spark.range(1).select(readers.csv_fields(F.lit('a,"b ""x""",,'), 4)).first()[0] == ["a", 'b "x"', "", ""]


def test_sql_tables_keep_comments_to_their_line(spark):
    assert one(spark, texts.sql_tables(F.lit("select 1 -- from a\nfrom b join B2")))[0] == ["b", "b2"]


def test_components_of_chains_and_hubs(spark):
    """Few rounds for a long chain, one hub, loops, edges both ways and nodes without edges; the least node names each."""
    chain = [(i + 1, i) if i % 2 else (i, i + 1) for i in range(1000, 1600)]
    hub = [(50, i) for i in range(51, 700)]
    e = spark.createDataFrame([*chain, *hub, (7, 7), (8, 9), (9, 8), (8, 9)], "src long, dst long")
    nodes = spark.range(1700).select(F.col("id").alias("node"))
    want = {i: 1000 if 1000 <= i <= 1600 else 50 if 50 <= i < 700 else 8 if i == 9 else i for i in range(1700)}
    kept, graph_stored = [], graph.stored
    graph.stored = lambda df: kept.append(1) or graph_stored(df)
    try:
        assert {r["node"]: r["component"] for r in graph.components(e, nodes).collect()} == want
    finally:
        graph.stored = graph_stored
    assert len(kept) <= 16
    assert graph.components(e.limit(0), nodes.limit(3)).count() == 3


def test_common_prefix(spark):
    cases = {0: ["a", "b/c"], 1: ["a/b", "a/c/d"], 2: ["a/b", "a/b-x"], 3: ["a/b", "a/b/c", "a/b-x/c", "a/b/"], 4: ["x/y/z/1/2/3/4", "x/y/z/1/2/3/5"], 5: ["one/two"], 6: [None], 7: [None, "p/q", "p/q"], 8: ["", "a"], 9: ["a/b", "a/b/c"]}
    df = spark.createDataFrame([(k, t) for k, ts in cases.items() for t in ts], "k int, t string")
    got = {r["k"]: (r["depth"], r["prefix"]) for r in windows.common_prefix(df, "k", "t").collect()}
    assert got == {0: (0, ""), 1: (1, "a"), 2: (1, "a"), 3: (1, "a"), 4: (6, "x/y/z/1/2/3"), 5: (2, "one/two"), 6: (0, ""), 7: (2, "p/q"), 8: (0, ""), 9: (2, "a/b")}
