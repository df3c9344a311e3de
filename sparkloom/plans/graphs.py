"""Graph, similarity and tree queries on edges derived from the generated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import calls, graph, similarity
from ..operators.windows import gaps
from .registry import query
from .relational import table

# part -> supplier -> nation -> region, and back from regions to a few parts, so that there are cycles.
_EDGES = """e(src, dst) AS (SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem
UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
UNION SELECT 'r' || r_regionkey, 'p' || (r_regionkey + 1) FROM region)"""


def edges(spark, d) -> DataFrame:
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    parts = [
        table(spark, d, "lineitem").select(name("p", "l_partkey").alias("src"), name("s", "l_suppkey").alias("dst")),
        table(spark, d, "supplier").select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst")),
        table(spark, d, "nation").select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst")),
        table(spark, d, "region").withColumn("next", F.col("r_regionkey") + 1).select(name("r", "r_regionkey").alias("src"), name("p", "next").alias("dst")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.distinct()


def _roots(spark, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "node string")


@query("g01_closure", f"WITH RECURSIVE {_EDGES}, c(node) AS (SELECT 'p1' UNION SELECT dst FROM c JOIN e ON node = src) SELECT node FROM c")
def g01(spark, d):
    return graph.closure(edges(spark, d), _roots(spark, "p1")).select("node")


@query("g02_capped_tree", f"""WITH RECURSIVE {_EDGES}, c(node, depth) AS (SELECT 'p1', 0 UNION SELECT dst, depth + 1 FROM c JOIN e ON node = src WHERE depth < 80), d AS (SELECT node, min(depth)::INTEGER AS depth FROM c GROUP BY node),
n AS (SELECT depth, sum(count(*)) OVER (ORDER BY depth) AS known FROM d GROUP BY depth) SELECT node, depth FROM d WHERE depth <= coalesce((SELECT min(depth) FROM n WHERE known > 120 AND depth > 0), 80)""")
def g02(spark, d):
    return graph.closure(edges(spark, d), _roots(spark, "p1"), max_nodes=120)


@query("g03_depth_capped", f"WITH RECURSIVE {_EDGES}, c(node, depth) AS (SELECT 'p1', 0 UNION SELECT dst, depth + 1 FROM c JOIN e ON node = src WHERE depth < 120) SELECT node, min(depth)::INTEGER AS depth FROM c GROUP BY node")
def g03(spark, d):
    return graph.closure(edges(spark, d), _roots(spark, "p1"), max_depth=120)


@query("g04_exclusive", f"WITH RECURSIVE {_EDGES}, c(node, depth) AS (SELECT 'p1', 0 UNION SELECT dst, depth + 1 FROM c JOIN e ON node = src WHERE depth < 80) SELECT dst AS node FROM e WHERE dst <> 'p1' GROUP BY dst HAVING bool_and(src IN (SELECT node FROM c)) AND dst IN (SELECT node FROM c)")
def g04(spark, d):
    e = edges(spark, d)
    return graph.exclusive_nodes(e, graph.closure(e, _roots(spark, "p1")).select("node"), _roots(spark, "p1"))


def _removable(roots: str, anchors: str, free: str) -> str:
    """What nodes outside of the closure call goes, and so does all that it calls; free: a condition of the nodes that may go."""
    return f"""WITH RECURSIVE {_EDGES}, f AS (SELECT * FROM e WHERE src <> dst), c(node) AS (SELECT unnest({roots}) UNION SELECT dst FROM c JOIN e ON node = src),
gone(node) AS (SELECT node FROM c WHERE node IN ({anchors}) AND {free} UNION SELECT dst FROM f WHERE dst IN (SELECT node FROM c) AND src NOT IN (SELECT node FROM c) AND {free.replace("node", "dst")}
UNION SELECT dst FROM gone JOIN f ON node = src WHERE dst IN (SELECT node FROM c) AND {free.replace("node", "dst")}) SELECT node FROM c WHERE node NOT IN (SELECT node FROM gone)"""


@query("g05_removable", _removable("['p1', 'p2', 'p3']", "'n3'", "node NOT IN ('p1', 'p2', 'p3')"))
def g05(spark, d):
    return graph.removable_nodes(edges(spark, d), _roots(spark, "p1", "p2", "p3"), _roots(spark, "n3"))


@query("g05b_removable_roots_open", _removable("['p1', 'p2', 'p3']", "'p2'", "node <> ''"))
def g05b(spark, d):
    return graph.removable_nodes(edges(spark, d), _roots(spark, "p1", "p2", "p3"), _roots(spark, "p2"), protect_roots=False)


@query("g06_cascade", f"""WITH RECURSIVE {_EDGES}, f AS (SELECT * FROM e WHERE src <> dst), r(a, b) AS (SELECT src, dst FROM f UNION SELECT a, dst FROM r JOIN f ON b = src),
bad AS (SELECT b AS node FROM r WHERE a IN (SELECT a FROM r WHERE a = b)) SELECT node FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) WHERE node NOT IN (SELECT node FROM bad)""")
def g06(spark, d):
    e = edges(spark, d)
    seeds = e.select(F.col("src").alias("node")).distinct().join(e.select(F.col("dst").alias("node")), "node", "left_anti")
    return graph.cascade_nodes(e, seeds)


# Five groups of five nodes: four rings and, last, a chain. Node 100 calls the first of groups 0, 1 and 4, node 200 those of
# groups 2 and 3 and the third of group 1: so that node 8 hangs on node 7, which has a caller outside, and ring 0 on the root alone.
_RINGS = """e(src, dst) AS (SELECT n_nationkey::VARCHAR, CASE WHEN n_nationkey % 5 < 4 THEN n_nationkey + 1 ELSE n_nationkey - 4 END::VARCHAR FROM nation WHERE n_nationkey <> 24
UNION SELECT * FROM (VALUES ('100', '0'), ('100', '5'), ('100', '20'), ('200', '10'), ('200', '15'), ('200', '7')) v)"""


def _rings(spark, d) -> DataFrame:
    k = F.col("n_nationkey")
    ring = table(spark, d, "nation").where("n_nationkey <> 24").select(k.cast("string").alias("src"), F.when(k % 5 < 4, k + 1).otherwise(k - 4).cast("string").alias("dst"))
    return ring.unionByName(spark.createDataFrame([("100", "0"), ("100", "5"), ("100", "20"), ("200", "10"), ("200", "15"), ("200", "7")], "src string, dst string"))


@query("g07_exclusive_on_cycles", f"WITH RECURSIVE {_RINGS}, c(node) AS (SELECT '100' UNION SELECT dst FROM c JOIN e ON node = src) SELECT dst AS node FROM e WHERE dst <> '100' GROUP BY dst HAVING bool_and(src IN (SELECT node FROM c)) AND dst IN (SELECT node FROM c)")
def g07_exclusive(spark, d):
    e = _rings(spark, d)
    return graph.exclusive_nodes(e, graph.closure(e, _roots(spark, "100")).select("node"), _roots(spark, "100"))


@query("g07_removable_on_cycles", _removable("['100']", "''", "node <> '100'").replace(_EDGES, _RINGS))
def g07_removable(spark, d):
    return graph.removable_nodes(_rings(spark, d), _roots(spark, "100"))


@query("g07_cascade_on_cycles", f"""WITH RECURSIVE {_RINGS}, r(a, b) AS (SELECT src, dst FROM e UNION SELECT a, dst FROM r JOIN e ON b = src),
bad AS (SELECT b AS node FROM r WHERE a IN (SELECT a FROM r WHERE a = b)) SELECT node FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) WHERE node NOT IN (SELECT node FROM bad)""")
def g07_cascade(spark, d):
    return graph.cascade_nodes(_rings(spark, d), _roots(spark, "100", "200"))


_TREE = "SELECT n_regionkey AS tree, n_nationkey AS pos, CASE WHEN n_nationkey = (SELECT min(n2.n_nationkey) FROM nation n2 WHERE n2.n_regionkey = n.n_regionkey) THEN 0 ELSE 1 + (n_nationkey % 3) END AS level, n_name AS content FROM nation n"


def _tree(spark, d) -> DataFrame:
    n = table(spark, d, "nation")
    low = n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("low"))
    return n.join(low, "n_regionkey").select(F.col("n_regionkey").alias("tree"), F.col("n_nationkey").alias("pos"), F.when(F.col("n_nationkey") == F.col("low"), 0).otherwise(1 + F.col("n_nationkey") % 3).cast("int").alias("level"), F.col("n_name").alias("content"))


@query("g08_leaf_paths", f"""WITH RECURSIVE t AS ({_TREE}), l AS (SELECT *, (SELECT max(pos) FROM t b WHERE b.tree = t.tree AND b.pos < t.pos AND b.level < t.level) AS up, lead(level) OVER (PARTITION BY tree ORDER BY pos) AS nxt FROM t),
w(tree, pos, content, up, above) AS (SELECT tree, pos, content, up, '' FROM l WHERE nxt IS NULL OR nxt <= level
UNION ALL SELECT w.tree, w.pos, w.content, l.up, '&' || l.content || w.above FROM w JOIN l ON l.tree = w.tree AND l.pos = w.up)
SELECT tree, pos, content || above AS path FROM w WHERE up IS NULL""")
def g08(spark, d):
    return graph.leaf_paths(_tree(spark, d))


@query("g09_tree_parents", f"WITH t AS ({_TREE}) SELECT tree, pos, (SELECT max(pos) FROM t b WHERE b.tree = t.tree AND b.pos < t.pos AND b.level < t.level) AS parent_pos FROM t")
def g09(spark, d):
    return graph.levelled_parents(_tree(spark, d)).select("tree", "pos", "parent_pos")


@query("w03_no_level_jumps", f"""WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY pos) AS nr FROM ({_TREE})),
w(tree, nr, last, kept) AS (SELECT tree, nr, level, true FROM t WHERE nr = 1 UNION ALL SELECT t.tree, t.nr, CASE WHEN w.last + 1 < t.level THEN w.last ELSE t.level END, w.last + 1 >= t.level FROM w JOIN t ON t.tree = w.tree AND t.nr = w.nr + 1)
SELECT t.tree, t.pos, t.level, t.content FROM t JOIN w ON w.tree = t.tree AND w.nr = t.nr WHERE kept""")
def w03(spark, d):
    return graph.without_level_jumps(_tree(spark, d))


@query("g10_components", """WITH RECURSIVE e(a, b) AS (SELECT o_custkey, o_orderkey + 1000000 FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e) SELECT node, min(least(node, a)) AS component FROM (SELECT a AS node, b AS a FROM s) GROUP BY node""")
def g10(spark, d):
    # A bipartite graph of customers and their orders: each order has one customer.
    e = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 1000000).alias("dst"))
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return graph.components(e, nodes)


_W = "w(src, dst, w) AS (SELECT n_nationkey::BIGINT, ((n_nationkey * 7 + 3) % 25)::BIGINT, (n_nationkey % 4 + 1)::BIGINT FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 1) % 25, (n_nationkey % 3 + 2) FROM nation)"


def _weighted(spark, d) -> DataFrame:
    n = table(spark, d, "nation").withColumn("k", F.col("n_nationkey").cast("long"))
    one = n.select(F.col("k").alias("src"), ((F.col("k") * 7 + 3) % 25).alias("dst"), (F.col("k") % 4 + 1).alias("w"), F.col("k").alias("pos"))
    two = n.select(F.col("k").alias("src"), ((F.col("k") + 1) % 25).alias("dst"), (F.col("k") % 3 + 2).alias("w"), (F.col("k") + 100).alias("pos"))
    return one.unionByName(two)


_DIST = f"{_W}, l AS (SELECT src, dst, max_by(w, pos) AS w FROM (SELECT *, row_number() OVER () AS pos FROM w) GROUP BY src, dst), p(node, dist) AS (SELECT 0::BIGINT, 0::BIGINT UNION SELECT dst, dist + w FROM p JOIN l ON node = src WHERE dist < 150), d AS (SELECT node, min(dist)::BIGINT AS dist FROM p GROUP BY node)"


@query("g11_shortest_paths", f"WITH RECURSIVE {_DIST} SELECT node, dist FROM d")
def g11(spark, d):
    return graph.shortest_paths(_weighted(spark, d), 0)


@query("g11_network_delay", f"WITH RECURSIVE {_DIST} SELECT CASE WHEN count(*) FILTER (WHERE dist IS NULL) > 0 THEN -1 ELSE max(dist) END::BIGINT AS delay FROM nation LEFT JOIN d ON node = n_nationkey")
def g11_delay(spark, d):
    return graph.network_delay(_weighted(spark, d), table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node")), 0)


@query("g12_impact_by_depth", f"WITH RECURSIVE {_EDGES}, c(node, depth) AS (SELECT 'p1', 0 UNION SELECT dst, depth + 1 FROM c JOIN e ON node = src WHERE depth < 80) SELECT depth::INTEGER AS depth, list_sort(list(node)) AS nodes FROM (SELECT node, min(depth) AS depth FROM c GROUP BY node) GROUP BY depth")
def g12(spark, d):
    return graph.closure(edges(spark, d), _roots(spark, "p1")).groupBy("depth").agg(F.sort_array(F.collect_list("node")).alias("nodes"))


@query("g13_typed_closure", f"WITH RECURSIVE {_EDGES}, t AS (SELECT * FROM e WHERE NOT starts_with(dst, 'r')), c(node) AS (SELECT 'p1' UNION SELECT dst FROM c JOIN t ON node = src) SELECT node FROM c")
def g13(spark, d):
    typed = edges(spark, d).withColumn("type", F.substring("src", 1, 1))
    return graph.typed_closure(typed, _roots(spark, "p1"), ["p", "s", "n", "r"], ["r"]).select("node")


@query("g14_member_closure", f"WITH RECURSIVE {_EDGES}, t AS (SELECT * FROM e WHERE substr(src, 1, 1) IN ('p', 's')), c(node) AS (SELECT 'p2' UNION SELECT dst FROM c JOIN t ON node = src) SELECT node FROM c")
def g14(spark, d):
    typed = edges(spark, d).withColumn("type", F.substring("src", 1, 1))
    return graph.typed_closure(typed, _roots(spark, "p2"), ["p", "s"], []).select("node")


@query("g15_best_overload", "SELECT l_orderkey, max_by(l_linenumber, CASE WHEN l_returnflag = 'R' THEN 8 WHEN l_returnflag = 'A' THEN 6 ELSE -4 END * 100 - l_linenumber) AS pick FROM lineitem GROUP BY l_orderkey")
def g15(spark, d):
    score = F.when(F.col("l_returnflag") == "R", 8).when(F.col("l_returnflag") == "A", 6).otherwise(-4) * 100 - F.col("l_linenumber")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_linenumber", score).alias("pick"))


# Overloads of one method, with a variable tail in the last two; argument types by line item.
_METHODS = [(0, ["int", "String"], False), (1, ["Integer", "Object"], False), (2, ["a.b.Date", "Object"], False), (3, ["Object"], False), (4, ["long"], False), (5, ["String", "int"], True), (6, ["String"], True)]
_TYPES = ["int", "Integer", "String", "null", "", "java.util.List<String>", "Date"]
_SHORT = "regexp_replace(trim({0}), '<.*>', '').regexp_replace('^.*\\.', '')"
_BOXED = ", ".join(f"('{a}', '{b}')" for k, v in calls.BOXED.items() for a, b in ((k, v), (v, k)))
_PRIMITIVE = ", ".join(f"'{k}'" for k in calls.BOXED)


@query("g15_overloads", f"""WITH m(pos, params, varargs) AS (VALUES {", ".join(f"({p}, {ts}, {str(v).lower()})" for p, ts, v in _METHODS)}), t AS (SELECT {_TYPES} AS ts),
c AS (SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS call, list_slice([ts[l_partkey % 7 + 1], ts[l_suppkey % 7 + 1], 'int'], 1, l_linenumber % 4) AS args FROM lineitem, t),
x AS (SELECT call, pos, varargs, params, args, unnest(CASE WHEN len(args) = 0 OR len(params) = 0 THEN [0] ELSE range(1, least(len(params), len(args)) + 1) END) AS i FROM c, m WHERE CASE WHEN varargs THEN len(args) >= len(params) - 1 ELSE len(args) = len(params) END),
y AS (SELECT *, CASE WHEN i > 0 THEN {_SHORT.format("params[i]")} END AS p, CASE WHEN i > 0 THEN {_SHORT.format("args[i]")} END AS a FROM x),
z AS (SELECT call, pos, varargs, len(any_value(params)) AS width, sum(CASE WHEN coalesce(a, '') = '' THEN 0 WHEN a = 'null' THEN CASE WHEN p IN ({_PRIMITIVE}) THEN -50 ELSE 1 END WHEN a = p THEN 8 WHEN (a, p) IN ({_BOXED}) THEN 6 WHEN p = 'Object' THEN 1 ELSE -4 END) AS score FROM y GROUP BY call, pos, varargs)
SELECT call, pos FROM (SELECT *, row_number() OVER (PARTITION BY call ORDER BY varargs, CASE WHEN varargs THEN width ELSE score END DESC, pos) AS n FROM z) WHERE n = 1""")
def g15_overloads(spark, d):
    kinds = F.array(*[F.lit(t) for t in _TYPES])
    kind = lambda c: F.element_at(kinds, (F.col(c) % 7 + 1).cast("int"))
    args = F.slice(F.array(kind("l_partkey"), kind("l_suppkey"), F.lit("int")), F.lit(1), (F.col("l_linenumber") % 4).cast("int"))
    found = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("call"), F.lit("A").alias("owner"), F.lit("f").alias("name"), args.alias("args"))
    methods = spark.createDataFrame([("A", "f", *m) for m in _METHODS], "owner string, name string, pos int, params array<string>, varargs boolean")
    return calls.best_overload(found, methods)


@query("g16_permutations", "SELECT [a.r_name, b.r_name, c.r_name, d.r_name, e.r_name] AS perm FROM region a JOIN region b ON b.r_name <> a.r_name JOIN region c ON c.r_name NOT IN (a.r_name, b.r_name) JOIN region d ON d.r_name NOT IN (a.r_name, b.r_name, c.r_name) JOIN region e ON e.r_name NOT IN (a.r_name, b.r_name, c.r_name, d.r_name)")
def g16(spark, d):
    return graph.permutations(table(spark, d, "region").select("r_name"), "r_name")


@query("g17_annotated_tree", f"""WITH RECURSIVE {_EDGES}, c(node, depth) AS (SELECT unnest(['n1', 'n2']), 0 UNION SELECT dst, depth + 1 FROM c JOIN e ON node = src WHERE depth < 3), i AS (SELECT * FROM e WHERE dst IN (SELECT node FROM c)),
t(root, path, node, depth, cycle, retained) AS (SELECT x, [x], x, 0, false, x = 's1' FROM (SELECT unnest(['n1', 'n2']) AS x) UNION ALL SELECT root, list_append(path, dst), dst, depth + 1, list_contains(path, dst), dst = 's1' FROM t JOIN i ON node = src WHERE NOT cycle AND NOT retained AND depth < 4)
SELECT root, path, node, depth::INTEGER AS depth, cycle, retained FROM t""")
def g17(spark, d):
    e = edges(spark, d)
    inside = graph.closure(e, _roots(spark, "n1", "n2"), 3).select("node")
    return graph.annotated_tree(e, _roots(spark, "n1", "n2"), inside, _roots(spark, "s1"), 4)


@query("x01_cosine", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def x01(spark, d):
    v = table(spark, d, "embeddings")
    a, b = v.select(F.col("vec_id").alias("a"), F.col("embedding").alias("va")), v.select(F.col("vec_id").alias("b"), F.col("embedding").alias("vb"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(similarity.cosine(F.col("va"), F.col("vb")), 6).alias("cosine"))


@query("x01_token_cosine", r"""WITH t AS (SELECT item_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS token FROM benchmark), c AS (SELECT item_id, token, count(*) AS n FROM t WHERE token <> '' GROUP BY item_id, token),
m AS (SELECT item_id, sqrt(sum(n * n)::DOUBLE) AS norm FROM c GROUP BY item_id), d AS (SELECT x.item_id AS a, y.item_id AS b, sum(x.n * y.n)::DOUBLE AS dot FROM c x JOIN c y ON y.item_id = x.item_id + 1 AND y.token = x.token GROUP BY ALL)
SELECT p.item_id AS a, p.item_id + 1 AS b, coalesce(dot / (ma.norm * mb.norm), 0.0) AS cosine FROM benchmark p LEFT JOIN d ON d.a = p.item_id LEFT JOIN m ma ON ma.item_id = p.item_id LEFT JOIN m mb ON mb.item_id = p.item_id + 1""")
def x01_tokens(spark, d):
    items = table(spark, d, "benchmark").select("item_id", "text")
    counts = similarity.token_counts(items, "item_id", "text")
    pairs = items.select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"))
    return similarity.sparse_cosine(counts, "item_id", pairs)


@query("x02_density_clusters")
def x02(spark, d):
    return similarity.density_clusters(table(spark, d, "embeddings"), "vec_id", "embedding", 0.5).drop("core")


@query("x02_density_points", """WITH RECURSIVE p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
n AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.01),
c AS (SELECT a AS id FROM n GROUP BY a HAVING count(*) >= 4), l AS (SELECT a, b FROM n WHERE a IN (SELECT id FROM c) AND b IN (SELECT id FROM c)),
g(a, b) AS (SELECT a, b FROM l UNION SELECT g.a, l.b FROM g JOIN l ON l.a = g.b), m AS (SELECT a AS id, min(b) AS component FROM g GROUP BY a)
SELECT id AS node, component, true AS core FROM m UNION ALL SELECT n.a, min(m.component), false FROM n JOIN m ON m.id = n.b WHERE n.a NOT IN (SELECT id FROM c) GROUP BY n.a""")
def x02_points(spark, d):
    # Two coordinates of each vector, as points of the plane.
    points = table(spark, d, "embeddings").withColumn("point", F.slice("embedding", 1, 2))
    return similarity.density_clusters(points, "vec_id", "point", 0.01, 4)


@query("x03_text_groups", """WITH RECURSIVE t AS (SELECT p_type, min(p_partkey) AS low FROM part WHERE p_type <> '' GROUP BY p_type), l AS (SELECT a.low AS a, b.low AS b FROM t a JOIN t b ON round((1 - levenshtein(a.p_type, b.p_type)::DOUBLE / greatest(length(a.p_type), length(b.p_type))) * 100, 1) >= 80),
g(a, b) AS (SELECT a, b FROM l UNION SELECT g.a, l.b FROM g JOIN l ON l.a = g.b) SELECT p_partkey AS node, coalesce((SELECT min(b) FROM g JOIN t ON g.a = t.low WHERE t.p_type = p.p_type), p_partkey) AS component FROM part p""")
def x03(spark, d):
    return similarity.text_groups(table(spark, d, "part"), "p_partkey", "p_type", 80.0)


@query("x03_host_groups", r"""WITH RECURSIVE h AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages), t AS (SELECT host, min(page_id) AS low FROM h WHERE host <> '' GROUP BY host),
l AS (SELECT a.low AS a, b.low AS b FROM t a JOIN t b ON round((1 - levenshtein(a.host, b.host)::DOUBLE / greatest(length(a.host), length(b.host))) * 100, 1) >= 85),
g(a, b) AS (SELECT a, b FROM l UNION SELECT g.a, l.b FROM g JOIN l ON l.a = g.b) SELECT page_id AS node, coalesce((SELECT min(b) FROM g JOIN t ON g.a = t.low WHERE t.host = h.host), page_id) AS component FROM h""")
def x03_hosts(spark, d):
    hosts = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))
    return similarity.text_groups(hosts, "page_id", "host", 85.0)


@query("r05_gaps", """SELECT event_id, round(gap, 3) AS gap FROM (SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000000.0 AS gap FROM events) WHERE gap > 3600""")
def r05(spark, d):
    return gaps(table(spark, d, "events"), "user_id", "ts", ["event_id"], 3600).select("event_id", F.round("gap", 3).alias("gap"))
