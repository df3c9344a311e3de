"""Groups of texts and vectors cross every column that isn't compared."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from sparkloom.functions.texts import matching_rate
from sparkloom.operators import similarity
from sparkloom.operators.templates import match_templates


def test_text_groups_cross_blocks(spark):
    rows = [(1, "steel case one"), (2, "steel case one"), (3, "steel case ona"), (4, "quite another"), (5, None), (6, "quite another"), (7, ""), (8, "")]
    got = similarity.text_groups(spark.createDataFrame(rows, "k long, t string"), "k", "t", 80.0).collect()
    assert {r["node"]: r["component"] for r in got} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 4, 7: 7, 8: 8}


def test_density_clusters_cross_labels(spark):
    rows = [(1, [0.0, 0.0], 0), (2, [0.3, 0.0], 1), (3, [0.7, 0.0], 2), (4, [5.0, 0.0], 0), (5, [9.0, 9.0], 0), (6, [9.0, 9.0], 1)]
    got = similarity.density_clusters(spark.createDataFrame(rows, "k long, v array<float>, label int"), "k", "v", 0.5).collect()
    assert {r["node"]: r["component"] for r in got} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}


def test_close_texts_equal_all_pairs(spark):
    """Every pair within the rate, for several rates, against the edit distance of all pairs."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(150)] + ["", None, "ab" * 20, "ab" * 19 + "b", "ß" * 9, "ß" * 8 + "s"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").withColumn("side", F.col("k") % 2)
    a, b = df.select(F.col("k").alias("a"), F.col("t").alias("ta"), F.col("side").alias("sa")), df.select(F.col("k").alias("b"), F.col("t").alias("tb"), F.col("side").alias("sb"))
    pairs = a.join(b, F.col("a") < F.col("b")).where("ta != '' and tb != ''").withColumn("rate", matching_rate(F.col("ta"), F.col("tb"))).where("rate >= 40").collect()
    for rate in (40.0, 51.0, 66.7, 80.0, 90.0, 100.0):
        for within in ([], ["side"]):
            want = {(r["a"], r["b"]) for r in pairs if r["rate"] >= rate and (not within or r["sa"] == r["sb"])}
            assert {(r["a"], r["b"]) for r in similarity.close_texts(df, "k", "t", rate, within).collect()} == want


def test_candidates_grow_with_texts(spark):
    """Ten times the distinct texts, up to 100,000, give some ten times the candidates, not a hundred."""
    found = {}
    for n in (10_000, 100_000):
        df = spark.range(n).select(F.col("id").alias("k"), F.concat(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 24), F.lit("x")).alias("t"))
        found[n] = similarity.candidate_texts(df, "k", "t", 90.0, []).where("a != b").count()
    assert found[100_000] <= 100_000


def plain_clusters(rows, eps, least):
    good = [(k, np.array(v)) for k, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    near = {k: [j for j, w in good if np.sqrt(((v - w) ** 2).sum()) <= eps] for k, v in good}
    core = {k for k, x in near.items() if len(x) >= least}
    name = {k: k for k in core}
    while True:
        new = {k: min(name[j] for j in near[k] if j in core) for k in core}
        if new == name:
            break
        name = new
    return {(k, name[k], True) for k in core} | {(k, min(name[j] for j in x if j in core), False) for k, x in near.items() if k not in core and any(j in core for j in x)}


def test_density_clusters_equal_plain_ones(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in (rng.normal(size=2) * 0.25 + centre).round(3)]) for i, centre in enumerate(np.repeat([[0, 0], [3, 0], [0, 2.5], [1.4, 1.2]], [60, 50, 40, 6], axis=0))]
    rows += [(200 + i, [5.0, 5.0]) for i in range(3)] + [(300, [9.0, 9.0]), (301, None), (302, [None, 1.0]), (303, [float("nan"), 0.0]), (304, []), (305, [1.0]), (306, [-0.0, 7.0]), (307, [0.0, 7.0])]
    df = spark.createDataFrame(rows, "k long, v array<double>").withColumns({"rep": F.lit(1), "n": F.lit(2), "core": F.lit("x")})
    clean = [r for r in rows if r[1] is None or len(r[1]) != 1]
    for least, block in ((2, 4000), (3, 4000), (5, 7)):
        monkeypatch.setattr(similarity, "BLOCK", block)
        got = {tuple(r) for r in similarity.density_clusters(df, "k", "v", 0.3, least).collect()}
        assert got == plain_clusters(clean, 0.3, least)
        assert least == 2 or any(not core for *_, core in got)  # there are border points
    assert similarity.density_clusters(df.limit(0), "k", "v", 0.3, 3).collect() == []


def test_templates(spark):
    paths = ["/a/1", "/a/1/b", "/a//b", "/a/x.y/b", "/b/1.html", "/b/1.htm", "", "/", None, "/a/1", "/a+b/(c)"]
    templates = ["/a/{id}", "/a/{id}/b", "/{any}/1", "/b/{p}.html", "/a/1", "/a/{id}", "/", "", None, "/{x}/{y}", "/{x}-{y}/z", "/a+b/({c})"]
    p = spark.createDataFrame(list(enumerate(paths)), "i int, path string").withColumn("_key_", F.lit(1))
    got = sorted((r["i"], r["template"]) for r in match_templates(p, "path", spark.createDataFrame([(t,) for t in templates], "template string"), "template").collect())
    pattern = lambda t: "".join("[^/]+" if x.startswith("{") else re.escape(x) for x in re.split(r"(\{[^}]*\})", t))
    assert got == sorted((i, t) for i, x in enumerate(paths) for t in {t for t in templates if t is not None} if x is not None and re.fullmatch(pattern(t), x))


def test_templates_need_no_nested_loop(spark):
    p = spark.range(2000).select(F.concat(F.lit("/p"), F.col("id"), F.lit("/q")).alias("path"))
    t = spark.range(3000).select(F.concat(F.lit("/p"), F.col("id"), F.lit("/{x}")).alias("template"))
    found = match_templates(p, "path", t, "template")
    assert found.count() == 2000 and "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_no_copies_where_pivots_leave_nothing_out():
    """Vectors of unit length in 64 dimensions have much the same distances: one region; points of the plane have many."""
    rng = np.random.default_rng(3)
    wide = rng.normal(size=(400, 64))
    assert len(similarity._chosen(wide / np.sqrt((wide**2).sum(axis=1, keepdims=True)), 0.5, 40_000)) == 1
    assert len(similarity._chosen(rng.uniform(size=(400, 2)), 0.01, 40_000)) > 16


def test_density_clusters_in_many_dimensions(spark, monkeypatch):
    """Pairs nearer and farther than eps by a little, of long and of short vectors, in one block and in several."""
    rng = np.random.default_rng(8)
    for scale, shift, block in ((1.0, 0.0, 50), (1.0, 1e7, 4000)):
        base = rng.normal(size=(40, 32))
        step = rng.normal(size=(40, 32))
        step *= 0.5 * (1 + rng.choice([-1e-3, 1e-3], size=(40, 1))) / np.sqrt((step**2).sum(axis=1, keepdims=True))
        rows = [(k, [float(x) for x in v * scale + shift]) for k, v in enumerate(np.r_[base, base + step])]
        df = spark.createDataFrame(rows, "k long, v array<double>")
        monkeypatch.setattr(similarity, "BLOCK", block)
        want = plain_clusters(rows, 0.5 * scale, 2)
        assert {tuple(r) for r in similarity.density_clusters(df, "k", "v", 0.5 * scale).collect()} == want and 0 < len(want) < 80
