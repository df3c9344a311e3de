"""Alignment, whitening and neighbour search against plain versions, on small fixtures with nulls, empties, ties and repeated rows."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import alignment, neighbours, queries, whitening

SF = "/root/testdata/sf0.001"


# Alignment


@pytest.fixture(scope="module")
def vocabularies():
    return queries.tokenizer_file(), queries.tokenizer_file("piece_bpe_32k.model")


def plain_alignment(texts, first, second):
    """Whole texts encoded one by one; groups by walking both lists of tokens."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(first), SentencePieceProcessor(model_file=second)
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate([x for x in range(256) if x not in printable])}
    out = []
    for text in texts:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        whole = (" " + (text or "")).encode()
        if b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            out.append((0, 0, [], []))
            continue
        groups, i, j, x, y = [], 0, 0, 0, 0
        while i < len(ids_a):
            own_a, own_b = [ids_a[i]], []
            x, i = x + len(raw_a[i]), i + 1
            while x != y:
                if y < x:
                    own_b.append(ids_b[j])
                    y, j = y + len(raw_b[j]), j + 1
                else:
                    own_a.append(ids_a[i])
                    x, i = x + len(raw_a[i]), i + 1
            groups.append((own_a, own_b))
        out.append((len(ids_a), len(ids_b), groups, [(p, q) for g in groups for p in g[0] for q in g[1]]))
    count = Counter(pair for *_, links in out for pair in set(links))
    top = defaultdict(int)
    for (p, _), n in count.items():
        top[p] = max(top[p], n)
    return [
        (n_a, n_b, len(groups), len(links), sum(count[x] == top[x[0]] for x in links), sum(count[x] for x in links),
         hashlib.sha256(";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups).encode()).hexdigest() if groups else "")
        for n_a, n_b, groups, links in out
    ]


ODD_TEXTS = [None, "", " ", "\n", "a", "a\nb", "a \nb", "\nx", "x\n", "x ", "two  spaces", "tab\there", "under▁score", "a▁ b", "<|endoftext|> and </s> <s>", "日本語テスト😀 ½ ﬁ é", "é x", " nbsp　x", "nul\0here", "don't I'll we've", "123 4567 89", "ab" * 3000, "word " * 2000 + "end", "ab" * 3000, "x\r\ny", "Ġ x", "a.b, c; d!"]


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]


@pytest.mark.parametrize("heavy", [200_000, 5])
def test_alignment(spark, vocabularies, monkeypatch, heavy):
    monkeypatch.setattr(alignment, "HEAVY", heavy)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs] + [(10_000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "null id"), (None, "null id"), (3, "an id again"), (10_004, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "links": F.lit(2), "n": F.lit("x"), "a": F.lit(0)})
    got = rows_of(alignment.alignment(df.repartition(3), *vocabularies))
    want = [(i, *x) for (i, _), x in zip(rows, plain_alignment([t for _, t in rows], *vocabularies), strict=True)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_alignment_of_nothing(spark, vocabularies):
    assert rows_of(alignment.alignment(spark.createDataFrame([], "doc_id long, text string"), *vocabularies)) == []
    zeros = alignment.alignment(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), *vocabularies)
    assert sorted(rows_of(zeros)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


# Whitening

VECTORS = "vec_id long, embedding array<float>"


def plain_whitening(vectors):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    v = (x - s / n).T @ (x - s / n) / n
    e, u = np.linalg.eigh(v)
    return ((n * x - s) ** 2).sum(axis=1), e[::-1], (x - s / n) @ u[:, ::-1], np.trace(v)


def test_whitening(spark):
    got = whitening.whiten(spark.read.parquet(f"{SF}/embeddings.parquet").withColumns({"n": F.lit(1), "z": F.lit(2), "component": F.lit("c")})).toPandas().sort_values(["vec_id", "component"])
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    deviation, e, z, trace = plain_whitening(list(table.embedding))
    assert len(got) == 8 * len(table) and set(got.component) == set(range(1, 9)) and (got.n == len(table)).all()
    assert (got.deviation.to_numpy()[::8] == deviation).all() and (got.identity_error <= 1e-9).all()
    assert np.allclose(got.explained.to_numpy()[:8], e[:8] / trace, rtol=1e-9)
    mine, theirs = got.whitened.to_numpy().reshape(-1, 8), z[:, :8] / np.sqrt(e[:8])
    assert np.allclose(mine * np.sign((mine * theirs).sum(axis=0)), theirs, atol=1e-8)


def test_whitening_of_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (2, [2.0, 2.5]), (2, [2.0, 2.5]), (None, [4.0, -1.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [1.0]), (9, [3e38, 1.0])]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    deviation, e, z, trace = plain_whitening([rows[i][1] for i in range(4)])
    assert sorted((r["vec_id"] or 0, r["component"], r["deviation"]) for r in got) == sorted((i or 0, c, int(x)) for (i, _), x in zip(rows, deviation, strict=False) for c in (1, 2))
    assert {round(r["explained"], 9) for r in got} == {round(float(x / trace), 9) for x in e}
    for nothing in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        assert whitening.whiten(spark.createDataFrame(nothing, VECTORS)).collect() == []
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 1.0, 2.0 * i]) for i in range(5)], VECTORS)).collect()
    assert {r["component"] for r in flat} == {1}  # one direction alone varies
    far = whitening.whiten(spark.createDataFrame([(1, [1e9]), (2, [-1e9]), (3, [0.0])], VECTORS)).orderBy("vec_id").collect()
    assert [int(r["deviation_exact"]) for r in far] == [(3 * (1024 * 10**9)) ** 2] * 2 + [0] and far[0]["deviation"] is None


# Neighbours


def plain_neighbours(rows, k=10):
    """Every row by id and vector against all others."""
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)})
    usual = max(Counter(len(v) for _, v in good).items(), key=lambda x: (x[1], x[0]))[0] if good else 0
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in good if len(v) == usual]
    out = []
    for i, v in good:
        if i % 100 == 0:
            others = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in good if j != i)[:k]
            out += [(i, nr, j, round(d, 9)) for nr, (d, j) in enumerate(others, 1)]
    return sorted(out)


def found(spark, rows):
    df = spark.createDataFrame(rows, VECTORS).withColumns({"rep": F.lit(1), "vec": F.lit("x"), "q": F.lit(0), "score": F.lit(1.5)})
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0).collect())


def test_neighbours_of_odd_rows(spark):
    odd = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (0, [1.0, 2.0]), (100, [0.0, 0.0]), (200, None), (None, [1.0, 1.0]), (300, [None, 1.0]), (400, [3.0]), (500, [-1.0, -1.0]), (600, [float("inf"), 1.0])]
    assert found(spark, odd) == plain_neighbours(odd)
    assert found(spark, []) == [] and found(spark, [(0, [1.0])]) == [] and found(spark, [(1, [1.0])]) == []
    copies = [(i, [float(i % 3), 1.0, -1.0]) for i in range(330)]  # groups of copies, more than asked for
    assert found(spark, copies) == plain_neighbours(copies)
    few = [(i, [float(i), 1.0]) for i in range(0, 9)] + [(100, [-5.0, 0.5])]  # fewer rows than asked for, far apart
    assert found(spark, few) == plain_neighbours(few)


def test_neighbours_in_grids(spark, monkeypatch):
    """Cells cut into small parts on both sides give the same rows."""
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 2)
    rng = np.random.default_rng(3)
    rows = [(i * 25, [float(x) for x in rng.normal(size=3).astype(np.float32)]) for i in range(120)]
    monkeypatch.setattr(neighbours, "GOAL", 1.0)
    assert found(spark, rows) == plain_neighbours(rows)


def test_neighbours_recall(spark):
    """At least nine in ten true neighbours, on the table given and on tight clusters of differing lengths."""
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 20))
    tight = [(i, [float(x) for x in ((centres[i % 30] + 0.05 * rng.normal(size=20)) * (1 + i % 3)).astype(np.float32)]) for i in range(3000)]
    for rows in (table, tight):
        want = {x[::2] for x in plain_neighbours(rows)}
        assert len(want & {x[::2] for x in found(spark, rows)}) >= 0.9 * len(want)


def test_buckets_of_a_vector_are_probed(spark):
    hashing = neighbours.Rotations(5, 300, tables=3)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(40, 5))
    reach = hashing.reach(v, v)
    assert np.allclose(reach, 0)
    for table in range(3):
        axis, rest = hashing.codes(v, table)
        who, a, r = hashing.probes(v, table, 0.2)
        probed = set(zip(who.tolist(), a.tolist(), r.tolist(), strict=True))
        assert {(i, int(axis[i]), int(rest[i])) for i in range(40)} <= probed and len(probed) == len(who)
