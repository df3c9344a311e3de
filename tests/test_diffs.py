"""Shortest line scripts against a table of longest common subsequences, and against what they make of the first text."""

import random
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom.functions import diffs


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def applied(a, script):
    out, at = [], 0
    for first, removed, added in script:
        out += [*a[at:first], *added]
        at = first + removed
    return out + list(a[at:])


def test_scripts_are_shortest():
    rng = random.Random(3)
    for _ in range(3000):
        kinds = rng.choice([1, 2, 3, 8, 40])
        a, b = ([rng.randrange(kinds) for _ in range(rng.randrange(14))] for _ in range(2))
        script = diffs.changes(a, b)
        assert applied(a, script) == b, (a, b)
        assert sum(n + len(new) for _, n, new in script) == len(a) + len(b) - 2 * lcs(a, b), (a, b)
        assert all(n or new for _, n, new in script) and all(x[0] + x[1] < y[0] for x, y in zip(script, script[1:], strict=False))


def test_long_texts():
    rng = random.Random(4)
    a = [rng.randrange(400) for _ in range(3000)]
    b = [x for x in a if rng.random() > 0.03]
    for _ in range(60):
        b.insert(rng.randrange(len(b)), rng.randrange(500))
    script = diffs.changes(a, b)
    assert applied(a, script) == b and sum(n + len(new) for _, n, new in script) == len(a) + len(b) - 2 * lcs(a, b)


def test_columns(spark):
    rows = [("a\nb\nc", "a\nc\nd"), ("", "x"), (None, None), ("x", None), ("\n\n", "\n"), ("ä\r\ny", "y\r\nä"), ("q\n" * 5000, "q\n" * 4990 + "r")]
    df = spark.createDataFrame(rows, "a string, b string").withColumns({"x": diffs.lines(F.col("a")), "y": diffs.lines(F.col("b"))})
    for r in df.withColumn("s", diffs.edit_script(F.col("x"), F.col("y"))).withColumn("made", diffs.patched(F.col("x"), F.col("s"))).collect():
        assert r["made"] == (r["b"] or "").split("\n")
        assert (r["a"] == r["b"]) == (r["s"] == [])
    assert df.limit(0).withColumn("s", diffs.edit_script(F.col("x"), F.col("y"))).collect() == []


def test_hunks(spark):
    import difflib

    rng = random.Random(5)
    a = [f"line {i}" for i in range(60)]
    for _ in range(50):
        b = [x for x in a if rng.random() > 0.1]
        b.insert(rng.randrange(len(b)), "new")
        # All lines of each text are different here, so that there is one shortest script, which difflib finds too.
        assert diffs.hunks(a, b, 3) == list(difflib.unified_diff(a, b, lineterm="", n=3))[2:]
    got = spark.createDataFrame([("a\nb", "a"), ("a", "a"), (None, "z")], "a string, b string").select(diffs.line_diff(F.col("a"), F.col("b"), 1)).collect()
    assert [r[0] for r in got] == [["@@ -1,2 +1 @@", " a", "-b"], [], ["@@ -1 +1 @@", "-", "+z"]]


def test_few_lines_are_held_at_once():
    """A batch's scripts take Python's memory for some of its texts only."""
    rows = [[f"line {i} of text {k}" for i in range(100)] for k in range(2000)]
    x, y = (pa.array(r) for r in (rows, [r[:50] + ["new"] + r[51:] for r in rows]))
    del rows
    tracemalloc.start()
    got = diffs.scripts(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == [[{"at": 50, "removed": 1, "added": ["new"]}]] * 2000 and peak < 8_000_000
    assert diffs.scripts(x[:0], y[:0]).to_pylist() == []
