"""Overload resolution, case by case."""

import pytest

from sparkloom.operators import calls

METHODS = [
    ("A", "f", 0, ["int", "String"], False),
    ("A", "f", 1, ["Integer", "Object"], False),
    ("A", "f", 2, ["Object", "a.b.Date"], False),
    ("A", "g", 0, ["String"], True),
    ("A", "g", 1, ["String", "int"], True),
    ("A", "g", 2, ["long", "int"], True),
    ("A", "h", 0, ["int"], False),
    ("A", "h", 1, [], False),
]

CASES = {
    "exact": ("f", ["int", "java.lang.String"], 0),
    "boxed": ("f", ["Integer", "List<String>"], 1),
    "null is no primitive": ("f", ["null", "Date"], 2),
    "nothing known: first": ("f", ["", None], 0),
    "wrong count": ("f", ["int"], None),
    "widest variable tail, first of equals": ("g", ["String", "int", "int"], 1),
    "tail may be empty": ("g", [], 0),
    "no arguments known": ("h", None, 1),
    "no such method": ("k", [], None),
}


@pytest.fixture(scope="module")
def found(spark):
    methods = spark.createDataFrame(METHODS, "owner string, name string, pos int, params array<string>, varargs boolean")
    asked = spark.createDataFrame([(k, "A", n, a) for k, (n, a, _) in CASES.items()], "call string, owner string, name string, args array<string>")
    return {r["call"]: r["pos"] for r in calls.best_overload(asked, methods).collect()}


@pytest.mark.parametrize("case", CASES)
def test_overload(found, case):
    assert found.get(case) == CASES[case][2]
