"""Joins that make many pairs of few rows, on tables with copies, nulls and repeated keys, against their SQL."""

import pytest
from compare import connect, same

from sparkloom.plans import registry


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("parts"))
    rows = [(k, f"B{k % 3}" if k % 11 else None, [50, 1, 7][k // 3 % 3], ["SMALL TIN", "SMALL TINS", "LARGE BRASS", None][k % 4]) for k in range(300)]
    # Keys of several rows, sharing no, one and two brands with others; one key on both sides.
    rows += [(k, b, s, "SMALL TIN") for k, b, s in [(900, "B0", 50), (900, "B1", 50), (450, "B0", 1), (450, "B1", 1), (451, "B1", 1), (901, "B2", 50), (901, "B2", 1), (None, "B2", 50), (900, "B0", 50), (450, None, 1)]]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int, p_type string").coalesce(1).write.parquet(f"{folder}/part.parquet")
    return folder


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_types_are_compared_once_each(spark, parts):
    df = registry.queries()["j09_theta_pairs"](spark, parts)
    assert same(df, registry.oracle_sql()["j09_theta_pairs"], connect(parts))
    compared = plan(df).split("levenshtein", 1)[1]
    assert compared.count("Aggregate [p_brand") == 2  # both sides of the comparison are distinct types


def test_named_pairs_are_not_made_distinct_again(spark, parts):
    df = registry.queries()["j16_resolved_and_named"](spark, parts)
    assert same(df, registry.oracle_sql()["j16_resolved_and_named"], connect(parts))
    assert plan(df).startswith("Union")
