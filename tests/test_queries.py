"""Every registered query of the engine against its SQL; those without SQL must give rows with their schema."""

import pytest
from compare import connect, same

from sparkloom.plans import registry

SF = "/root/testdata/sf0.001"

# No two of the generated vectors are that near; tests/test_similarity.py has some that are.
EMPTY = {"x02_density_clusters"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    sql = registry.oracle_sql().get(name)
    if sql:
        assert same(df, sql, duck)
    else:
        assert len(df.columns) and (df.count() > 0 or name in EMPTY)


def test_entry_point_has_them_all(spark):
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
