"""Every registered query against its SQL, on the smallest given tables."""

import pytest

import registered
from oracle_check import compare, database


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


@pytest.mark.parametrize("key", list(registered.QUERIES))
def test_query(spark, con, sf, key):
    state, n, _ = compare(spark, con, sf, registered.QUERIES[key], registered.ORACLES.get(key))
    assert state in ("ok", "no sql"), state
    assert n > 0


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns[0] == "zone_id" and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
