"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect
from tidelayer import suite

QUERIES, ORACLE = suite.queries(), suite.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_its_sql():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, sf, name):
    assert compare(spark, con, sf, QUERIES[name], ORACLE[name]) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["event_date", "event_hour"]
    assert df.count() > 0
