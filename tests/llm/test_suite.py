"""The registered operators against their SQL, and the registry itself."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect
from tidelayer.llm.suite import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, sf, name):
    assert compare(spark, con, sf, QUERIES[name], ORACLE[name]) is None


def test_all_are_registered():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_passages_are_listed_both_ways(spark, sf):
    links = {(r.doc_id, r.of_doc_id) for r in QUERIES["op8_repeated_passages"](spark, sf).collect()}
    assert links and links == {(x, a) for a, x in links}
