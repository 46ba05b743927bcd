import pytest

import __spark_entry__ as entry
from oracle import compare, connect
from ragtide import queries


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_gives_what_sql_gives(name, spark, sf_dir, con):
    compare(queries.QUERIES[name](spark, sf_dir), con, queries.SQL[name])


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 1500


def test_every_query_has_a_known_signature():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.QUERIES) <= set(entry.queries())
