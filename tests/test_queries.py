"""Every registered query against its SQL on the same tables."""

import pytest

import __spark_entry__ as entry
from compare import difference, oracle_connection

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_medium):
    return oracle_connection(sf_medium)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_medium, con, name):
    found = difference(QUERIES[name](spark, sf_medium), con, ORACLES[name])
    assert found is None, found


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, sf_small, name):
    assert QUERIES[name](spark, sf_small).count() > 0


def test_entry_is_lazy_and_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
