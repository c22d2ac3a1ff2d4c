"""Every query of the library with SQL gives the same rows as DuckDB; the others run."""

import pytest
from oracle import compare, connect

from quillwork.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_sql_names_are_queries():
    assert not set(SQL) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    compare(spark, con, QUERIES[name], SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert 0 < __spark_entry__.entry(spark).count() <= 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
