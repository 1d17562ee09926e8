"""Every registered query against its SQL; those without SQL must at least run (their own tests hold more)."""

import pytest

from tests.oracle import connect, differences
from tidemill.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert differences(df, duck, SQL[name]) == ""
    else:
        assert df.columns and df.count() > 0


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)
