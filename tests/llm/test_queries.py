"""Registered queries against their SQL; those without are held against brute force in the operators' own tests."""

import pytest

from tests.oracle import connect, differences
from tidemill.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, sf_dir, name):
    assert differences(queries.queries()[name](spark, sf_dir), connect(sf_dir), queries.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_without_sql_runs(spark, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    assert df.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_names():
    assert sorted(n.split("_")[0] for n in queries.queries()) == sorted(f"op{k}" for k in range(1, 14))
