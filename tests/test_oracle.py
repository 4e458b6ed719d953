"""Every query of the catalogue against its SQL on DuckDB."""

import pytest

import oracle
from fieldrail.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.duck("sf0.001")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    assert not oracle.differences(QUERIES[name](spark, f"{oracle.DATA}/sf0.001"), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, f"{oracle.DATA}/sf0.001").count() > 0
