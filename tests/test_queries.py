"""Every core query against its SQL, and those without SQL for a stable schema."""

import pytest
from helpers import DATA, same

from panelwright.plans import registry

SF = DATA / "sf0.001"
pytestmark = pytest.mark.skipif(not SF.exists(), reason="needs the test tables")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    same(QUERIES[name](spark, str(SF)), SF, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, str(SF))
    assert df.columns
    df.count()


def test_sql_names_are_queries():
    assert not set(SQL) - set(QUERIES)
