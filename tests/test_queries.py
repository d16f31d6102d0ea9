"""Every query with SQL gives the SQL's rows."""

import pytest

from millrace.registry import QUERIES, SQL
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(SQL))
def test_like_sql(spark, data, name):
    same(spark, QUERIES[name], SQL[name], data)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
