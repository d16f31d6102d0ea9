"""The driver's contract."""

import __spark_entry__ as entry


def test_contract(spark):
    q, sql = entry.queries(), entry.oracle_sql()
    assert sql.keys() <= q.keys() and len(q) > 150
    assert entry.entry(spark).count() > 0
