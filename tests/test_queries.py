"""Every query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import compare

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_same_as_sql(spark, duck, small, name):
    ok, message = compare(spark, duck, QUERIES[name], SQL[name], small)
    assert ok, message


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
