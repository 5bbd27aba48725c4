"""Every registered query of the library against its SQL in DuckDB, at the smallest scale."""

import pytest
from conftest import DATA, rows_of

from tidewater.plans import ledger, market, streams

QUERIES = {**market.QUERIES, **ledger.QUERIES, **streams.QUERIES}
SQL = {**market.SQL, **ledger.SQL, **streams.SQL}


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, f"{DATA}/sf0.001").toPandas()
    want = duck.execute(SQL[name]).df()
    assert sorted(got) == sorted(want)
    assert rows_of(got) == rows_of(want)


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())
