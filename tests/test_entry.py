import duckdb
import pytest

import __spark_entry__ as entry
from quarry import queries as search

DATA = "/root/testdata/sf0.001"
TABLES = "documents conversations pages labels orders".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(search.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = search.queries()[name](spark, DATA)
    expected = duck.sql(search.oracle_sql()[name])
    assert sorted(got.columns) == sorted(expected.columns)
    columns = ", ".join(f'"{c}"' for c in got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(duck.sql(f"SELECT {columns} FROM ({search.oracle_sql()[name]})").fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
