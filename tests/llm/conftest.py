import random

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A DataFrame with the columns of documents from (doc_id, text) or (doc_id, text, lang, source)."""

    def make(rows):
        full = [(*row, *("en", "src0")[len(row) - 2 :]) for row in rows]
        return spark.createDataFrame([(*row, None if row[1] is None else len(row[1])) for row in full], DOCUMENTS)

    return make


@pytest.fixture
def words():
    """``words(n)``: n invented words, other ones at every call."""
    rng = random.Random(7)
    return lambda n: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(5, 9))) for _ in range(n)]


@pytest.fixture
def sql():
    """The rows of a SQL text over tables given as DataFrames."""

    def run(text, **tables):
        con = duckdb.connect()
        for name, df in tables.items():
            con.register(name, df.toArrow())
        found = con.sql(text)
        return found.columns, found.fetchall()

    return run


@pytest.fixture
def same(sql):
    """Holds a result against SQL, by columns and rows."""

    def check(df, text, **tables):
        columns, rows = sql(text, **tables)
        assert sorted(columns) == sorted(df.columns)
        assert sorted(map(tuple, df.select(*columns).collect())) == sorted(rows)

    return check
