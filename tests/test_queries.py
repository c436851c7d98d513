"""Every query of the library against its SQL on the smallest tables."""

import duckdb
import pytest

from tidemark.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def _plain(df, columns):
    found = df[columns].astype(str).replace({"nan": "NULL", "<NA>": "NULL", "None": "NULL"}).replace(r"^(-?\d+)\.0$", r"\1", regex=True)
    return found.sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DIR).toPandas()
    if name not in ORACLE_SQL:
        assert len(got.columns)
        return
    want = duck.sql(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert _plain(got, columns).equals(_plain(want, columns))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
