"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check import TABLES, rows_of


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, sf, db, name):
    df = queries()[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    assert got, "no rows"
    if name in oracle_sql():
        cur = db.execute(oracle_sql()[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert rows_of(df.columns, got) == rows_of(names, cur.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0
