"""Every registered query of the catalogue against its SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from cataloom import catalog_queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def plain(v):
    if v is None or v != v:
        return "NULL"
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog_queries.queries()))
def test_query(spark, duck, name):
    df = catalog_queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = catalog_queries.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    r = duck.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in r.fetchall())
    assert got == want
