"""The SQL of the newer operators, another way to their results, against their queries."""

import duckdb
import pytest

from cataloom.llm import queries as q

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_ngram_join", "op12_periodic_runs", "op13_conversation_repair"])
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = q.queries()[name](spark, DATA)
    r = con.execute(q.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(row[names.index(c)] for c in df.columns) for row in r.fetchall()), key=str)
    assert sorted((tuple(x) for x in df.collect()), key=str) == want
