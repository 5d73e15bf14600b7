"""Every query of the folder that has a DuckDB twin, on the smallest tables."""

import duckdb
import pytest

from conftest import SMOKE
from spindle.llm import queries

TABLES = ["documents", "pages", "benchmark", "labels"]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SMOKE)
    cur = con.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    want = [tuple(r[names.index(c)] for c in df.columns) for r in cur.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)
