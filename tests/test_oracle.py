"""Every registered query against its DuckDB twin on the smallest tables."""

import duckdb
import pytest

from spindle.plans import queries
from tools.oracle_check import SPARK_TO_DUCK, TABLES, digest

from conftest import SMOKE


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_oracle(spark, con, name):
    df = queries.QUERIES[name](spark, SMOKE)
    got = [tuple(r) for r in df.collect()]
    rel = con.sql(queries.SQL[name])
    want = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    spark_types = {c: SPARK_TO_DUCK.get(t, t) for c, t in df.dtypes}
    assert spark_types == {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert len(got) == len(want)
    assert digest(got, df.columns)[0] == digest(want, rel.columns)[0]
