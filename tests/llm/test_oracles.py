"""The queries that SQL can express, against their DuckDB SQL over whole tables."""

import os

import duckdb
import pytest

from warden.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(SF, t)}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = c.execute(ORACLE_SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted((tuple(r[x] for x in cols) for r in df.collect()), key=repr) == sorted(cur.fetchall(), key=repr)
