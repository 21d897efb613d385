"""Every registered query against its DuckDB SQL, over whole tables."""

import os

import duckdb
import pytest

from warden.plans.queries import ORACLE_SQL, QUERIES

TABLES = "customer events documents conversations"


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cur = duck.execute(ORACLE_SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert plain(tuple(r[c] for c in cols) for r in df.collect()) == plain(cur.fetchall())


def test_positive_controls(spark, sf_dir):
    for name in ("ip_blocked", "app_blocked", "regex_semi_join", "threshold_cross", "blocked_rows", "learn_commits"):
        assert QUERIES[name](spark, sf_dir).limit(1).count(), name
