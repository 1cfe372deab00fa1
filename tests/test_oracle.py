"""Every query with SQL agrees with DuckDB, at the smallest scale."""

from __future__ import annotations

import duckdb
import pytest
from conftest import SF

from docloom.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else str(round(v, 6))
    return str(list(v)) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got, result = df.collect(), duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in result.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in got) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).limit(5).collect() is not None
