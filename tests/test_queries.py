"""Every registered query of the core runs on the smallest tables and equals its SQL."""

import math

import duckdb
import pytest

from conftest import SF
from softgrove.plans import flow_queries, operator_queries, table_queries

QUERIES = table_queries.QUERIES | operator_queries.QUERIES | flow_queries.QUERIES
SQL = table_queries.ORACLE_SQL | operator_queries.ORACLE_SQL | flow_queries.ORACLE_SQL
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    yield con
    con.close()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in values), key=str)


def near(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, (int, float)) and abs(a - b) < 2e-5)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name not in SQL:
        assert got
        return
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = rows(names, cur.fetchall())
    assert len(got) == len(want)
    assert all(near(x, y) for a, b in zip(got, want) for x, y in zip(a, b))
