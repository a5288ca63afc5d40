"""Every query against its SQL in another engine, on the smallest tables."""

import os

import duckdb
import pytest

from lynceus.plans import audit_queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def engine():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(audit_queries.queries()))
def test_query(spark, engine, name):
    got = audit_queries.queries()[name](spark, DATA)
    have = [tuple(r) for r in got.collect()]
    sql = audit_queries.oracle_sql().get(name)
    if sql is None:
        assert have
        return
    want = engine.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, have) == rows(columns, want.fetchall())
