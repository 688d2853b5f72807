"""Every query with an oracle against DuckDB over the smallest tables; the others must run."""

import math
import os

import duckdb
import pytest

from somaspark.fixtures import TABLES
from somaspark.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(map(repr, (tuple(plain(r[i]) for i in order) for r in data)))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, oracle, name):
    df = catalog.queries()[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    if sql := catalog.oracle_sql().get(name):
        want = oracle.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows(df.columns, got) == rows(columns, want.fetchall())
