"""Every query agrees with its DuckDB twin on the smallest tables."""

import os

import duckdb
import pytest

from blockloom.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in os.listdir(DATA):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


def rows(columns, got):
    by = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(repr([bytes(r[k]) if isinstance(r[k], bytearray) else r[k] for k in by]) for r in got)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = rows(df.columns, df.collect())
    want = duck.sql(SQL[name])
    assert got == rows(want.columns, want.fetchall())


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())
