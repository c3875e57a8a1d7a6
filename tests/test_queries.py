"""Every registered catalogue query equals its SQL."""

import datetime
import decimal
import os

import duckdb
import pytest
from marquee.plans import registry
from marquee.plans.fixtures import TABLES

registry.load()
DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def test_all_have_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, sql, name):
    df = registry.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    picked = ", ".join(f'"{c}"' for c in cols)
    want = sql.sql(f"SELECT {picked} FROM ({registry.ORACLE_SQL[name]}) q")
    assert sorted(sql.sql(f"SELECT * FROM ({registry.ORACLE_SQL[name]}) q LIMIT 0").columns) == cols
    assert got == sorted(tuple(map(plain, r)) for r in want.fetchall())
