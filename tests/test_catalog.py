"""Every registered query of the engine against DuckDB, at the smallest scale."""

import math

import duckdb
import pytest

from rillet.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else bytes(v) if isinstance(v, (bytes, bytearray)) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = duck.sql(sql)
    assert sorted(found.columns) == columns
    want = [tuple(plain(r[found.columns.index(c)]) for c in columns) for r in found.fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(rows, key=key) == sorted(want, key=key)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
