"""Every query with an SQL form against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from fallowgrid import catalog

SF = "/root/testdata/sf0.001"


def rows(names, data):
    def plain(v):
        if v is None or v != v:
            return "null"
        return f"{v:.5f}" if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else str(v)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", list(catalog.ORACLE))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = duck.execute(catalog.ORACLE[name])
    assert got == rows([c[0] for c in want.description], want.fetchall())
