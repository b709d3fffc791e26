"""Every registered query of the counter engine against its SQL twin on the smallest tables."""

import duckdb
import pytest

from capwindow.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("events", "orders", "customer")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == columns
    rows = sorted(map(repr, map(tuple, df.select(*columns).collect())))
    assert rows == sorted(map(repr, want.select(", ".join(f'"{c}"' for c in columns)).fetchall()))
