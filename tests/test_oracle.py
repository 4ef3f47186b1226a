"""Every query that SQL can express, against DuckDB on the same tables."""

import math

import duckdb
import pytest

from tidewater import queries as core

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(([plain(r[k]) for k in order] for r in rows), key=repr)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query(spark, duck, name):
    df = core.queries()[name](spark, SF)
    got = duck.execute(core.oracle_sql()[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    expected = rows_of(columns, got.fetchall())
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert len(mine) == len(expected)
    assert mine == expected


def test_all_queries_have_an_oracle():
    assert set(core.queries()) == set(core.oracle_sql())
