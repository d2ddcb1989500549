"""Every registered query with SQL against DuckDB on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from tarnwater import queries

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, datetime.datetime) and v.time() == datetime.time(0):
        return v.date()
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(name, spark, sf, duck):
    frame = queries.QUERIES[name](spark, sf)
    got = rows(frame.columns, frame.collect())
    result = duck.execute(queries.SQL[name])
    expected = rows([d[0] for d in result.description], result.fetchall())
    assert sorted(frame.columns) == sorted(d[0] for d in result.description)
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_other_queries_return_rows(name, spark, sf):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
