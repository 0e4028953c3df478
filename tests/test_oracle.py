"""Every registered query against its SQL in a second engine, over whole tables."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as registered
from postlark import catalog, oracles

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), oracles.queries()


@pytest.fixture(scope="module")
def other(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [[plain(r[i]) for i in order] for r in rows]
    return sorted(columns), sorted(out, key=lambda r: [(x is None, str(x)) for x in r])


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(registered.queries()) and set(SQL) <= set(registered.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_result(spark, sf, other, name):
    df = QUERIES[name](spark, sf)
    cursor = other.execute(SQL[name])
    assert table(df.columns, df.collect()) == table([c[0] for c in cursor.description], cursor.fetchall())


def test_entry(spark):
    assert registered.entry(spark).count() > 0
