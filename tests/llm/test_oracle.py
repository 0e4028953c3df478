import duckdb
import pytest

from postlark.llm import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.queries()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got = queries.queries()[name](spark, sf)
    want = con.sql(oracles.queries()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = want.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(rows, key=repr) and rows


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 14)]
