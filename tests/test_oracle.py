"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from sparkloom.plans.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return c


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    got = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert df.columns
        return
    cursor = duck.execute(SQL[name])
    columns = [x[0] for x in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(columns, cursor.fetchall())
