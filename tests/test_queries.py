"""Every registered query against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import canonical

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    db = duckdb.connect()
    for table in "documents embeddings pages benchmark labels conversations".split():
        db.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    return db


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in SQL:
        assert rows
        return
    result = duck.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(rows, df.columns) == canonical(result.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
