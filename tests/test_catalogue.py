"""Every query against its SQL in DuckDB, over the smallest tables; and those that SQL can't express by what they must hold."""

from __future__ import annotations

import math

import duckdb
import pytest

from lectio.plans.catalogue import ORACLE_SQL, QUERIES
from lectio.plans.registry import TABLES


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    return con


def _value(x):
    return None if x is None or isinstance(x, float) and math.isnan(x) else x


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, data, duck, name):
    got = QUERIES[name](spark, data)
    want = duck.sql(ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = sorted((tuple(_value(r[c]) for c in columns) for r in got.collect()), key=repr)
    place = [want.columns.index(c) for c in columns]
    assert rows == sorted((tuple(_value(r[i]) for i in place) for r in want.fetchall()), key=repr)
    assert rows or name == "due_broken"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows_only(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
