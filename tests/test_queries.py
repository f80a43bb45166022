"""Every registered query against its SQL twin on the smallest given tables."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as contract

TABLES = "documents embeddings pages benchmark labels conversations".split()
# The optional subpackage's queries have tests of their own.
QUERIES = {k: contract.bound(v) for k, v in contract.QUERIES.items()}
SQL = contract.SQL


@pytest.fixture(scope="module")
def db(data_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{data_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if isinstance(value, str):
        return value
    return repr(round(float(value), 6) + 0.0)


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=str)


def test_every_query_has_a_twin():
    assert set(SQL) == set(QUERIES) and len(QUERIES) == 113
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_twin(spark, db, data_dir, name):
    got = QUERIES[name](spark, data_dir)
    want = db.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())
