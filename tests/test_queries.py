"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from pageloom.queries import oracle, spark as registered


@pytest.fixture(scope="module")
def duck(sf):
    db = duckdb.connect()
    for name in os.listdir(sf):
        db.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return db


def comparable(rows):
    return sorted(tuple(repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v) for v in row) for row in rows)


def test_every_query_has_sql():
    assert set(registered.QUERIES) == set(oracle.ORACLES)
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(oracle.ORACLES))
def test_query(spark, duck, sf, name):
    df = contract.queries()[name](spark, sf)
    columns = sorted(df.columns)
    result = duck.sql(contract.oracle_sql()[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    expected = comparable([tuple(row[i] for i in at) for row in result.fetchall()])
    got = comparable(df.select(*columns).collect())
    assert len(got) > 0 and got == expected
