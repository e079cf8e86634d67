"""Every query against its SQL, over the smallest tables."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        if name.endswith(".parquet"):
            connection.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return round(value, 5) + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, db, name):
    frame = entry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    result = db.execute(entry.oracle_sql()[name])
    found = [c[0] for c in result.description]
    assert sorted(found) == columns
    expected = [tuple(plain(r[found.index(c)]) for c in columns) for r in result.fetchall()]
    got = [tuple(plain(r[c]) for c in columns) for r in frame.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
