"""Every named query against its SQL on the smallest data set."""

import duckdb
import pytest

import __spark_entry__ as spark_entry
from lociframe import bindings
from lociframe.bindings.inputs import BASE_TABLES

FOLDER = "/root/testdata/sf0.001"
QUERIES = bindings.queries()
ORACLES = bindings.oracles()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in BASE_TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, plan, name):
    df = QUERIES[name](spark, FOLDER)
    text = plan(df)
    for word in ("CartesianProduct", "NestedLoopJoin", "BatchEvalPython"):
        assert word not in text
    cursor = duck.execute(ORACLES[name])
    names = [column[0] for column in cursor.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted((tuple(row) for row in cursor.fetchall()), key=repr)
    got = sorted((tuple(row) for row in df.select(*names).collect()), key=repr)
    assert len(got) > 0
    assert got == expected


def test_entry(spark):
    assert spark_entry.entry(spark).count() == 10
