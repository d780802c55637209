"""Every catalogued query against its SQL form, on the smallest sample."""

import os

import pytest

import __spark_entry__ as spark_entry
from grovemeter.plans import catalog, oracles

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables not present")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    from check import TABLES

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def test_every_query_has_its_sql():
    assert set(catalog.queries()) == set(oracles.oracle_sql())


def test_all_queries_are_registered():
    assert set(catalog.queries()) <= set(spark_entry.queries())
    assert set(oracles.oracle_sql()) <= set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


def test_flagship(spark):
    assert spark_entry.entry(spark).head().asDict() == {"size": 159543525376, "inodes": 7680}


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_matches_sql(spark, duck, name):
    from check import rows_of

    got = spark_entry.queries()[name](spark, FOLDER).toPandas()
    want = duck.sql(spark_entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
