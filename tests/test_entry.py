"""The driver's contract, and that queries equal their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as driver
from contentloom import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
there = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def normal(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(f"{float(r[k]):.9g}" if isinstance(r[k], float) else str(r[k]) for k in order) for r in rows)


@there
def test_entry(spark):
    assert len(driver.entry(spark).take(1)) == 1


def test_names():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert len(catalog.queries()) >= 48


@there
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    frame = driver.queries()[name](spark, DATA)
    relation = con.sql(driver.oracle_sql()[name])
    columns = relation.columns
    assert sorted(columns) == sorted(frame.columns)
    assert normal(frame.collect(), frame.columns) == normal(relation.fetchall(), columns)
