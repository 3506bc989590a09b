"""The operators' queries equal their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from contentloom.llm import queries
from tests.test_entry import DATA, normal, there


@there
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    frame = queries.queries()[name](spark, DATA)
    relation = con.sql(queries.oracle_sql()[name])
    assert sorted(relation.columns) == sorted(frame.columns)
    assert normal(frame.collect(), frame.columns) == normal(relation.fetchall(), relation.columns)
