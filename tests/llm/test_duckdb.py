"""Queries with SQL, against DuckDB over the smallest tables."""

import glob
import os

import duckdb
import pytest

from tests.test_oracle import FOLDER, rows
from tracewell.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f).split('.')[0]} AS SELECT * FROM '{f}'")
    got, want = queries.QUERIES[name](spark, FOLDER).toPandas(), c.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
