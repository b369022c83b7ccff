"""Each catalog query against its SQL in DuckDB, over the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tracewell.plans import catalog, contexts, lines, meta, more, passes  # noqa: F401

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f).split('.')[0]} AS SELECT * FROM '{f}'")
    return c


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    number = lambda x: round(x, 6) if isinstance(x, float) else x
    plain = lambda x: "null" if pd.isna(x) else str(int(x)) if isinstance(x, float) and x == int(x) else str(number(x))
    return sorted(tuple(plain(x) for x in r) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER).toPandas()
    want = duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
