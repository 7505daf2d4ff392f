"""Every query that has SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from ambulo.llm import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_query_equals_sql(spark, db, name):
    found, truth = registry.QUERIES[name](spark, FOLDER).toPandas(), db.sql(registry.ORACLES[name]).df()
    names = sorted(found.columns)
    assert names == sorted(truth.columns) and len(found) == len(truth) > 0
    found, truth = (df[names].sort_values(names).reset_index(drop=True) for df in (found, truth))
    pd.testing.assert_frame_equal(found, truth, check_dtype=False)
