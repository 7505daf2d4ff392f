"""Every core query against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from ambulo.plans import queries as core

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def test_every_query_has_sql():
    assert core.QUERIES.keys() == core.ORACLES.keys() and len(core.QUERIES) > 40


@pytest.mark.parametrize("name", list(core.QUERIES))
def test_query_equals_sql(spark, db, name):
    found, truth = core.QUERIES[name](spark, FOLDER).toPandas(), db.sql(core.ORACLES[name]).df()
    names = sorted(found.columns)
    assert names == sorted(truth.columns) and len(found) == len(truth)

    def order(df):
        df = pd.DataFrame({n: df[n].map({True: "true", False: "false"}) if str(df[n].dropna().infer_objects().dtype) in ("bool", "boolean") else df[n] for n in names})
        df = pd.DataFrame({n: c.astype(object).where(c.notna(), "none").astype(str) if c.dtype == object else c for n, c in df.items()})
        return df.sort_values(names).reset_index(drop=True)

    pd.testing.assert_frame_equal(order(found), order(truth), check_dtype=False, check_exact=False, rtol=1e-9, atol=1e-9)
