"""Every query with an SQL twin gives the twin's rows at the smallest scale."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from spanmill.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    if not glob.glob(SF):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def cell(x):
    if x is None or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
        return None
    x = x.item() if hasattr(x, "item") else x
    return round(float(x), 5) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


def rows(df):
    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLES:
        expected = duck.sql(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows(got) == rows(expected)
    else:
        assert len(got)
