"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


def rows(frame):
    def plain(x):
        if x is None or pd.api.types.is_scalar(x) and pd.isna(x):
            return None
        if type(x).__name__ in ("float", "float64", "Decimal"):
            return round(float(x), 6)
        return int(x) if isinstance(x, int | np.integer) and not isinstance(x, bool) else str(x)

    return sorted(map(repr, frame[sorted(frame.columns)].map(plain).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    spark.catalog.clearCache()
