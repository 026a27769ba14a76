import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from rasterloom import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import glob
    import os

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), duck.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda row: tuple((bool(pd.isna(v)), "" if pd.isna(v) else f"{float(v):.3f}" if isinstance(v, (int, float)) else str(v)) for v in row)
    cols = sorted(got.columns)
    a, b = (sorted(d[cols].astype(object).itertuples(index=False, name=None), key=key) for d in (got, want))
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            missing = [bool(pd.isna(w)) for w in (u, v)]
            assert all(missing) or not any(missing) and (math.isclose(u, v, rel_tol=1e-6, abs_tol=1e-6) if isinstance(u, (int, float)) else str(u) == str(v))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
