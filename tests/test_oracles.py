"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import numpy as np
import pandas as pd
import pytest

duckdb = pytest.importorskip("duckdb")

from tallow.queries import ORACLES, QUERIES  # noqa: E402

NAMES = sorted({QUERIES[n]: n for n in ORACLES if not n.startswith("pat_")}.values())


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(frame: pd.DataFrame) -> pd.DataFrame:
    out = {}
    for k in sorted(frame.columns):
        s = frame[k]
        if pd.api.types.is_numeric_dtype(s) and s.dtype != bool or any(type(v).__name__ == "Decimal" for v in s):
            out[k] = pd.to_numeric(s).astype(float)
        elif "datetime" in str(s.dtype) or any(type(v).__name__ == "date" for v in s):
            out[k] = pd.to_datetime(s).astype(str)
        else:
            out[k] = s.map(lambda v: "" if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)) else str(v))
    d = pd.DataFrame(out)
    return d.sort_values(list(d.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, sf, db, name):
    a, b = plain(QUERIES[name](spark, sf).toPandas()), plain(db.sql(ORACLES[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for k in a.columns:
        if a[k].dtype.kind == "f":
            np.testing.assert_allclose(a[k], pd.to_numeric(b[k]), rtol=1e-9, atol=2e-6, equal_nan=True)
        else:
            assert (a[k] == b[k]).all(), k
