"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from mzloom.plans.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    a, b = QUERIES[name](spark, str(DATA)).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    for c in cols:
        x, y = a[c], b[c]
        assert not ((x.isna() != y.isna()) | ((x != y) & x.notna())).any(), c
