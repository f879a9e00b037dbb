"""Every query with SQL gives DuckDB's rows on the small tables; the others run."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from lorekeep import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(x):
    if isinstance(x, (list, tuple)) and not hasattr(x, "asDict"):
        return tuple(plain(y) for y in x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x + 0.0:.10g}")
    return x


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[k]) for k in cols) for r in df.collect()), key=repr)
    cursor = duck.execute(plans.ORACLES[name])
    at = {d[0]: k for k, d in enumerate(cursor.description)}
    assert sorted(at) == cols
    want = sorted((tuple(plain(r[at[k]]) for k in cols) for r in cursor.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, name):
    plans.QUERIES[name](spark, SF).collect()
