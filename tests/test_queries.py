"""Every registered query against its SQL in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from panelforge.plans.registry import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(df):
    out = {}
    for c in sorted(df.columns):
        v = df[c]
        if v.dtype == object or "date" in str(v.dtype):
            out[c] = v.map(lambda x: "" if x is None or x is pd.NaT or x != x else str(x)[:10] if hasattr(x, "year") else str(float(x)) if isinstance(x, int | float) and not isinstance(x, bool) else str(x))
        else:
            out[c] = v.astype(float)
    df = pd.DataFrame(out)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, con, name):
    got, want = plain(QUERIES[name](spark, DATA).toPandas()), plain(con.execute(ORACLE_SQL[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-6, atol=2e-6)


def test_what_has_no_sql(spark):
    """An enumeration of supports; test_operators holds it against plain code."""
    assert sorted(set(QUERIES) - set(ORACLE_SQL)) == ["r10_style_exposure"]
    q = QUERIES["t07_q_values"](spark, DATA).collect()
    assert all(r["p"] <= r["q"] <= 1 for r in q if r["p"] is not None) and len(q) == 3
    e = QUERIES["r10_style_exposure"](spark, "/root/testdata/sf0.01").collect()
    assert e and all(min(r["af"], r["no"], r["ro"]) >= -1e-9 and r["af"] + r["no"] + r["ro"] <= 1 + 1e-6 and r["r2"] <= 1 for r in e)
