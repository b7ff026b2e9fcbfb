"""Every registered panel query runs, and equals its SQL on the smallest tables."""

import glob
import math
from pathlib import Path

import pytest

from tidepanel.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def norm(rows):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        return f"{float(v):.4f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    place = [names.index(c) for c in cols]
    want = [tuple(r[i] for i in place) for r in rel.fetchall()]
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    a, b = norm(got), norm(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            assert u == v or abs(float(u) - float(v)) <= 2e-4 + 1e-6 * abs(float(v)), (x, y)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = registry.queries()[name](spark, SF)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)


def test_entry_imports_and_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["date", "ticker", "mom_1m", "mom_rk", "bucket"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
