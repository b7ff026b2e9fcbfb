"""Wide moments against numpy; residuals on crossed dummies against least squares."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.features.build import feature_summary
from tidepanel.operators import neutral, wide
from tidepanel.operators.aggregates import top_correlations


def frame(spark, x, parts=5):
    cols = [f"c.{i}" for i in range(x.shape[1])]  # a dot in a name is no path
    pdf = pd.DataFrame(x, columns=cols)
    return spark.createDataFrame(pdf).repartition(parts), cols


def test_600_columns_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 600)) @ np.diag(np.geomspace(1e-3, 1e6, 600)) + 1e7
    x[:, 1] = x[:, 0] * 2 + rng.normal(size=900) * 1e-4
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 7], x[:, 8], x[3, 9] = 4.25, np.nan, np.inf
    df, cols = frame(spark, x)
    got = wide.correlations(df, cols)
    assert got.count() == 600 * 599 // 2
    held = {(r["a"], r["b"]): r for r in got.collect()}
    for a, b in [(0, 1), (2, 5), (0, 599), (255, 256), (9, 511), (100, 300), (7, 3), (8, 2), (9, 10)]:
        both = np.isfinite(x[:, a]) & np.isfinite(x[:, b])
        r = held[(cols[min(a, b)], cols[max(a, b)])]
        assert r["n"] == both.sum()
        if 7 in (a, b) or 8 in (a, b):
            assert r["corr"] is None
        else:
            assert abs(r["corr"] - np.corrcoef(x[both, a], x[both, b])[0, 1]) < 1e-7
    top = top_correlations(df, cols, 1).first()
    assert (top["a"], top["b"]) == (cols[0], cols[1])
    shares = {r["metric"]: r["value"] for r in wide.missing(df, cols).collect()}
    assert len(shares) == 600 and all(abs(shares[c] - 1 + np.isfinite(x[:, i]).mean()) < 1e-12 for i, c in enumerate(cols))
    assert len(df.select(*[f"`{c}`" for c in cols])._jdf.queryExecution().optimizedPlan().toString()) < 200_000


def test_few_rows_and_empty(spark):
    df, cols = frame(spark, np.array([[1.0, 2.0, np.nan]]), 1)
    assert all(r["corr"] is None for r in wide.correlations(df, cols).collect())
    assert [(r["n"], r["corr"]) for r in wide.correlations(df.limit(0), cols).collect()] == [(0, None)] * 3
    assert [r["value"] for r in wide.missing(df.limit(0), cols).collect()] == [None] * 3
    assert wide.correlations(df, cols[:1]).count() == 0
    missing, strongest = feature_summary(df, cols)
    assert missing.count() == 3 and strongest.count() == 0


def least_squares(pdf, groups):
    out = pd.Series(pdf["x"].astype(float).to_numpy(), index=pdf.index)
    for _, part in pdf.groupby("date"):
        part = part[part["x"].notna() & part[groups].notna().all(axis=1)]
        dummies = pd.concat([pd.get_dummies(part[g].astype(str), prefix=g) for g in groups], axis=1).to_numpy(float)
        y = part["x"].to_numpy(float)
        if not len(y):
            continue
        out.loc[part.index] = y - (y.mean() if len(y) <= dummies.shape[1] else dummies @ np.linalg.lstsq(dummies, y, rcond=None)[0])
    return out


@pytest.mark.parametrize("groups", [["g", "h"], ["g", "h", "k"]])
def test_crossed_dummies_equal_least_squares(spark, groups):
    rng = np.random.default_rng(3)
    n = 1500
    pdf = pd.DataFrame({"date": rng.integers(0, 6, n), "ticker": np.arange(n), "g": rng.integers(0, 9, n), "h": rng.choice(list("abcd"), n, p=[0.7, 0.1, 0.1, 0.1]), "k": rng.integers(0, 5, n)})
    pdf["x"] = 1e3 + pdf["g"] * 2.0 + (pdf["h"] == "a") * 5 + rng.normal(size=n)
    pdf.loc[pdf["date"] == 5, "date"] = np.where(np.arange((pdf["date"] == 5).sum()) < 9, 5, 0)  # a date of nine rows
    pdf["_x"], pdf["by"], pdf["n"], pdf["m"] = 1, 2, 3, 4
    spark_rows = spark.createDataFrame(pdf)
    spark_rows = spark_rows.withColumns({"x": F.when(F.col("ticker") % 50 != 0, F.col("x")), "g": F.when(F.col("ticker") % 70 != 1, F.col("g"))})
    pdf.loc[pdf["ticker"] % 50 == 0, "x"] = np.nan
    pdf["g"] = pdf["g"].astype("float").where(pdf["ticker"] % 70 != 1)
    got = neutral.neutralize_crossed(spark_rows.union(spark_rows), "x", groups).toPandas().drop_duplicates("ticker").sort_values("ticker")
    twice = pd.concat([pdf, pdf], ignore_index=True)
    want = least_squares(twice, groups).iloc[:n]
    own = got["x_neutral"].to_numpy()
    assert list(got.columns[:-1]) == list(pdf.columns) and len(got) == n
    assert (np.isnan(own) == np.isnan(want.to_numpy())).all()
    assert np.nanmax(np.abs(own - want.to_numpy())) < 1e-9


def test_slow_sweeps_are_not_passed_over(spark, monkeypatch):
    # a chain of groups that touch in single rows converges slowly
    rows = [(1, i // 2, (i + 1) // 2, float(i * i % 17)) for i in range(60)]
    df = spark.createDataFrame(rows, "date int, g int, h int, x double")
    monkeypatch.setattr(neutral, "JOBS", 1)
    extra = df.union(df)
    with pytest.raises(neutral.NotConverged):
        neutral.neutralize_crossed(extra, "x", ["g", "h"]).count()
    assert neutral.neutralize_crossed(df.limit(0), "x", ["g", "h"]).count() == 0
    assert neutral.neutralize_crossed(df.withColumn("x", F.lit(0.0)), "x", ["g", "h"]).agg(F.max("x_neutral")).first()[0] == 0
