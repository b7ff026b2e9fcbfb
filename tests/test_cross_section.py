from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import aggregates as agg
from tidepanel.operators import selection
from tidepanel.operators import xsection as xs

D = date(2024, 1, 5)


def frame(spark, values, name="x"):
    return spark.createDataFrame([(D, f"T{i:02d}", v) for i, v in enumerate(values)], f"date date, ticker string, {name} double")


def test_percentile_rank_equals_pandas(spark):
    values = [3.0, 1.0, 3.0, None, 2.0, 9.0]
    got = [r["r"] for r in frame(spark, values).withColumn("r", xs.percentile_rank(F.col("x"))).orderBy("ticker").collect()]
    want = pd.Series(values).rank(pct=True)
    assert [None if pd.isna(a) else a for a in want] == got
    many = xs.rank_columns(frame(spark, values), ["x"]).orderBy("ticker").collect()
    assert [r["x_rk"] for r in many] == got


@pytest.mark.parametrize("n", [10, 13, 25, 37, 50])
def test_bucket_equals_qcut_of_ranks(spark, n):
    values = [float((i * 7919) % 1009) for i in range(n)]
    got = [r["bucket"] for r in xs.with_bucket(frame(spark, values), "x", 5).orderBy("ticker").collect()]
    assert got == pd.qcut(pd.Series(values).rank(method="first"), 5, labels=False).tolist()


def test_decile_label_of_equal_values_is_null(spark):
    assert {r["decile"] for r in xs.with_decile_label(frame(spark, [1.0] * 20), "x").collect()} == {None}
    few = xs.with_decile_label(frame(spark, [float(i) for i in range(9)]), "x")
    assert {r["decile"] for r in few.collect()} == {None}


def test_ic_is_one_for_monotone_pairs_and_null_for_constant(spark):
    df = spark.createDataFrame([(D, f"T{i}", float(i), float(i * i), 1.0) for i in range(5)], "date date, ticker string, p double, t double, c double")
    assert xs.rank_ic(df, "p", "t").first()["ic"] == pytest.approx(1.0)
    assert xs.ic(df, "p", "c").first()["ic"] is None


def test_spread_and_small_groups(spark):
    df = frame(spark, [float(i) for i in range(50)], "p").withColumn("t", F.col("p"))
    assert xs.bucket_spread(df, "p", "t").first()["spread"] == pytest.approx(45.0)
    assert xs.bucket_spread(df.limit(5), "p", "t").first()["spread"] is None


def test_winsor_zscore_and_neutral(spark):
    df = frame(spark, [float(i) for i in range(30)]).withColumn("g", F.pmod(F.xxhash64("ticker"), F.lit(3)).cast("string"))
    z = [r["x_z"] for r in xs.with_zscore(df, ["x"]).collect()]
    assert abs(sum(z)) < 1e-9
    one = {r["ticker"]: r["x_neutral"] for r in xs.neutralize(df, "x", ["g"]).collect()}
    two = {r["ticker"]: r["x_neutral"] for r in xs.neutralize(df.withColumn("h", F.col("g")), "x", ["g", "h"]).collect()}
    assert all(abs(one[t] - two[t]) < 1e-9 for t in one)


def test_books_add_up(spark):
    df = frame(spark, [float(i) for i in range(30)], "score")
    assert selection.top_k_short(df, 20).agg(F.sum("weight")).first()[0] == pytest.approx(-1)
    assert selection.top_k_short(df, 31).count() == 0
    legs = {r["side"]: r["w"] for r in selection.long_short(df).groupBy("side").agg(F.sum("weight").alias("w")).collect()}
    assert legs == {-1: pytest.approx(-1), 1: pytest.approx(1)}
    assert selection.long_short(frame(spark, [1.0], "score")).count() == 0


def test_calibration_keeps_empty_bins_and_right_edges(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.1, 0.0), (0.11, 1.0), (1.0, 1.0)], "p double, y double")
    n = {r["bin"]: r["n"] for r in agg.calibration(df, "p", "y").collect()}
    assert n[0] == 2 and n[1] == 1 and n[9] == 1 and len(n) == 10


def test_ranks_of_many_columns_take_one_exchange_and_equal_the_windows(spark):
    rows = [("d1", f"t{i}", [3.0, None, 1.0, 3.0, float("nan"), -0.0, 0.0][i % 7], i % 4) for i in range(30)] + [("d2", None, 1.0, 1), ("d2", "a", 2.0, 1), (None, "b", 5.0, 2)]
    df = spark.createDataFrame(rows, "date string, ticker string, x double, n int")
    got = xs.rank_columns(df, ["x", "n"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    want = df.withColumns({"x_rk": xs.percentile_rank(F.col("x")), "n_rk": xs.percentile_rank(F.col("n").cast("double"))})
    key = lambda r: (str(r["date"]), str(r["ticker"]))
    for a, b in zip(sorted(got.collect(), key=key), sorted(want.collect(), key=key), strict=True):
        known = a["date"] is not None and a["ticker"] is not None
        assert (a["x_rk"], a["n_rk"]) == ((b["x_rk"], b["n_rk"]) if known else (None, None))
