from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidepanel.features.families import price_family
from tidepanel.functions import calendar as cal
from tidepanel.functions import nulls
from tidepanel.operators import windows as w

FRIDAY = date(2024, 1, 5)


def series(spark, values, ticker="A", col="adj_close"):
    rows = [(ticker, FRIDAY + timedelta(weeks=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"ticker string, date date, {col} double")


def column(df, name):
    return [r[name] for r in df.orderBy("ticker", "date").collect()]


def test_momentum_ramp(spark):
    df = w.with_padded(series(spark, range(1, 11)), "adj_close").withColumn("m", w.change(F.col("_pad"), 4))
    got = column(df, "m")
    assert got[:4] == [None] * 4
    assert got[4:6] == [4.0, 2.0] and got[9] == pytest.approx(2 / 3)


def test_momentum_does_not_leak_between_tickers(spark):
    df = series(spark, range(1, 7)).unionByName(series(spark, range(10, 70, 10), "B"))
    got = column(price_family(df), "mom_1m")
    assert got[4] == 4.0 and got[10] == 4.0 and got[6:10] == [None] * 4


def test_padding_carries_prices_over_gaps(spark):
    df = series(spark, [1, 2, None, None, 4, 8])
    filled = column(w.with_padded(df, "adj_close").withColumn("m", w.change(F.col("_pad"))), "m")
    assert filled == [None, 1.0, 0.0, 0.0, 1.0, 1.0]
    plain = column(w.with_padded(df, "adj_close", fill=False).withColumn("m", w.change(F.col("_pad"))), "m")
    assert plain == [None, 1.0, None, None, None, 1.0]


def test_persistence(spark):
    up = series(spark, [5, 6, 7, 8, 9, 10, 9, 8], "A", "x").unionByName(series(spark, range(10, 2, -1), "B", "x"))
    df = up.withColumn("d", w.difference(F.col("x"))).withColumn("p", w.rises(F.col("d")))
    assert column(df, "p") == [None, None, None, 3, 4, 5, 4, 3] + [None] * 3 + [0] * 5


def test_rolling_percentile_counts_ties_by_half(spark):
    df = series(spark, [1, 2, 2, 3], col="x").withColumn("p", w.rolling_percentile(F.col("x"), 4, 1))
    assert column(df, "p") == [1.0, 1.0, pytest.approx(2.5 / 3), 1.0]


def test_rolling_z_refuses_one_row():
    with pytest.raises(ValueError):
        w.rolling_z(None, 1)


def test_four_divisions(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 0.0), (3.0, None), (4.0, -5.0), (1.0, 1e-13)], "n double, d double")
    get = lambda f: [r[0] for r in df.select(f(F.col("n"), F.col("d"))).collect()]
    assert get(nulls.divide)[:4] == [0.5, None, None, -0.8]
    assert get(nulls.divide_positive)[3] is None
    assert get(nulls.divide_tiny)[4] is None


def test_friday_and_business_days(spark):
    days = [(date(2024, 1, 12),), (date(2024, 1, 9),), (date(2024, 1, 8),), (date(2024, 1, 13),), (date(2024, 1, 14),)]
    rows = spark.createDataFrame(days, "d date").select(cal.as_of_date(F.col("d")).alias("a"), cal.recent_friday(F.col("d")).alias("f")).collect()
    assert [r["a"].day for r in rows] == [8, 3, 2, 9, 9]
    assert [r["f"].day for r in rows] == [12, 5, 5, 12, 12]


def test_features_do_not_look_ahead(spark):
    df = series(spark, [3, 5, 4, 8, 7, 9, 6, 10, 12, 11])
    cut = FRIDAY + timedelta(weeks=6)
    full = price_family(df).where(F.col("date") <= F.lit(cut)).orderBy("date").collect()
    assert full == price_family(df.where(F.col("date") <= F.lit(cut))).orderBy("date").collect()
