"""Dates: Fridays, business-day offsets, period ends, horizons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labels of horizons in weeks (fixed values).
HORIZONS = {1: "1w", 4: "1m", 12: "3m", 26: "6m", 52: "12m"}


def horizon_label(weeks: int) -> str:
    return HORIZONS.get(weeks, f"{weeks}w")


def recent_friday(d: Column) -> Column:
    """The last Friday on or before the date."""
    return F.date_sub(d, F.pmod(F.weekday(d) - 4, F.lit(7)).cast("int"))


def week_friday(ts: Column) -> Column:
    """The Friday of the date's Monday-based week."""
    return F.date_add(F.to_date(F.date_trunc("week", ts)), 4)


def as_of_date(release: Column) -> Column:
    """Four business days earlier, on a Monday-to-Friday calendar without holidays."""
    w = F.weekday(release)
    return F.date_sub(release, F.when(w <= 3, 6).when(w == 6, 5).otherwise(4))


def filing_lag_days(date: Column, accepted: Column) -> Column:
    """Whole days between the filing's acceptance and the date."""
    seconds = F.unix_timestamp(date.cast("timestamp")) - F.unix_timestamp(accepted.cast("timestamp"))
    return F.floor(seconds / 86400).cast("int")


def stale_quarters(lag_days: Column) -> Column:
    return lag_days / F.lit(92.0)


def fridays_back(spark: SparkSession, weeks: int, anchor: str) -> DataFrame:
    """``weeks`` Fridays up to the one on or before ``anchor``."""
    last = recent_friday(F.lit(anchor).cast("date"))
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(last, 7 * (weeks - 1)), last, F.expr("interval 7 days"))).alias("date"))


def _steps(spark: SparkSession, start: str, end: str, every: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr(f"interval {every}"))).alias("d"))


def week_ends(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Fridays between the dates, both included."""
    return _steps(spark, start, end, "1 day").where(F.weekday("d") == 4).select(F.col("d").alias("date"))


def month_ends(spark: SparkSession, start: str, end: str) -> DataFrame:
    return _steps(spark, start, end, "1 day").where(F.col("d") == F.last_day("d")).select(F.col("d").alias("date"))


def quarter_ends(spark: SparkSession, start: str, end: str) -> DataFrame:
    return month_ends(spark, start, end).where(F.month("date") % 3 == 0)
