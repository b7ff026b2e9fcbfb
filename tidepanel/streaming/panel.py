"""Structured Streaming variants. The panel itself is a batch product; these are an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed_bars(events: DataFrame, *, late: str = "2 days", width: str = "1 day") -> DataFrame:
    """Bars by user and window of the events: count, sum and last value; rows later than ``late`` are dropped."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width), "user_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max_by("value", "ts").alias("last_value"))
        .select(F.col("window.start").alias("start"), "user_id", "n", "total", "last_value")
    )


def sessions(events: DataFrame, *, late: str = "2 days", gap: str = "6 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), "user_id", "n")
