"""The universe: who was reported, when, and with which attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.text import is_ordinary
from tidepanel.operators.aggregates import presence
from tidepanel.operators.asof import with_profile


def build_universe(reports: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Presence of each ticker with its profile; without profiles the reported company is the name."""
    seen = presence(reports)
    return with_profile(seen, profiles) if profiles is not None else seen.withColumn("name", F.col("company"))


def ordinary_only(reports: DataFrame) -> DataFrame:
    return reports.where(is_ordinary(F.col("company")))


def restrict(df: DataFrame, listed: DataFrame, key: str = "ticker") -> DataFrame:
    return df.join(listed.select(key).distinct(), key, "left_semi")


def exclude(df: DataFrame, held: DataFrame, key: str = "ticker") -> DataFrame:
    return df.join(held.select(key).distinct(), key, "left_anti")


def compare(old: DataFrame, new: DataFrame, key: str = "ticker") -> DataFrame:
    """(ticker, state): added, removed or kept."""
    a, b = old.select(key).distinct().withColumn("_o", F.lit(1)), new.select(key).distinct().withColumn("_n", F.lit(1))
    state = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").otherwise("kept")
    return a.join(b, key, "full").select(key, state.alias("state"))
