"""Selections by date: eligible rows, top rows, books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators.xsection import with_bucket

BOOK = ("date", "ticker", "weight", "side")


def clip_dates(df: DataFrame, start: str | None = None, end: str | None = None, col: str = "date") -> DataFrame:
    """Rows between the dates, both included; None is no bound."""
    if start is not None:
        df = df.where(F.col(col) >= F.lit(start).cast("date"))
    return df if end is None else df.where(F.col(col) <= F.lit(end).cast("date"))


def investable(price: Column, lag_days: Column, cap: Column, *, least_cap: float = 100e6, most_quarters: float = 4.0) -> Column:
    """Priced, filed within ``most_quarters`` and large enough; unknown is not investable."""
    return F.coalesce(price.isNotNull() & (lag_days / 92.0 <= most_quarters) & (cap >= least_cap), F.lit(False))


def eligible(scores: DataFrame, *, score: str = "score", gate: str = "investable", liquidity: str | None = None, floor: float | None = None) -> DataFrame:
    """Rows with a score that pass the gate, if there is one, and reach the liquidity floor, if one is set."""
    out = scores.where(F.col(score).isNotNull())
    if gate in scores.columns:
        out = out.where(F.coalesce(F.col(gate).cast("boolean"), F.lit(False)))
    if floor is not None and liquidity:
        out = out.where(F.col(liquidity) >= floor)
    return out


def _book(df: DataFrame) -> DataFrame:
    return df.where("weight is not null").select("date", "ticker", F.col("weight").cast("double").alias("weight"), F.signum("weight").cast("int").alias("side"))


def top_k_short(scores: DataFrame, k: int = 20, score: str = "score") -> DataFrame:
    """The ``k`` highest scores of each date at -1/k; dates with fewer rows have no book."""
    w = Window.partitionBy("date")
    rows = scores.withColumns({"_r": F.row_number().over(w.orderBy(F.desc(score), "ticker")), "_n": F.count(F.lit(1)).over(w)})
    return _book(rows.where((F.col("_r") <= k) & (F.col("_n") >= k)).withColumn("weight", F.lit(-1.0 / k)))


def quantile_short(scores: DataFrame, n: int = 10, score: str = "score") -> DataFrame:
    """The top bucket of each date, equally weighted to -1."""
    b = with_bucket(scores, score, n)
    top = b.withColumn("_top", F.max("bucket").over(Window.partitionBy("date"))).where("bucket = _top and _top > 0")
    return _book(top.withColumn("weight", -1.0 / F.count(F.lit(1)).over(Window.partitionBy("date"))))


def long_short(scores: DataFrame, n: int = 10, score: str = "score") -> DataFrame:
    """The top bucket short and the bottom one long, each leg adding up to one; one-bucket dates have no book."""
    w = Window.partitionBy("date")
    b = with_bucket(scores, score, n).withColumns({"_top": F.max("bucket").over(w), "_low": F.min("bucket").over(w)}).where("_top > _low and (bucket = _top or bucket = _low)")
    sign = F.when(F.col("bucket") == F.col("_top"), -1.0).otherwise(1.0)
    return _book(b.withColumn("_s", sign).withColumn("weight", F.col("_s") / F.count(F.lit(1)).over(Window.partitionBy("date", "_s"))))


def top_rows(df: DataFrame, *, n: int | None = None, share: float | None = None, score: str = "score") -> DataFrame:
    """The best rows of each date: ``n`` of them, or a share rounded half to even, one at least."""
    w = Window.partitionBy("date")
    cut = F.lit(n) if n is not None else F.greatest(F.bround(F.count(F.lit(1)).over(w) * F.lit(share)), F.lit(1.0))
    rows = df.where(F.col(score).isNotNull()).withColumns({"rank": F.row_number().over(w.orderBy(F.desc(score), "ticker")), "_cut": cut})
    return rows.where(F.col("rank") <= F.col("_cut")).drop("_cut")


def positions(scores: DataFrame, buckets: dict[str, tuple[str, float]], score: str = "score") -> DataFrame:
    """Rows of every (model, bucket): ``buckets`` names a kind (``top`` or ``share``) and its value.

    Rows are ranked once for each model and date and then copied into the buckets they belong to.
    """
    w = Window.partitionBy("model", "date")
    rows = scores.where(F.col(score).isNotNull()).withColumns({"rank": F.row_number().over(w.orderBy(F.desc(score), "ticker")), "_n": F.count(F.lit(1)).over(w)})
    cuts = [F.struct(F.lit(b).alias("bucket"), (F.lit(float(v)) if kind == "top" else F.greatest(F.bround(F.col("_n") * F.lit(v)), F.lit(1.0))).alias("cut")) for b, (kind, v) in buckets.items()]
    return rows.withColumn("_b", F.explode(F.array(*cuts))).where("rank <= _b.cut").withColumn("bucket", F.col("_b.bucket")).drop("_b", "_n")


def latest_date(df: DataFrame, col: str = "date") -> DataFrame:
    """Rows on the last date; the date is one broadcast value."""
    return df.join(F.broadcast(df.agg(F.max(col).alias(col))), col, "left_semi")


def top_candidates(scores: DataFrame, n: int, as_of: str | None = None, score: str = "score") -> DataFrame:
    held = latest_date(clip_dates(scores, end=as_of))
    return held.where(F.col(score).isNotNull()).orderBy(F.desc(score), "ticker").limit(n)


def floor_top_k(df: DataFrame, least: float, k: int = 15, score: str = "prob") -> DataFrame:
    """At most ``k`` rows of each date with a score of ``least`` or more; the best one in any case."""
    w = Window.partitionBy("date").orderBy(F.desc(score), "ticker")
    r = df.where(F.col(score).isNotNull()).withColumn("_r", F.row_number().over(w))
    return r.where((F.col("_r") == 1) | ((F.col("_r") <= k) & (F.col(score) >= least))).drop("_r")
