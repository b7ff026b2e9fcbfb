"""Factor audits: information coefficients by factor and by model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators.xsection import guarded_corr, ic, ic_stats, ic_summary, qcut_bucket, rank_ic


def factor_long(df: DataFrame, factors: list[str], target: str) -> DataFrame:
    return df.select("date", "ticker", F.col(target).alias("_y"), F.explode(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).cast("double").alias("x")) for c in factors])).alias("s")).select("date", "ticker", "_y", "s.*")


def factor_audit(df: DataFrame, factors: list[str], target: str, *, signs: dict[str, int] | None = None, least_dates: int = 12, least_t: float = 2.0) -> DataFrame:
    """Per factor: mean rank IC, t, hit share, dates and a verdict.

    KEEP: significant with the expected sign. WRONG SIGN: significant against it. WEAK: otherwise.
    """
    per = rank_ic(factor_long(df, factors, target), "x", "_y", by=["factor", "date"])
    out = ic_summary(per, "ic", ["factor"]).where(F.col("n") >= least_dates)
    sign = F.lit(-1)
    for name, s in (signs or {}).items():
        sign = F.when(F.col("factor") == name, s).otherwise(sign)
    return out.withColumn("verdict", F.when(F.abs(F.coalesce("t", F.lit(0.0))) < least_t, "WEAK").when(F.signum("mean") == sign, "KEEP").otherwise("WRONG SIGN"))


def model_table(scores: DataFrame, score: str = "score", target: str = "fwd_ret", n: int = 10) -> DataFrame:
    """model × (ALL, IS, OOS): rank IC statistics and the mean spread of the buckets.

    Complete pairs are copied into their period and ALL and dealt out once by (model, period, date). Ranks and
    buckets are windows over that one partitioning, and one aggregate takes both statistics from it.
    """
    periods = F.array(*([F.col("period")] if "period" in scores.columns else []), F.lit("ALL"))
    keys = ["model", "_period", "date"]
    pairs = scores.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    pairs = pairs.select("model", F.explode(periods).alias("_period"), "date", "ticker", F.col(score).alias("_x"), F.col(target).alias("_y")).repartition(*keys)
    group = Window.partitionBy(*keys)

    def place(c: str) -> Column:
        peers = group.orderBy(c).rangeBetween(Window.currentRow, Window.currentRow)
        return F.rank().over(group.orderBy(c)) + (F.count(F.lit(1)).over(peers) - 1) / 2

    bucket = qcut_bucket(F.row_number().over(group.orderBy("_x", "ticker")), F.count(F.lit(1)).over(group), n)
    placed = pairs.withColumns({"_a": place("_x"), "_b": place("_y"), "_bucket": bucket})
    end = lambda b: F.avg(F.when(F.col("_bucket") == b, F.col("_y")))
    per = placed.groupBy(*keys).agg(F.round(guarded_corr(F.col("_a"), F.col("_b")), 12).alias("ic"), F.when(F.count(F.lit(1)) >= n, end(n - 1) - end(0)).alias("spread"))
    return per.groupBy("model", F.col("_period").alias("period")).agg(*ic_stats(F.col("ic")), F.avg("spread").alias("mean_spread")).where("n > 0")


def pooled_bucket_means(scores: DataFrame, n: int = 12, score: str = "score", target: str = "fwd_ret") -> DataFrame:
    """Mean target by bucket of the pooled score of each model; edges are the model's own quantiles."""
    edges = scores.groupBy("model").agg(F.array_distinct(F.percentile(score, F.array(*[F.lit(i / n) for i in range(n + 1)]))).alias("_e"))
    rows = scores.where(F.col(score).isNotNull() & F.col(target).isNotNull()).join(F.broadcast(edges), "model")
    bucket = F.greatest(F.size(F.filter("_e", lambda e: e < F.col(score))) - 1, F.lit(0))
    return rows.groupBy("model", bucket.alias("bucket")).agg(F.avg(target).alias("mean_target"), F.count(F.lit(1)).alias("n"))


__all__ = ["factor_audit", "factor_long", "ic", "model_table", "pooled_bucket_means"]
