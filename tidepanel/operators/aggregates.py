"""Summaries: coverage, quality, correlation, histograms, bucket outcomes, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators import wide
from tidepanel.operators.xsection import guarded_corr


def to_rows(df: DataFrame) -> DataFrame:
    """A one-row frame of numbers as (metric, value) rows."""
    cols = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns]
    return df.select(F.explode(F.array(*cols)).alias("s")).select("s.metric", "s.value")


def presence(df: DataFrame) -> DataFrame:
    """Modal company and first and last date of each ticker; ties of the mode go to the smallest name."""
    return df.groupBy("ticker").agg(F.mode("company", True).alias("company"), F.min("date").alias("first_seen"), F.max("date").alias("last_seen"), F.count(F.lit(1)).alias("n_reports"))


def universe_summary(df: DataFrame, cap: str = "mkt_cap") -> DataFrame:
    """Counts, share with a cap, cap quantiles, mean and sum, as (metric, value)."""
    x = F.col(cap)
    q = F.percentile(x, F.array(*[F.lit(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.avg(x.isNotNull().cast("double")).alias("with_cap"), q.alias("q"), F.avg(x).alias("mean"), F.sum(x).alias("sum"))
    return to_rows(row.select("n", "with_cap", *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate((10, 25, 50, 75, 90))], "mean", "sum"))


def top_groups(df: DataFrame, col: str, n: int) -> DataFrame:
    """The ``n`` most frequent values, the rest as one row named ``other``."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).count()
    top = counts.orderBy(F.desc("count"), col).limit(n)
    rest = counts.join(top.select(col), col, "left_anti").agg(F.lit("other").alias(col), F.sum("count").alias("count")).where("count is not null")
    return top.unionByName(rest)


def panel_summary(df: DataFrame, medians: list[str]) -> DataFrame:
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("date").alias("dates"), F.countDistinct("ticker").alias("tickers"), *[F.median(c).alias(f"median_{c}") for c in medians], *[F.avg(F.col(c).isNotNull().cast("double")).alias(f"share_{c}") for c in medians])
    return to_rows(row)


def rows_per_year(df: DataFrame) -> DataFrame:
    return df.groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("ticker").alias("tickers"), F.countDistinct("date").alias("dates"))


def raw_vs_clean(raw: DataFrame, clean: DataFrame, counters: dict[str, Column]) -> DataFrame:
    """(metric, raw, clean, delta) of named counters."""
    a = to_rows(raw.agg(*[c.alias(n) for n, c in counters.items()])).withColumnRenamed("value", "raw")
    b = to_rows(clean.agg(*[c.alias(n) for n, c in counters.items()])).withColumnRenamed("value", "clean")
    return a.join(b, "metric").withColumn("delta", F.col("clean") - F.col("raw"))


def lookahead_audit(panel: DataFrame, lag: str = "filing_lag_days") -> DataFrame:
    """(n_rows, n_violations, worst_days): rows whose filing was not known yet, and by how much at most."""
    x = F.col(lag)
    return panel.agg(F.count(x).alias("n_rows"), F.count_if(x < 0).alias("n_violations"), F.greatest(F.lit(0), F.coalesce(F.max(-x), F.lit(0))).cast("long").alias("worst_days"))


def missing_share(df: DataFrame, cols: list[str]) -> DataFrame:
    return to_rows(df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols]))


def top_correlations(df: DataFrame, cols: list[str], n: int = 5) -> DataFrame:
    return wide.correlations(df, cols).where("corr is not null").orderBy(F.desc(F.abs("corr")), "a", "b").limit(n)


def outlier_counts(df: DataFrame, col: str, most: float = 2.0) -> DataFrame:
    x = F.col(col)
    return df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.max(x).alias("max"), F.min(x).alias("min"), F.count_if(F.abs(x) > most).alias("n_large"))


def coverage_by_date(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy("date").agg(F.count(F.lit(1)).alias("rows"), F.count(col).alias("labels"), (F.count(col) / F.count(F.lit(1))).alias("share"))


def histogram(df: DataFrame, col: str, bins: int, low: float | Column, high: float | Column) -> DataFrame:
    """(bin, count) of equal bins on [low, high], the right edge closed; values outside are left out.

    Edges may be aggregate expressions, such as a percentile.
    """
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    edges = df.agg(as_col(low).cast("double").alias("lo"), as_col(high).cast("double").alias("hi"))
    rows = df.select(F.col(col).cast("double").alias("x")).join(F.broadcast(edges), how="cross").where("x between lo and hi")
    place = F.least(F.floor(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    return rows.groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def bucket_outcomes(df: DataFrame, col: str = "pnl", by: list[str] | None = None) -> DataFrame:
    """Outcome statistics of positions: win share, moments, quantiles, conditional means, tail shares."""
    x = F.col(col)
    win, loss = F.when(x > 0, x), F.when(x <= 0, x)
    q = F.percentile(x, F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    out = df.where(x.isNotNull()).groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.avg((x > 0).cast("double")).alias("win_rate"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), q.alias("_q"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.count(win).alias("wins"), F.count(loss).alias("losses"), F.avg(win).alias("mean_win"), F.avg(loss).alias("mean_loss"), F.median(win).alias("median_win"), F.median(loss).alias("median_loss"),
        *[F.avg((x > t).cast("double")).alias(f"up_{round(t * 100)}") for t in (0.1, 0.25, 0.5, 1.0)], *[F.avg((x < -t).cast("double")).alias(f"down_{round(t * 100)}") for t in (0.1, 0.25, 0.5, 1.0)],
    )
    names = ("p5", "p25", "median", "p75", "p95")
    return out.withColumns({n: F.col("_q")[i] for i, n in enumerate(names)} | {"win_loss_ratio": F.try_divide(F.col("mean_win"), F.abs("mean_loss"))}).drop("_q")


def calibration(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_prob, hit_rate) of right-closed equal bins on [0, 1]; 0 is in the first, empty bins stay."""
    edge = F.greatest(F.ceil(F.col(p) * bins) - 1, F.lit(0)).cast("int")
    got = df.where(F.col(p).between(0, 1) & F.col(y).isNotNull()).groupBy(edge.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_prob"), F.avg(F.col(y).cast("double")).alias("hit_rate"))
    scale = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return scale.join(got, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def hit_rate(df: DataFrame, p: str, target: str, threshold: float = 0.5) -> DataFrame:
    both = F.col(p).isNotNull() & F.col(target).isNotNull()
    return df.where(both).agg(F.avg(((F.col(p) >= threshold) == (F.col(target) > 0)).cast("double")).alias("hit_rate"))


def latest_covered_date(scores: DataFrame, share: float = 0.7) -> DataFrame:
    """The last date on which every model scored at least ``share`` of the tickers there are."""
    models = scores.select("model").distinct()
    total = scores.agg(F.countDistinct("ticker").alias("t"))
    per = scores.where("score is not null").groupBy("date", "model").agg(F.countDistinct("ticker").alias("n")).join(F.broadcast(total), how="cross").where(F.col("n") >= share * F.col("t"))
    need = models.agg(F.count(F.lit(1)).alias("m"))
    return per.groupBy("date").agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(need), how="cross").where("k = m").agg(F.max("date").alias("date"))


def ticker_rollup(trades: DataFrame, col: str = "pnl") -> DataFrame:
    x = F.col(col)
    return trades.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("total"), F.avg(x).alias("mean"), F.max(x).alias("best"), F.min(x).alias("worst"), F.avg((x > 0).cast("double")).alias("hit"), F.min("date").alias("first"), F.max("date").alias("last"))


def mean_abs(df: DataFrame, cols: list[str]) -> DataFrame:
    return to_rows(df.agg(*[F.avg(F.abs(c)).alias(c) for c in cols])).orderBy(F.desc("value"), "metric")


def period_rollups(df: DataFrame, keys: list[str], period: str, value: str) -> DataFrame:
    """Count, mean and win share by keys and period, and over all periods, in one pass."""
    x = F.col(value)
    got = df.rollup(*keys, period).agg(F.grouping_id().alias("_g"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.avg((x > 0).cast("double")).alias("win_rate"))
    return got.where("_g <= 1").withColumn(period, F.when(F.col("_g") == 1, "ALL").otherwise(F.col(period))).drop("_g")


def vendor_flag(n: Column, corr: Column, diff: Column, *, least: int = 12, warn: float = 0.98, bad: float = 0.9) -> Column:
    return F.when((n < least) | corr.isNull(), "insufficient").when(corr < bad, "mismatch").when((corr < warn) | (diff > 1.0), "warn").otherwise("ok")


def monthly_last(df: DataFrame, value: str = "px", time: str = "date", key: str = "ticker") -> DataFrame:
    """The last non-null value of each month."""
    return df.where(F.col(value).isNotNull()).groupBy(key, F.last_day(time).alias("month")).agg(F.max_by(value, time).alias(value))


def vendor_check(a: DataFrame, b: DataFrame, value: str = "px", key: str = "ticker") -> DataFrame:
    """Correlation (Pearson) of monthly returns of two vendors, and the median absolute difference in percent."""
    w = Window.partitionBy(key).orderBy("month")
    both = monthly_last(a, value, key=key).withColumnRenamed(value, "_a").join(monthly_last(b, value, key=key).withColumnRenamed(value, "_b"), [key, "month"])
    r = both.withColumns({"_ra": F.try_divide("_a", F.lag("_a").over(w)) - 1, "_rb": F.try_divide("_b", F.lag("_b").over(w)) - 1})
    got = r.groupBy(key).agg(F.count(F.col("_ra") + F.col("_rb")).alias("n"), guarded_corr(F.col("_ra"), F.col("_rb")).alias("corr"), (F.median(F.abs(F.try_divide("_a", "_b") - 1)) * 100).alias("median_diff_pct"))
    return got.withColumn("flag", vendor_flag(F.col("n"), F.col("corr"), F.col("median_diff_pct")))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` keys in an order that the seed decides."""
    return df.select(key).distinct().orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def top_frequent(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.groupBy(key).count().orderBy(F.desc("count"), key).limit(n)
