"""Metrics of return series: a table of (date, ret), one row a period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.nulls import finite

def _series() -> Window:
    return Window.orderBy("date")


def cleaned(df: DataFrame, col: str = "ret") -> DataFrame:
    return df.where(F.col(col).isNotNull() & ~F.isnan(col) & (F.abs(col) != float("inf")))


def compound(r: Column) -> Column:
    """Product of 1 + r of an aggregate; an empty one is 1."""
    return F.coalesce(F.product(1 + r), F.lit(1.0))


def cagr(r: Column, periods: float = 52) -> Column:
    total = compound(r)
    return F.when((F.count(r) > 0) & (total > 0), F.pow(total, periods / F.count(r)) - 1)


def sharpe(r: Column, periods: float = 52, riskless: float = 0.0) -> Column:
    excess = r - riskless / periods
    return F.try_divide(F.avg(excess), F.nullif(F.stddev_samp(excess), F.lit(0.0))) * periods**0.5


def sortino(r: Column, periods: float = 52, riskless: float = 0.0) -> Column:
    excess = r - riskless / periods
    down = F.sqrt(F.avg(F.pow(F.least(excess, F.lit(0.0)), 2)))
    return F.try_divide(F.avg(excess), F.nullif(down, F.lit(0.0))) * periods**0.5


def hit_share(r: Column) -> Column:
    return F.avg((r > 0).cast("double"))


def with_equity(df: DataFrame, col: str = "ret", by: list[str] | None = None) -> DataFrame:
    """``equity`` (from 1) and ``drawdown`` (from the highest equity so far) of each series."""
    w = Window.partitionBy(*(by or [])).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("equity", F.product(1 + F.coalesce(F.col(col), F.lit(0.0))).over(w))
    return out.withColumn("drawdown", F.try_divide(F.col("equity"), F.max("equity").over(w)) - 1)


def summary(df: DataFrame, *, periods: float = 52, riskless: float = 0.0, benchmark: str | None = None, least_rows: int = 12, by: list[str] | None = None) -> DataFrame:
    """n, total, cagr, vol, sharpe, sortino, max_drawdown, calmar, hit_rate and, given a benchmark, alpha and beta."""
    r = F.col("ret")
    data = with_equity(cleaned(df), by=by)
    out = [F.count(r).alias("n"), (compound(r) - 1).alias("total"), cagr(r, periods).alias("cagr"), (F.stddev_samp(r) * periods**0.5).alias("vol"), sharpe(r, periods, riskless).alias("sharpe"), sortino(r, periods, riskless).alias("sortino"), F.min("drawdown").alias("max_drawdown"), hit_share(r).alias("hit_rate")]
    if benchmark:
        b = F.col(benchmark)
        both = F.count(F.when(b.isNotNull(), r)) >= least_rows
        out += [F.when(both, F.regr_intercept(r, b) * periods).alias("alpha"), F.when(both, F.regr_slope(r, b)).alias("beta")]
    return data.groupBy(*(by or [])).agg(*out).withColumn("calmar", finite(F.try_divide("cagr", F.abs(F.nullif(F.col("max_drawdown"), F.lit(0.0))))))


def calendar_returns(df: DataFrame, unit: str = "MM", col: str = "ret") -> DataFrame:
    """(period, ret) compounded by month or year from the first to the last; periods without rows are 0."""
    got = cleaned(df, col).groupBy(F.trunc("date", unit).alias("p")).agg((compound(F.col(col)) - 1).alias("ret"))
    step = "interval 1 month" if unit == "MM" else "interval 1 year"
    span = got.agg(F.min("p").alias("a"), F.max("p").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b", F.expr(step))).alias("p"))
    last = F.last_day("p") if unit == "MM" else F.make_date(F.year("p"), F.lit(12), F.lit(31))
    return span.join(got, "p", "left").select(last.alias("period"), F.coalesce("ret", F.lit(0.0)).alias("ret"))


def month_table(df: DataFrame, col: str = "ret") -> DataFrame:
    """year × 1..12 with the year's compounded return."""
    r = cleaned(df, col).withColumns({"year": F.year("date"), "_m": F.month("date")})
    months = r.groupBy("year").pivot("_m", list(range(1, 13))).agg(F.product(1 + F.col(col)) - 1)
    return months.withColumnsRenamed({str(i): f"m{i:02d}" for i in range(1, 13)}).join(r.groupBy("year").agg((compound(F.col(col)) - 1).alias("total")), "year")


def periods_per_year(df: DataFrame) -> DataFrame:
    """252, 52, 12 or 4 by the median gap of the dates in days."""
    gap = F.datediff("date", F.lag("date").over(_series()))
    m = df.select("date").distinct().select(gap.alias("g")).agg(F.median("g").alias("m"))
    return m.select(F.when(F.col("m") <= 3, 252).when(F.col("m") <= 10, 52).when(F.col("m") <= 45, 12).otherwise(4).alias("periods"))


def annual_turnover(df: DataFrame, col: str = "turnover", periods: float = 52) -> DataFrame:
    return df.agg((F.avg(col) * 0.5 * periods).alias("annual_turnover"), F.avg(col).alias("avg_turnover"))
