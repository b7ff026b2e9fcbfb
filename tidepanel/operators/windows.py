"""Row windows of one entity in time order. Look-backs count rows, not days.

Functions take and give Column expressions over the panel's key (ticker, date); an input that is itself a
window result must be a column of the frame first, as windows do not nest. All share one window
specification, so a projection of many of them costs one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.nulls import divide, finite

KEY, TIME = "ticker", "date"


def ordered() -> Window:
    return Window.partitionBy(KEY).orderBy(TIME)


def trailing(rows: int) -> Window:
    return ordered().rowsBetween(-(rows - 1), 0)


def enough(x: Column, rows: int, least: int, value: Column) -> Column:
    """``value`` where the last ``rows`` rows hold ``least`` or more values of ``x``."""
    return F.when(F.count(x).over(trailing(rows)) >= least, value)


def padded(x: Column) -> Column:
    """The last known value: nulls are filled forward."""
    return F.last(x, ignorenulls=True).over(ordered().rowsBetween(Window.unboundedPreceding, 0))


def change(x: Column, rows: int = 1) -> Column:
    """x / x[rows before] - 1. Give a padded column to carry values over gaps."""
    return finite(divide(x, F.lag(x, rows).over(ordered())) - 1)


def with_padded(df: DataFrame, col: str, name: str = "_pad", *, fill: bool = True) -> DataFrame:
    return df.withColumn(name, padded(F.col(col)) if fill else F.col(col))


def skip_change(x: Column, rows: int, skip: int = 1) -> Column:
    """Change over ``rows`` rows that ended ``skip`` rows ago; gaps are not filled."""
    return finite(divide(F.lag(x, skip).over(ordered()), F.lag(x, rows + skip).over(ordered())) - 1)


def rolling_mean(x: Column, rows: int, least: int | None = None) -> Column:
    return enough(x, rows, max(2, rows // 4) if least is None else least, F.avg(x).over(trailing(rows)))


def rolling_std(x: Column, rows: int, least: int | None = None) -> Column:
    """Sample deviation, from half a window of values on."""
    return enough(x, rows, max(2, rows // 2) if least is None else least, F.stddev_samp(x).over(trailing(rows)))


def drawdown_level(x: Column, rows: int = 52, least: int = 13) -> Column:
    """Distance of the current value from the window's highest, not the worst in it."""
    return enough(x, rows, least, divide(x, F.max(x).over(trailing(rows))) - 1)


def rolling_beta(x: Column, market: Column, rows: int = 52, least: int = 26) -> Column:
    """Covariance of the pairs over the variance of all the market's values."""
    pair = F.when(x.isNotNull() & market.isNotNull(), F.lit(1))
    cov = F.when(F.count(pair).over(trailing(rows)) >= least, F.covar_samp(x, market).over(trailing(rows)))
    var = enough(market, rows, least, F.var_samp(market).over(trailing(rows)))
    return finite(divide(cov, var))


def rolling_z(x: Column, rows: int, least: int | None = None) -> Column:
    """(x - mean) / population deviation; NULL where nothing varies."""
    if rows <= 1:
        raise ValueError("a window of one row has no deviation")
    w = trailing(rows)
    sd = F.stddev_pop(x).over(w)
    return enough(x, rows, rows if least is None else least, finite(F.when(sd > 0, divide(x - F.avg(x).over(w), sd))))


def rolling_percentile(x: Column, rows: int = 52, least: int = 12) -> Column:
    """Share of the window at or below the current value, ties by half: its average-tie percentile rank."""
    seen = F.collect_list(x).over(trailing(rows))
    below, same = F.size(F.filter(seen, lambda v: v < x)), F.size(F.filter(seen, lambda v: v == x))
    return F.when(x.isNotNull() & (F.size(seen) >= least), (below + (same + 1) / 2) / F.size(seen))


def rises(diff: Column, rows: int = 5, least: int = 3) -> Column:
    """How many of the last differences are above 0."""
    up = F.when(diff.isNotNull(), (diff > 0).cast("double"))
    return enough(diff, rows, least, F.sum(up).over(trailing(rows)))


def difference(x: Column, rows: int = 1) -> Column:
    return x - F.lag(x, rows).over(ordered())


def row_growth(x: Column, rows: int = 4) -> Column:
    """(x - x[rows before]) / |x[rows before]|: by panel rows, whatever their distance in time."""
    before = F.lag(x, rows).over(ordered())
    return F.when(F.abs(before) > 1e-12, divide(x - before, F.abs(before)))


def running_product(r: Column) -> Column:
    """Product of 1 + r so far, nulls as 0."""
    return F.product(1 + F.coalesce(r, F.lit(0.0))).over(ordered().rowsBetween(Window.unboundedPreceding, 0))


def drawdown(equity: Column) -> Column:
    return divide(equity, F.max(equity).over(ordered().rowsBetween(Window.unboundedPreceding, 0))) - 1


def suspicious(df: DataFrame, col: str, most: float = 1.5) -> DataFrame:
    """Rows whose one-row change, gaps not filled, is larger than ``most`` either way, with a reason."""
    moved = df.withColumn("change", divide(F.col(col), F.lag(col).over(ordered())) - 1)
    return moved.where(F.abs("change") > most).select(KEY, TIME, "change", F.concat(F.lit("|change| > "), F.lit(str(most))).alias("reason"))


def month_snapshot(df: DataFrame) -> DataFrame:
    """Rows on the last date that occurs in their month, over all entities."""
    last = F.max(TIME).over(Window.partitionBy(F.trunc(TIME, "MM")))
    return df.withColumn("_last", last).where(F.col(TIME) == F.col("_last")).drop("_last")


def forward_change(x: Column, rows: int) -> Column:
    return divide(F.lead(x, rows).over(ordered()), x) - 1
