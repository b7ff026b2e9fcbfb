"""As-of joins: the latest row of the right side that was known at the left side's time.

Both sides are stacked and one window carries the last right row forward: one exchange and one sort by
key, linear in the rows, whatever the gaps. A hot key is one time series and stays one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Beginning of the names of forward returns.
FORWARD = "fwd_ret_"


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row for each key: the last by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def asof_join(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, cols: list[str], *, tolerance_days: int | None = None, time_as: str | None = None, forward: bool = False, tie: str | None = None) -> DataFrame:
    """``left`` with ``cols`` of the last right row at or before its time (``forward``: the first at or after).

    Left rows without a key, a time or a match get nulls. ``tolerance_days`` bounds the distance, both ends
    included. Of right rows with equal key and time the one with the largest ``tie`` (or the largest
    values) is taken. ``time_as`` adds the matched time. Times are compared as timestamps.
    """
    pick = [F.col(c).alias(f"_v{i}") for i, c in enumerate(cols)]
    r = right.where(F.col(on).isNotNull() & F.col(right_time).isNotNull()).select(F.col(on).alias("_k"), F.col(right_time).cast("timestamp").alias("_t"), F.struct(F.col(right_time).alias("_rt"), *pick).alias("_r"), (F.col(tie) if tie else F.struct(*cols)).alias("_tie"))
    r = r.groupBy("_k", "_t").agg(F.max_by("_r", "_tie").alias("_r"))
    l = left.select(F.col(on).alias("_k"), F.col(left_time).cast("timestamp").alias("_t"), F.struct("*").alias("_l"))
    both = r.withColumn("_side", F.lit(0)).unionByName(l.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    if forward:
        w = Window.partitionBy("_k").orderBy(F.col("_t").desc(), "_side")
    else:
        w = Window.partitionBy("_k").orderBy("_t", "_side")
    found = F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    got = both.withColumn("_m", found).where("_side = 1")
    gap = F.abs(F.unix_micros("_t") - F.unix_micros(F.col("_m._rt").cast("timestamp")))
    ok = F.col("_k").isNotNull() & F.col("_t").isNotNull()
    if tolerance_days is not None:
        ok = ok & (gap <= tolerance_days * 86_400_000_000)
    names = [f"_l.`{c}`" for c in left.columns]
    added = [F.when(ok, F.col(f"_m._v{i}")).alias(c) for i, c in enumerate(cols)]
    if time_as:
        added.append(F.when(ok, F.col("_m._rt")).alias(time_as))
    return got.select(*names, *added)


def forward_returns(panel: DataFrame, prices: DataFrame, horizons: list[int], *, key: str = "ticker", date: str = "date", price: str = "adj_close", tolerance_days: int = 7, label=None) -> DataFrame:
    """``panel`` with ``fwd_ret_<label>`` for each horizon in weeks.

    The close is the last one on the shifted day or up to ``tolerance_days`` before it; without one the label is null. Panel and quotes
    are stacked and one window over the days of a key reads all horizons: one exchange and one sort, and no join back. Rows without a
    key or date, or without a positive price, have no label.
    """
    from tidepanel.functions.calendar import horizon_label

    label = label or horizon_label
    day = lambda c: F.unix_date(F.to_date(F.col(c)))
    rows = panel.select(F.struct(*[F.col(f"`{c}`") for c in panel.columns]).alias("_row"), F.col(key).alias("_key"), day(date).alias("_day"), F.lit(None).cast("struct<day:int,px:double>").alias("_quote"))
    quote = F.struct(day(date).alias("day"), F.col(price).cast("double").alias("px"))
    quotes = prices.where((F.col(price) > 0) & F.col(key).isNotNull()).select(F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.col(key).alias("_key"), day(date).alias("_day"), quote.alias("_quote"))
    days = Window.partitionBy("_key").orderBy("_day")
    seen = {f"_q{h}": F.last("_quote", ignorenulls=True).over(days.rangeBetween(7 * h - tolerance_days, 7 * h)) for h in horizons}
    out = rows.unionByName(quotes).withColumns(seen).where("_row IS NOT NULL")
    own = F.col("_row").getField(price)
    # a price that is no later than the start says nothing about the future
    labels = [F.when((own > 0) & (F.col(f"_q{h}.day") > F.col("_day")), F.try_divide(F.col(f"_q{h}.px"), own) - 1).alias(f"{FORWARD}{label(h)}") for h in horizons]
    return out.select(*[F.col("_row").getField(c).alias(c) for c in panel.columns], *labels)


def membership(changes: DataFrame, current: DataFrame, dates: DataFrame) -> DataFrame:
    """(date, symbol) members at each date, by undoing the changes made after it.

    ``changes``: (symbol, date, op) with op ``added`` or ``removed``; ``current``: today's symbols. The first
    change after the date tells: added later means out before, removed later means in. Of changes on
    one date the removal counts last. One pass of a window over changes and dates by symbol, so the
    change log is never multiplied by the dates it comes after.
    """
    symbols = changes.select("symbol").union(current.select("symbol")).where("symbol is not null and symbol <> ''").distinct()
    grid = symbols.join(F.broadcast(dates.select("date")), how="cross").select("symbol", "date")
    order = F.when(F.col("op") == "removed", 0).otherwise(1)
    log = changes.where("symbol is not null and date is not null").groupBy("symbol", "date").agg(F.min_by("op", order).alias("op"))
    stacked = grid.withColumns({"op": F.lit(None).cast("string"), "_side": F.lit(1)}).unionByName(log.withColumn("_side", F.lit(0)))
    # strictly later changes: on one date the grid row stands behind the change
    w = Window.partitionBy("symbol").orderBy("date", "_side").rowsBetween(1, Window.unboundedFollowing)
    after = stacked.withColumn("_next", F.first("op", ignorenulls=True).over(w)).where("_side = 1")
    now = current.select("symbol").distinct().withColumn("_now", F.lit(True))
    inside = F.when(F.col("_next") == "removed", True).when(F.col("_next") == "added", False).otherwise(F.coalesce("_now", F.lit(False)))
    return after.join(now, "symbol", "left").where(inside).select("date", "symbol")


def key_flags(df: DataFrame, keys: DataFrame, on: list[str], name: str) -> DataFrame:
    """``df`` with a flag for the rows whose key is in ``keys``."""
    marked = keys.select(*on).distinct().withColumn("_hit", F.lit(True))
    return df.join(marked, on, "left").withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_hit")


def with_profile(df: DataFrame, profile: DataFrame, on: str = "ticker", name: str = "name", fallback: str = "company") -> DataFrame:
    """Static attributes by ticker; an empty name falls back to the reported one."""
    joined = df.join(profile.dropDuplicates([on]), on, "left")
    return joined.withColumn(name, F.coalesce(F.nullif(F.trim(F.col(name)), F.lit("")), F.col(fallback)))


def column_or_null(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None)
