"""Backtest of target books on a grid of rebalance dates, in long form."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators.asof import asof_join, latest
from tidepanel.portfolio.metrics import summary


@dataclass(frozen=True)
class Costs:
    """Basis points a trade, yearly borrow rate, slippage in basis points, periods a year."""

    commission_bps: float = 25.0
    borrow_rate: float = 0.015
    slippage_bps: float = 5.0
    periods: int = 52
    borrow_longs: bool = False


def merged_weights(book: DataFrame) -> DataFrame:
    return book.groupBy("date", "ticker").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"))


def grid_weights(book: DataFrame) -> DataFrame:
    """Weights of every held ticker on every rebalance date, 0 where it is not in the book, with the trade.

    The grid is (rebalance dates) × (tickers ever held): what a wide matrix would hold.
    """
    weights = merged_weights(book)
    dates, tickers = weights.select("date").distinct(), weights.select("ticker").distinct()
    grid = tickers.join(F.broadcast(dates), how="cross")
    full = grid.join(weights, ["date", "ticker"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    return full.withColumn("trade", F.col("weight") - F.lag("weight", 1, 0.0).over(Window.partitionBy("ticker").orderBy("date")))


def trade_log(book: DataFrame) -> DataFrame:
    """(date, ticker, weight, trade) where the weight changes; the first book is bought from nothing."""
    return grid_weights(book).where(F.abs("trade") > 1e-12)


def period_returns(prices: DataFrame, dates: DataFrame, sequence: str = "adj_close") -> DataFrame:
    """(date, ticker, ret) from each date to the next: close to close, one missing close filled.

    Of several closes of a date the last by ``sequence`` counts: a column that numbers the rows as they
    came. Without one the highest close does, so that the result does not depend on the order of rows.
    """
    closes = latest(prices.where("adj_close is not null"), ["ticker", "date"], sequence)
    grid = closes.select("ticker").distinct().join(F.broadcast(dates.select("date").distinct()), how="cross")
    w = Window.partitionBy("ticker").orderBy("date")
    on = grid.join(closes.select("ticker", "date", "adj_close"), ["ticker", "date"], "left")
    # changes carry the last known close over longer gaps, where they are 0
    known = F.last("adj_close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    filled = on.withColumn("px", known)
    return filled.select("date", "ticker", (F.try_divide(F.lead("px").over(w), F.col("px")) - 1).alias("ret"))


def backtest(book: DataFrame, prices: DataFrame, costs: Costs = Costs(), sequence: str = "adj_close") -> DataFrame:
    """Returns by rebalance date: each book is held to the next date; the last date only closes.

    ret_gross, turnover, commission, slippage, borrow, cost_total, ret_net, n_positions, gross and net exposure.
    """
    weights = grid_weights(book)
    moves = period_returns(prices, weights.select("date").distinct(), sequence)
    held = weights.join(moves, ["date", "ticker"], "left")
    w = F.col("weight")
    short = F.when(w < 0, -w).otherwise(w if costs.borrow_longs else F.lit(0.0))
    traded = F.sum(F.abs("trade"))
    out = held.groupBy("date").agg(
        F.sum(w * F.coalesce("ret", F.lit(0.0))).alias("ret_gross"), (traded / 2).alias("turnover"),
        (traded * costs.commission_bps / 1e4).alias("commission"), (traded * costs.slippage_bps / 1e4).alias("slippage"),
        (F.sum(short) * costs.borrow_rate / costs.periods).alias("borrow"), F.count_if(F.abs(w) > 1e-12).alias("n_positions"),
        F.sum(F.abs(w)).alias("gross_exposure"), F.sum(w).alias("net_exposure"),
    )
    out = out.withColumn("cost_total", F.col("commission") + F.col("slippage") + F.col("borrow")).withColumn("ret_net", F.col("ret_gross") - F.col("cost_total"))
    # one row a rebalance date: a series, small enough for one window
    return out.withColumn("_last", F.max("date").over(Window.partitionBy())).where("date < _last").drop("_last")


def backtest_summary(returns: DataFrame, costs: Costs = Costs(), benchmark: str | None = None) -> DataFrame:
    """The statistics of the net series with turnover, cost and gross figures."""
    extra = returns.agg(F.avg("turnover").alias("avg_turnover"), F.sum("cost_total").alias("cost_sum"), F.avg("n_positions").alias("avg_positions"), F.avg("gross_exposure").alias("avg_gross"))
    return summary(returns.withColumn("ret", F.col("ret_net")), periods=costs.periods, benchmark=benchmark, least_rows=3).join(extra, how="cross")


def trade_pnl(trades: DataFrame, prices: DataFrame, costs: Costs = Costs(), *, hold_days: int = 35, entry_days: int = 7, exit_days: int = 14) -> DataFrame:
    """Each trade with its entry and exit price as of the dates and its result after costs."""
    q = prices.where("adj_close > 0").select("ticker", F.col("date").alias("_d"), F.col("adj_close").alias("_px"))
    t = asof_join(trades, q, "ticker", "date", "_d", ["_px"], tolerance_days=entry_days).withColumnRenamed("_px", "entry_px").withColumn("exit_date", F.date_add("date", hold_days))
    t = asof_join(t, q, "ticker", "exit_date", "_d", ["_px"], tolerance_days=exit_days).withColumnRenamed("_px", "exit_px")
    fee = (2 * costs.commission_bps + 2 * costs.slippage_bps) / 1e4 + costs.borrow_rate * hold_days / 365
    move = F.try_divide("exit_px", "entry_px") - 1
    return t.withColumns({"asset_ret": move, "pnl": F.col("weight") * move - F.abs("weight") * fee})


def hard_stop(prices: DataFrame, horizon: int = 4, stop: float = 0.1) -> DataFrame:
    """Short entered at each close: out at the stop on the first close at or over it, else at the horizon.

    Entries with fewer than ``horizon`` later closes have no result.
    """
    w = Window.partitionBy("ticker").orderBy("date")
    ahead = F.collect_list(F.struct("date", "adj_close")).over(w.rowsBetween(1, horizon))
    rows = prices.where("adj_close is not null").withColumn("_a", ahead).where(F.size("_a") == horizon)
    level = F.col("adj_close") * (1 + stop)
    rows = rows.withColumn("_hit", F.get(F.filter("_a", lambda x: x["adj_close"] >= level), F.lit(0)))
    exit_px = F.when(F.col("_hit").isNotNull(), level).otherwise(F.element_at("_a", -1)["adj_close"])
    exit_date = F.coalesce(F.col("_hit.date"), F.element_at("_a", -1)["date"])
    return rows.select("ticker", F.col("date").alias("entry_date"), F.col("adj_close").alias("entry_px"), exit_date.alias("exit_date"), exit_px.alias("exit_px"), F.col("_hit").isNotNull().alias("stopped"), (1 - F.try_divide(exit_px, F.col("adj_close"))).alias("pnl"))


def in_reach(candidates: DataFrame, k: int) -> DataFrame:
    """The candidates that can be among the best ``k`` free ones of their date, whatever was chosen before.

    Of the candidates of an earlier date whose exit lies behind this one at most ``k`` were chosen; their sum
    over the earlier dates bounds the tickers that are open. So of the best (bound + k) rows at least ``k``
    are free, and no row behind them can be chosen.
    """
    spans = candidates.groupBy("entry_date", "exit_date").agg(F.count(F.lit(1)).alias("_n"))
    days = candidates.select(F.col("entry_date").alias("_day")).distinct()
    # pairs of dates, whatever the number of tickers
    pairs = spans.join(F.broadcast(days), (F.col("entry_date") < F.col("_day")) & (F.col("_day") < F.col("exit_date")))
    held = pairs.groupBy("entry_date", "_day").agg(F.least(F.sum("_n"), F.lit(k)).alias("_n"))
    bound = held.groupBy(F.col("_day").alias("entry_date")).agg(F.sum("_n").alias("_open"))
    score = F.col("score")
    unknown = score.isNull() | F.isnan(score.cast("double"))
    rank = F.row_number().over(Window.partitionBy("entry_date").orderBy(unknown, F.desc(score), "ticker"))
    rows = candidates.withColumn("_r", rank).join(F.broadcast(bound), "entry_date", "left")
    return rows.where(F.col("_r") <= F.coalesce("_open", F.lit(0)) + k).select(*candidates.columns)


def no_reentry(candidates: DataFrame, k: int = 15) -> DataFrame:
    """The best ``k`` of each week among tickers with no open trade.

    ``candidates``: entry_date, exit_date, ticker, score, pnl; one row a date and ticker. Each choice blocks
    its ticker up to its exit, so weeks depend on the ones before: one ordered pass over the candidates
    that ``in_reach`` leaves, which are all that any choice can come from.
    """
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        blocked: dict[str, object] = {}
        out = []
        for day, week in rows.sort_values(["entry_date", "score", "ticker"], ascending=[True, False, True]).groupby("entry_date", sort=True):
            free = week[[blocked.get(t) is None or blocked[t] <= day for t in week["ticker"]]].head(k)
            blocked.update(zip(free["ticker"], free["exit_date"], strict=True))
            out.append(free)
        return pd.concat(out) if out else rows.head(0)

    cols = in_reach(candidates.select("entry_date", "exit_date", "ticker", "score", "pnl"), k)
    return cols.groupBy(F.lit(1).alias("_one")).applyInPandas(lambda g: run(g[["entry_date", "exit_date", "ticker", "score", "pnl"]]), cols.schema)


def capital_timeline(trades: DataFrame) -> DataFrame:
    """(date, opened, closed, open_trades, pnl, cum_pnl): running sums over the dates on which anything happens."""
    enter = trades.groupBy(F.col("entry_date").alias("date")).agg(F.count(F.lit(1)).alias("opened"))
    leave = trades.groupBy(F.col("exit_date").alias("date")).agg(F.count(F.lit(1)).alias("closed"), F.sum("pnl").alias("pnl"))
    both = enter.join(leave, "date", "full").fillna(0, ["opened", "closed"]).fillna(0.0, ["pnl"])
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumns({"open_trades": F.sum(F.col("opened") - F.col("closed")).over(w), "cum_pnl": F.sum("pnl").over(w)})
