"""Queries over summaries, selections and trade results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import aggregates as agg
from tidepanel.operators import selection, xsection
from tidepanel.plans.panel_queries import PCT
from tidepanel.plans.report_queries import BACK, LS, _book
from tidepanel.plans.tables import FILINGS, PANEL, filings, panel, registrar
from tidepanel.portfolio import backtest as bt
from tidepanel.portfolio import metrics

QUERIES, SQL = {}, {}
query = registrar(QUERIES, SQL)


def _rows_sql(source: str, parts: dict[str, str]) -> str:
    """(metric, value) rows of aggregates over a source."""
    return " UNION ALL ".join(f"SELECT '{name}' AS metric, round(({x})::DOUBLE, 4) AS value FROM {source}" for name, x in parts.items())


def _four(df, *cols):
    return df.withColumns({c: F.round(c, 4) for c in cols})


@query(f"WITH {FILINGS} " + _rows_sql("filings", {"n": "count(*)", "with_cap": "avg((mkt_cap IS NOT NULL)::INT)", **{f"p{p}": f"quantile_cont(mkt_cap, {p / 100})" for p in (10, 25, 50, 75, 90)}, "mean": "avg(mkt_cap)", "sum": "sum(mkt_cap)"}), dates="")
def universe_summary(spark, d):
    return _four(agg.universe_summary(filings(spark, d)), "value")


@query(f"""WITH {PANEL}, counted AS (SELECT sector, count(*) AS c FROM panel WHERE sector IS NOT NULL GROUP BY sector), ranked AS (SELECT *, row_number() OVER (ORDER BY c DESC, sector) AS r FROM counted)
SELECT CASE WHEN r <= 5 THEN sector ELSE 'other' END AS sector, sum(c)::BIGINT AS count FROM ranked GROUP BY 1""", dates="")
def top_sectors(spark, d):
    return agg.top_groups(panel(spark, d), "sector", 5)


@query(f"""WITH {PANEL}, raw AS ({_rows_sql("panel", {"rows": "count(*)", "tickers": "count(DISTINCT ticker)", "volume": "sum(volume)"})}),
clean AS ({_rows_sql("(SELECT * FROM panel WHERE volume >= 50)", {"rows": "count(*)", "tickers": "count(DISTINCT ticker)", "volume": "sum(volume)"})})
SELECT metric, r.value AS raw, c.value AS clean, round(c.value - r.value, 4) AS delta FROM raw r JOIN clean c USING (metric)""", dates="")
def raw_vs_clean(spark, d):
    p = panel(spark, d)
    counters = {"rows": F.count(F.lit(1)), "tickers": F.countDistinct("ticker"), "volume": F.sum("volume")}
    return _four(agg.raw_vs_clean(p, p.where("volume >= 50"), counters), "raw", "clean", "delta")


@query(f"""WITH {PANEL}, scores AS (SELECT date, ticker, 'price' AS model, adj_close AS score FROM panel UNION ALL SELECT date, ticker, 'short', CASE WHEN short_pct > 5 THEN short_pct END FROM panel),
per AS (SELECT date, model, count(DISTINCT ticker) AS n FROM scores WHERE score IS NOT NULL GROUP BY ALL), total AS (SELECT count(DISTINCT ticker) AS t FROM scores)
SELECT max(date) AS date FROM (SELECT date FROM per, total WHERE n >= 0.3 * t GROUP BY date HAVING count(*) = 2)""")
def latest_covered_date(spark, d):
    p = panel(spark, d)
    scores = p.select("date", "ticker", F.lit("price").alias("model"), F.col("adj_close").alias("score")).unionByName(
        p.select("date", "ticker", F.lit("short").alias("model"), F.when(F.col("short_pct") > 5, F.col("short_pct")).alias("score"))
    )
    return agg.latest_covered_date(scores, 0.3)


@query(f"""WITH {PANEL} SELECT ticker, count(*) AS n, round(sum(short_pct - 50), 2) AS total, round(avg(short_pct - 50), 4) AS mean, round(max(short_pct - 50), 4) AS best, round(min(short_pct - 50), 4) AS worst,
round(avg((short_pct > 50)::INT), 4) AS hit, min(date) AS first, max(date) AS last FROM panel GROUP BY ticker""", dates="first last")
def ticker_rollup(spark, d):
    got = agg.ticker_rollup(panel(spark, d).withColumn("pnl", F.col("short_pct") - 50))
    return _four(got, "mean", "best", "worst", "hit").withColumn("total", F.round("total", 2))


@query(f"WITH {PANEL} " + _rows_sql("panel", {c: f"avg(abs({c}))" for c in ("volume", "short_pct", "short_positions")}), dates="")
def mean_abs(spark, d):
    return _four(agg.mean_abs(panel(spark, d), ["volume", "short_pct", "short_positions"]), "value")


@query(f"""WITH {PANEL}, r AS (SELECT date, ticker, round(short_pct / 100, 6) AS prob, row_number() OVER (PARTITION BY date ORDER BY short_pct DESC, ticker) AS r FROM panel WHERE short_pct IS NOT NULL)
SELECT date, ticker, prob FROM r WHERE r = 1 OR (r <= 15 AND prob >= 0.6)""")
def floor_top_k(spark, d):
    scored = panel(spark, d).withColumn("prob", F.round(F.col("short_pct") / 100, 6))
    return selection.floor_top_k(scored, 0.6).select("date", "ticker", "prob")


@query(f"WITH {PANEL}, r AS (SELECT date, ticker, {PCT.format(x='volume')} AS a, {PCT.format(x='short_pct')} AS b FROM panel) SELECT date, ticker, round((a + b) / 2, 6) AS consensus FROM r")
def consensus_rank(spark, d):
    p = panel(spark, d)
    return p.select("date", "ticker", xsection.consensus(p, ["volume", "short_pct"]).alias("consensus"))


@query(f"""WITH {PANEL}, {LS}, px AS (SELECT ticker, date AS d, adj_close FROM panel WHERE adj_close > 0), held AS (SELECT date, ticker, weight::DOUBLE AS weight, date + 35 AS exit_date FROM book WHERE weight <> 0),
entered AS (SELECT t.*, CASE WHEN date_diff('day', p.d, t.date) <= 7 THEN p.adj_close END AS entry_px FROM held t ASOF LEFT JOIN px p ON p.ticker = t.ticker AND t.date >= p.d),
done AS (SELECT e.*, CASE WHEN date_diff('day', p.d, e.exit_date) <= 14 THEN p.adj_close END AS exit_px FROM entered e ASOF LEFT JOIN px p ON p.ticker = e.ticker AND e.exit_date >= p.d)
SELECT date, ticker, round(exit_px / entry_px - 1, 5) AS asset_ret, round(weight * (exit_px / entry_px - 1) - abs(weight) * (60 / 1e4 + 0.015::DOUBLE * 35 / 365), 5) AS pnl FROM done""")
def trade_pnl(spark, d):
    trades = _book(spark, d).where("weight <> 0").select("date", "ticker", "weight")
    got = bt.trade_pnl(trades, panel(spark, d)).select("date", "ticker", "asset_ret", "pnl")
    return got.withColumns({c: F.round(c, 5) for c in ("asset_ret", "pnl")})


@query(f"WITH {PANEL}, {BACK} SELECT count(ret_net) AS n, round(avg(turnover), 6) AS avg_turnover, round(sum(commission + slippage + borrow), 4) AS cost_sum, round(avg(n_positions), 6) AS avg_positions, round(avg(gross_exposure), 6) AS avg_gross FROM series", dates="")
def backtest_summary(spark, d):
    got = bt.backtest_summary(bt.backtest(_book(spark, d), panel(spark, d)))
    return got.select("n", "avg_turnover", F.round("cost_sum", 4).alias("cost_sum"), "avg_positions", "avg_gross")


@query(f"""WITH {PANEL}, {BACK}, gaps AS (SELECT date_diff('day', lag(date) OVER (ORDER BY date), date) AS g FROM (SELECT DISTINCT date FROM series)), m AS (SELECT median(g) AS m FROM gaps)
SELECT (SELECT CASE WHEN m <= 3 THEN 252 WHEN m <= 10 THEN 52 WHEN m <= 45 THEN 12 ELSE 4 END FROM m) AS periods, round(avg(turnover) * 26, 6) AS annual_turnover, round(avg(turnover), 6) AS avg_turnover FROM series""", dates="")
def annual_turnover(spark, d):
    series = bt.backtest(_book(spark, d), panel(spark, d))
    return metrics.periods_per_year(series).join(metrics.annual_turnover(series), how="cross")
