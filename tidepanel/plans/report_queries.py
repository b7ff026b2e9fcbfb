"""Queries over books, backtests, return series, summaries and models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.models import folds, scores, splits
from tidepanel.operators import aggregates as agg
from tidepanel.operators import selection, wide, windows, xsection
from tidepanel.panel import assemble as pit
from tidepanel.panel import universe
from tidepanel.plans.panel_queries import CORR, FUND, FWD, LS, W, _fund, _fwd
from tidepanel.plans.tables import PANEL, daily, filings, panel, read, registrar
from tidepanel.portfolio import backtest as bt
from tidepanel.portfolio import metrics
from tidepanel.sources.shared import stored

QUERIES, SQL = {}, {}
query = registrar(QUERIES, SQL)


def _book(spark, d):
    return selection.long_short(panel(spark, d), 10, "adj_close")


GRID = f"""{LS}, days AS (SELECT DISTINCT date FROM book), names AS (SELECT DISTINCT ticker FROM book),
grid AS (SELECT d.date, n.ticker, coalesce(b.weight, 0.0)::DOUBLE AS weight FROM days d CROSS JOIN names n LEFT JOIN book b ON b.date = d.date AND b.ticker = n.ticker),
moves AS (SELECT *, weight - coalesce(lag(weight) OVER ({W}), 0.0) AS trade FROM grid)"""
BACK = f"""{GRID}, closes AS (SELECT n.ticker, d.date, p.adj_close FROM (SELECT DISTINCT ticker FROM panel) n CROSS JOIN days d LEFT JOIN panel p ON p.ticker = n.ticker AND p.date = d.date),
known AS (SELECT *, last_value(adj_close IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS px FROM closes),
steps AS (SELECT date, ticker, lead(px) OVER ({W}) / px - 1 AS ret FROM known),
bt AS (SELECT m.date, sum(weight * coalesce(ret, 0.0)) AS ret_gross, sum(abs(trade)) / 2 AS turnover, sum(abs(trade)) * 25 / 1e4 AS commission, sum(abs(trade)) * 5 / 1e4 AS slippage,
  sum(greatest(-weight, 0)) * 0.015::DOUBLE / 52 AS borrow, count(*) FILTER (abs(weight) > 1e-12) AS n_positions, sum(abs(weight)) AS gross_exposure, sum(weight) AS net_exposure
  FROM moves m LEFT JOIN steps s ON s.date = m.date AND s.ticker = m.ticker GROUP BY m.date),
series AS (SELECT *, ret_gross - commission - slippage - borrow AS ret_net FROM bt WHERE date < (SELECT max(date) FROM bt))"""


def _damped(spark, d):
    """The net series a thousandth in size: the derived prices jump, and their products would overflow."""
    return bt.backtest(_book(spark, d), panel(spark, d)).withColumn("ret", F.col("ret_net") / 1000)


@query(f"WITH {PANEL}, {GRID} SELECT date, ticker, round(weight, 6) AS weight, round(trade, 6) AS trade FROM moves WHERE abs(trade) > 1e-12")
def trade_log(spark, d):
    return bt.trade_log(_book(spark, d)).select("date", "ticker", "weight", "trade")


@query(f"WITH {PANEL}, {BACK} SELECT date, round(ret_gross, 6) AS ret_gross, round(turnover, 6) AS turnover, round(commission, 6) AS commission, round(slippage, 6) AS slippage, round(borrow, 6) AS borrow, round(commission + slippage + borrow, 6) AS cost_total, round(ret_net, 6) AS ret_net, n_positions, round(gross_exposure, 6) AS gross_exposure, round(net_exposure + 1e-9, 6) AS net_exposure FROM series")
def backtest_weekly(spark, d):
    out = bt.backtest(_book(spark, d), panel(spark, d))
    return out.withColumn("net_exposure", F.col("net_exposure") + 1e-9)


@query(f"""WITH {PANEL}, {BACK}, eq AS (SELECT date, ret_net AS r, product(1 + ret_net) OVER (ORDER BY date) AS e FROM series), dd AS (SELECT *, e / max(e) OVER (ORDER BY date) - 1 AS dd FROM eq)
SELECT count(r) AS n, round(avg(r) / stddev_samp(r) * sqrt(52), 6) AS sharpe, round(avg(r) / nullif(sqrt(avg(least(r, 0.0) ** 2)), 0) * sqrt(52), 6) AS sortino, round(stddev_samp(r) * sqrt(52), 6) AS vol, round(min(dd), 6) AS max_drawdown, round(avg((r > 0)::INT), 6) AS hit_rate FROM dd""", dates="")
def return_summary(spark, d):
    series = bt.backtest(_book(spark, d), panel(spark, d)).withColumn("ret", F.col("ret_net"))
    return metrics.summary(series).select("n", "sharpe", "sortino", "vol", "max_drawdown", "hit_rate")


@query(f"""WITH {PANEL}, {BACK}, m AS (SELECT date_trunc('month', date)::DATE AS p, product(1 + ret_net / 1000) - 1 AS r FROM series GROUP BY 1), span AS (SELECT unnest(generate_series((SELECT min(p) FROM m), (SELECT max(p) FROM m), INTERVAL 1 MONTH))::DATE AS p)
SELECT last_day(s.p) AS period, round(coalesce(m.r, 0.0), 6) AS ret FROM span s LEFT JOIN m ON m.p = s.p""", dates="period")
def monthly_returns(spark, d):
    return metrics.calendar_returns(_damped(spark, d), "MM")


@query(f"WITH {PANEL}, {BACK} SELECT year(date)::INT AS year, {', '.join(f'round(product(1 + ret_net / 1000) FILTER (month(date) = {m}) - 1, 6) AS m{m:02d}' for m in range(1, 13))}, round(product(1 + ret_net / 1000) - 1, 6) AS total FROM series GROUP BY 1", dates="")
def month_table(spark, d):
    return metrics.month_table(_damped(spark, d))


@query(f"WITH {PANEL}, {BACK}, mk AS (SELECT date, avg(adj_close) AS level FROM panel GROUP BY date), b AS (SELECT date, lead(level) OVER (ORDER BY date) / level - 1 AS bench FROM mk) SELECT round(regr_slope(ret_net, bench), 6) AS beta, round(regr_intercept(ret_net, bench) * 52, 6) AS alpha FROM series s JOIN b ON b.date = s.date WHERE bench IS NOT NULL", dates="")
def capm(spark, d):
    from pyspark.sql import Window

    level = panel(spark, d).groupBy("date").agg(F.avg("adj_close").alias("level"))
    bench = level.select("date", (F.lead("level").over(Window.orderBy("date")) / F.col("level") - 1).alias("bench"))
    series = bt.backtest(_book(spark, d), panel(spark, d)).withColumn("ret", F.col("ret_net")).join(bench, "date").where("bench is not null")
    return metrics.summary(series, benchmark="bench").select("beta", "alpha")


@query(f"""WITH {PANEL}, a AS (SELECT ticker, date, adj_close, list(adj_close) OVER w AS px, list(date) OVER w AS dt FROM panel WINDOW w AS ({W} ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)),
b AS (SELECT *, list_position(list_transform(px, lambda x: x >= adj_close * 1.1::DOUBLE), true) AS hit FROM a WHERE len(px) = 4)
SELECT ticker, date AS entry_date, round(adj_close, 6) AS entry_px, CASE WHEN hit > 0 THEN dt[hit] ELSE dt[4] END AS exit_date, round(CASE WHEN hit > 0 THEN adj_close * 1.1::DOUBLE ELSE px[4] END + 2e-8, 6) AS exit_px, coalesce(hit > 0, false) AS stopped, round(1 - CASE WHEN hit > 0 THEN adj_close * 1.1::DOUBLE ELSE px[4] END / adj_close, 6) AS pnl FROM b""", dates="entry_date exit_date")
def hard_stop_trades(spark, d):
    return bt.hard_stop(panel(spark, d), 4, 0.1).withColumn("exit_px", F.col("exit_px") + 2e-8)


def _candidates(spark, d):
    t = bt.hard_stop(panel(spark, d), 4, 0.1)
    s = panel(spark, d).select("ticker", F.col("date").alias("entry_date"), F.col("short_pct").alias("score"))
    return t.join(s, ["ticker", "entry_date"]).where(F.col("score").isNotNull())


@query()
def no_reentry_trades(spark, d):
    return bt.no_reentry(_candidates(spark, d), 15)


@query()
def capital_timeline(spark, d):
    return bt.capital_timeline(bt.no_reentry(_candidates(spark, d), 15))


@query(f"WITH {PANEL} SELECT ticker, mode(company) AS company, min(date) AS first_seen, max(date) AS last_seen, count(*) AS n_reports FROM panel GROUP BY ticker", dates="first_seen last_seen")
def ticker_presence(spark, d):
    return agg.presence(panel(spark, d))


@query(f"""WITH {PANEL}, s AS (SELECT count(*)::DOUBLE AS "rows", count(DISTINCT date)::DOUBLE AS dates, count(DISTINCT ticker)::DOUBLE AS tickers, median(adj_close) AS median_adj_close, median(short_pct) AS median_short_pct, avg((adj_close IS NOT NULL)::INT) AS share_adj_close, avg((short_pct IS NOT NULL)::INT) AS share_short_pct FROM panel)
SELECT metric, round(value + 1e-9, 5) AS value FROM (UNPIVOT s ON COLUMNS(*) INTO NAME metric VALUE value)""", dates="")
def panel_summary(spark, d):
    return agg.panel_summary(panel(spark, d), ["adj_close", "short_pct"]).withColumn("value", F.round(F.col("value") + 1e-9, 5))


@query(f"WITH {PANEL} SELECT year(date)::INT AS year, count(*) AS rows, count(DISTINCT ticker) AS tickers, count(DISTINCT date) AS dates FROM panel GROUP BY 1", dates="")
def coverage_by_year(spark, d):
    return agg.rows_per_year(panel(spark, d))


@query(f"WITH {PANEL}, {FWD} SELECT date, count(*) AS rows, count(fwd) AS labels, round(count(fwd) / count(*), 6) AS share FROM fw GROUP BY date")
def label_coverage(spark, d):
    return agg.coverage_by_date(_fwd(spark, d), "fwd")


@query(f"WITH {PANEL}, e AS (SELECT 0.0::DOUBLE AS lo, greatest(quantile_cont(short_pct, 0.995), 1.0) AS hi FROM panel), x AS (SELECT least(floor((short_pct - lo) / (hi - lo) * 40), 39)::INT AS bin FROM panel, e WHERE short_pct BETWEEN lo AND hi) SELECT bin, count(*) AS count FROM x GROUP BY bin", dates="")
def short_interest_histogram(spark, d):
    return agg.histogram(panel(spark, d), "short_pct", 40, 0.0, F.greatest(F.percentile("short_pct", F.lit(0.995)), F.lit(1.0)))


_PAIRS = [("adj_close", "short_pct"), ("adj_close", "volume"), ("short_pct", "volume")]


@query(f"WITH {PANEL}, c AS (SELECT " + ", ".join(CORR.format(a=a, b=b) + f" AS c{i}" for i, (a, b) in enumerate(_PAIRS)) + " FROM panel) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(c{i}, 6) AS corr FROM c" for i, (a, b) in enumerate(_PAIRS)), dates="")
def correlation_pairs(spark, d):
    return wide.correlations(panel(spark, d), ["adj_close", "short_pct", "volume"]).drop("n")


@query(f"WITH {FUND}, l AS (SELECT floor(date_diff('second', accepted_date, CAST(date AS TIMESTAMP)) / 86400.0)::BIGINT AS lag FROM fp) SELECT count(lag) AS n_rows, count(*) FILTER (lag < 0) AS n_violations, greatest(0, coalesce(max(-lag), 0))::BIGINT AS worst_days FROM l", dates="")
def lookahead_audit(spark, d):
    from tidepanel.functions.calendar import filing_lag_days

    return agg.lookahead_audit(_fund(spark, d).withColumn("filing_lag_days", filing_lag_days(F.col("date"), F.col("accepted_date"))))


@query(f"WITH {PANEL}, {FWD} SELECT count(fwd) AS n, round(avg(fwd), 6) AS mean, round(stddev_samp(fwd), 6) AS std, round(max(fwd), 6) AS max, round(min(fwd), 6) AS min, count(*) FILTER (abs(fwd) > 2) AS n_large FROM fw", dates="")
def outlier_counts(spark, d):
    return agg.outlier_counts(_fwd(spark, d), "fwd")


@query(f"""WITH {PANEL}, {FWD}, k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY short_pct DESC, ticker) AS r, count(*) OVER (PARTITION BY date) AS n FROM fw WHERE short_pct IS NOT NULL),
b AS (SELECT 'top10' AS bucket, -fwd AS x FROM k WHERE r <= 10 UNION ALL SELECT 'decile', -fwd FROM k WHERE r <= greatest(round_even(n * 0.1::DOUBLE, 0), 1))
SELECT bucket, count(x) AS n, round(avg((x > 0)::INT), 6) AS win_rate, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(quantile_cont(x, 0.05), 6) AS p5, round(median(x), 6) AS median, round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x) FILTER (x > 0), 6) AS mean_win, round(avg(x) FILTER (x <= 0), 6) AS mean_loss, round(avg((x > 0.1::DOUBLE)::INT), 6) AS up_10 FROM b WHERE x IS NOT NULL GROUP BY bucket""", dates="")
def bucket_outcomes(spark, d):
    s = _fwd(spark, d).select("date", "ticker", F.col("short_pct").alias("score"), "fwd", F.lit("naive").alias("model"))
    picked = selection.positions(s, {"top10": ("top", 10), "decile": ("share", 0.1)}).withColumn("pnl", -F.col("fwd"))
    return agg.bucket_outcomes(picked, "pnl", ["bucket"]).select("bucket", "n", "win_rate", "mean", "std", "p5", "median", "min", "max", "mean_win", "mean_loss", "up_10")


@query(f"""WITH {PANEL}, {FWD}, p AS (SELECT short_pct / 100 AS p, (fwd < 0)::INT AS y FROM fw WHERE fwd IS NOT NULL), g AS (SELECT greatest(ceil(p * 10) - 1, 0)::INT AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS h FROM p WHERE p BETWEEN 0 AND 1 GROUP BY 1)
SELECT b.bin::INT AS bin, coalesce(n, 0) AS n, round(mp, 6) AS mean_prob, round(h, 6) AS hit_rate FROM range(10) b(bin) LEFT JOIN g ON g.bin = b.bin""", dates="")
def calibration_table(spark, d):
    rows = _fwd(spark, d).select((F.col("short_pct") / 100).alias("p"), (F.col("fwd") < 0).cast("int").alias("y"))
    return agg.calibration(rows, "p", "y")


@query(f"WITH {PANEL}, {FWD} SELECT round(avg(((short_pct / 100 >= 0.5) = (fwd > 0))::INT), 6) AS hit_rate FROM fw WHERE fwd IS NOT NULL", dates="")
def classification_hit_rate(spark, d):
    return agg.hit_rate(_fwd(spark, d).withColumn("p", F.col("short_pct") / 100), "p", "fwd")


@query(f"""WITH {PANEL}, {FWD}, r AS (SELECT industry, year(date) AS y, fwd FROM fw WHERE industry IS NOT NULL)
SELECT industry, period, n, round(mean, 6) AS mean, round(win_rate, 6) AS win_rate FROM (SELECT industry, CAST(y AS VARCHAR) AS period, count(fwd) AS n, avg(fwd) AS mean, avg((fwd > 0)::INT) AS win_rate FROM r GROUP BY 1, 2 UNION ALL SELECT industry, 'ALL', count(fwd), avg(fwd), avg((fwd > 0)::INT) FROM r GROUP BY 1)""", dates="")
def period_rollup(spark, d):
    rows = _fwd(spark, d).where("industry is not null").withColumn("period", F.year("date").cast("string"))
    return agg.period_rollups(rows, ["industry"], "period", "fwd")


@query("WITH o AS (SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS ticker FROM supplier WHERE s_suppkey % 3 <> 0), n AS (SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS ticker FROM supplier WHERE s_suppkey % 5 <> 0) SELECT coalesce(o.ticker, n.ticker) AS ticker, CASE WHEN o.ticker IS NULL THEN 'added' WHEN n.ticker IS NULL THEN 'removed' ELSE 'kept' END AS state FROM o FULL JOIN n ON o.ticker = n.ticker", dates="")
def universe_compare(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey"), F.col("s_suppkey").cast("string").alias("ticker"))
    return universe.compare(s.where("s_suppkey % 3 <> 0"), s.where("s_suppkey % 5 <> 0"))


@query(f"WITH {PANEL}, c AS (SELECT ticker, count(*) AS n FROM panel GROUP BY ticker ORDER BY n DESC, ticker LIMIT 20) SELECT ticker, n AS count FROM c", dates="")
def top_frequent_tickers(spark, d):
    return agg.top_frequent(panel(spark, d), "ticker", 20)


@query(f"WITH {PANEL}, l AS (SELECT * FROM panel WHERE date = (SELECT max(date) FROM panel)) SELECT date, ticker, round(short_pct, 6) AS short_pct FROM l ORDER BY short_pct DESC, ticker LIMIT 10")
def top_candidates(spark, d):
    return selection.top_candidates(panel(spark, d), 10, score="short_pct").select("date", "ticker", "short_pct")


@query(f"""WITH {PANEL}, s AS (SELECT date_trunc('day', min(date)) AS a, max(date) AS b FROM panel), f AS (SELECT i AS fold, a::DATE AS t0, a::DATE + ((156 + 26 * i) * 7 - 1)::INT AS te, b FROM s, range(100) r(i)),
g AS (SELECT fold, t0, te, te + 29 AS ts, least(te + 29 + 181, b) AS tt FROM f WHERE te < b AND te + 29 <= b)
SELECT g.fold::INT AS fold, count(*) FILTER (p.date BETWEEN t0 AND te) AS n_train, count(*) FILTER (p.date BETWEEN ts AND tt) AS n_test FROM g, panel p GROUP BY 1""", dates="")
def walk_forward_folds(spark, d):
    p = panel(spark, d)
    folds = splits.folds_of(p)
    n = lambda part: splits.with_folds(p, folds, part).groupBy("fold").agg(F.count(F.lit(1)).alias(f"n_{part}"))
    return n("train").join(n("test"), "fold", "left").fillna(0)


@query(f"WITH {PANEL}, r AS (SELECT DISTINCT date FROM panel), k AS (SELECT date, row_number() OVER (ORDER BY date DESC) AS n FROM r) SELECT CASE WHEN n <= 36 THEN 'OOS' ELSE 'IS' END AS period, count(*) AS rows, count(DISTINCT p.date) AS dates FROM panel p JOIN k ON k.date = p.date GROUP BY 1", dates="")
def period_stamp(spark, d):
    return splits.stamp_period(panel(spark, d)).groupBy("period").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("date").alias("dates"))


def _features(spark, d):
    p = windows.with_padded(_fwd(spark, d), "adj_close").withColumns({"mom": windows.change(F.col("_pad"), 4)}).drop("_pad")
    ranked = xsection.rank_columns(p, ["short_pct", "mom", "volume"])
    return scores.imputed(ranked, ["short_pct_rk", "mom_rk", "volume_rk"])


@query(f"""WITH {PANEL}, {FWD}, m AS (SELECT *, adj_close / lag(adj_close, 4) OVER ({W}) - 1 AS mom FROM fw), rk AS (SELECT *, (rank() OVER (PARTITION BY date ORDER BY short_pct NULLS LAST) + (count(*) OVER (PARTITION BY date, short_pct) - 1) / 2.0)::DOUBLE / count(short_pct) OVER (PARTITION BY date) AS a,
CASE WHEN mom IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY mom NULLS LAST) + (count(*) OVER (PARTITION BY date, mom) - 1) / 2.0)::DOUBLE / count(mom) OVER (PARTITION BY date) END AS b FROM m), e AS (SELECT *, round((a + 1 - coalesce(b, 0.5)) / 2, 9) AS s FROM rk)
SELECT date, ticker, round((rank() OVER (PARTITION BY date ORDER BY s) + (count(*) OVER (PARTITION BY date, s) - 1) / 2.0)::DOUBLE / count(s) OVER (PARTITION BY date), 6) AS ew FROM e""")
def equal_weight_composite(spark, d):
    f = _features(spark, d)
    # equal sums must tie whatever the order of additions
    mean = F.round((F.col("short_pct_rk") + 1 - F.col("mom_rk")) / 2, 9)
    return scores.equal_weight(f.withColumn("_s", mean), ["_s"]).select("date", "ticker", "ew")


@query()
def model_logit_walk_forward(spark, d):
    """Out-of-fold probabilities of all folds, refitted every 26 weeks."""
    f = stored(_features(spark, d).select("date", "ticker", "short_pct_rk", "mom_rk", "volume_rk", (F.col("fwd") < 0).cast("double").alias("y")), "walk-forward")
    model = folds.fit_fold_logits(f, splits.folds_of(f), ["short_pct_rk", "mom_rk", "volume_rk"])
    return model.score(f).select("date", "ticker", "score", "fold")


@query()
def pit_panel(spark, d):
    p = panel(spark, d).select("date", F.date_add("date", 4).alias("release_date"), "ticker", "short_positions", "short_pct")
    income = filings(spark, d).select(F.col("ticker").alias("symbol"), F.to_date("accepted_date").alias("date"), "accepted_date", F.year("accepted_date").cast("string").alias("fiscal_year"), F.concat(F.lit("Q"), F.quarter("accepted_date").cast("string")).alias("period"), "revenue", "net_income", (F.col("revenue") / 100).alias("shares"))
    return pit.assemble(p, daily(spark, d).withColumnRenamed("ticker", "symbol"), income, least_cap=1e6)


@query(f"""WITH {PANEL}, a AS (SELECT ticker, last_day(date) AS month, arg_max(adj_close, date) AS a, arg_max(adj_close + short_pct, date) AS b FROM panel GROUP BY 1, 2), r AS (SELECT ticker, a, b, a / lag(a) OVER (PARTITION BY ticker ORDER BY month) - 1 AS ra, b / lag(b) OVER (PARTITION BY ticker ORDER BY month) - 1 AS rb FROM a),
g AS (SELECT ticker, count(ra + rb) AS n, {CORR.format(a='ra', b='rb')} AS corr, median(abs(a / b - 1)) * 100 AS diff FROM r GROUP BY ticker)
SELECT ticker, n, round(corr, 6) AS corr, round(diff, 6) AS median_diff_pct, CASE WHEN n < 12 OR corr IS NULL THEN 'insufficient' WHEN corr < 0.9 THEN 'mismatch' WHEN corr < 0.98 OR diff > 1.0 THEN 'warn' ELSE 'ok' END AS flag FROM g""", dates="")
def vendor_check(spark, d):
    p = panel(spark, d)
    return agg.vendor_check(p.select("ticker", "date", F.col("adj_close").alias("px")), p.select("ticker", "date", (F.col("adj_close") + F.col("short_pct")).alias("px")))


#: Lags of the three levels: as many columns as a wide frame needs to be told from a narrow one.
_LAGS = [(c, k) for c in ("adj_close", "volume", "short_pct") for k in range(16)]
_WIDE = [f"{c}_{k}" for c, k in _LAGS]
_LAGGED = f"lagged AS (SELECT {', '.join(f'lag({c}, {k}) OVER ({W}) AS {c}_{k}' for c, k in _LAGS)} FROM panel)"


def _lagged(spark, d):
    w = Window.partitionBy("ticker").orderBy("date")
    return panel(spark, d).select(*[F.lag(c, k).over(w).alias(f"{c}_{k}") for c, k in _LAGS])


def _struct(a: str, b: str) -> str:
    r = f"corr({a}, {b})"
    return f"{{'a': '{a}', 'b': '{b}', 'n': count(({a} + {b})), 'corr': CASE WHEN isfinite({r}) THEN {r} END}}"


@query(f"WITH {PANEL}, {_LAGGED}, found AS (SELECT unnest([{', '.join(_struct(a, b) for i, a in enumerate(_WIDE) for b in _WIDE[i + 1 :])}]) AS s FROM lagged) SELECT s.a AS a, s.b AS b, s.n AS n, round(s.corr, 6) AS corr FROM found", dates="")
def wide_correlations(spark, d):
    return wide.correlations(_lagged(spark, d), _WIDE)


@query(f"WITH {PANEL}, {_LAGGED} SELECT unnest([{', '.join(f"'{c}'" for c in _WIDE)}]) AS metric, round(unnest([{', '.join(f'avg(({c} IS NULL)::INT)' for c in _WIDE)}]), 6) AS value FROM lagged", dates="")
def wide_missing(spark, d):
    return wide.missing(_lagged(spark, d), _WIDE)


def _residual_sql(sets: str) -> str:
    """Residuals on sectors (and sets they lie in) and on odd tickers, as a two-step regression."""
    return f"""WITH {PANEL}, o AS (SELECT date, ticker, ln(adj_close) AS y, sector, industry, (CAST(ticker AS INT) % 2)::DOUBLE AS d FROM panel WHERE sector IS NOT NULL),
c AS (SELECT *, count(*) OVER (PARTITION BY date) AS n, {" + ".join(f"count(DISTINCT {s}) OVER (PARTITION BY date)" for s in sets.split())} AS k, y - avg(y) OVER (PARTITION BY date) AS c, y - avg(y) OVER (PARTITION BY date, sector) AS yy, d - avg(d) OVER (PARTITION BY date, sector) AS dd FROM o),
b AS (SELECT *, sum(yy * dd) OVER (PARTITION BY date) AS p, sum(dd * dd) OVER (PARTITION BY date) AS q FROM c)
SELECT date, ticker, round(CASE WHEN n <= k THEN c WHEN q > 1e-12 THEN yy - p / q * dd ELSE yy END, 6) AS residual FROM b"""


def _residuals(spark, d, groups: list[str]):
    rows = panel(spark, d).where("sector is not null").select("date", "ticker", F.ln("adj_close").alias("level"), "sector", "industry", (F.col("ticker").cast("int") % 2).alias("odd"))
    return xsection.neutralize(rows, "level", groups, name="residual").select("date", "ticker", "residual")


@query(_residual_sql("sector d"))
def crossed_group_neutral(spark, d):
    """Sectors cross odd and even tickers: two sets of dummies that are not nested."""
    return _residuals(spark, d, ["sector", "odd"])


@query(_residual_sql("sector industry d"))
def two_group_neutral(spark, d):
    """Three sets, of which one is crossed and one lies in another."""
    return _residuals(spark, d, ["sector", "industry", "odd"])
