"""Queries over the derived panel: row windows, cross-sections, joins. Each stands beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.features import build, families
from tidepanel.functions import calendar as cal
from tidepanel.functions import nulls, text
from tidepanel.operators import asof, selection, windows, xsection
from tidepanel.panel.clean import conservative_clean
from tidepanel.plans.tables import DAILY, FILINGS, PANEL, daily, filing_sums, filings, panel, read, registrar, statement_items

W = "PARTITION BY ticker ORDER BY date"
QUERIES, SQL = {}, {}
query = registrar(QUERIES, SQL)


def r6(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


def trail(n: int) -> str:
    return f"{W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"


RET = f"rets AS (SELECT *, adj_close / lag(adj_close) OVER ({W}) - 1 AS ret FROM panel)"
MOM = f"mom AS (SELECT *, adj_close / lag(adj_close, 4) OVER ({W}) - 1 AS mom_1m FROM panel)"
PCT = "CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY date) END"
BUCKET = """bucketed AS (SELECT *, CASE WHEN r = 1 THEN 0 ELSE ceil((r - 1) * {k}::DOUBLE / (n - 1)) - 1 END::BIGINT AS bucket FROM
  (SELECT *, row_number() OVER (PARTITION BY date ORDER BY {x}, ticker) AS r, count(*) OVER (PARTITION BY date) AS n FROM {src} WHERE {x} IS NOT NULL))"""


def _mom(spark, d):
    return windows.with_padded(panel(spark, d), "adj_close").withColumn("mom_1m", windows.change(F.col("_pad"), 4)).drop("_pad")


@query(f"WITH {PANEL} SELECT date, ticker, {r6('adj_close', 'volume', 'short_positions', 'short_pct')}, sector, industry, company FROM panel")
def weekly_panel(spark, d):
    return panel(spark, d)


@query(f"WITH {PANEL}, {MOM}, ranked AS (SELECT *, {PCT.format(x='mom_1m')} AS mom_rk FROM mom), {BUCKET.format(k=10, x='mom_rk', src='ranked')} SELECT date, ticker, round(mom_1m, 6) AS mom_1m, round(mom_rk, 6) AS mom_rk, bucket FROM bucketed WHERE bucket = 9")
def flagship_momentum_decile(spark, d):
    ranked = _mom(spark, d).withColumn("mom_rk", xsection.percentile_rank(F.col("mom_1m")))
    return xsection.with_bucket(ranked, "mom_rk", 10).where("bucket = 9").select("date", "ticker", "mom_1m", "mom_rk", "bucket")


@query(f"""WITH {PANEL}, {RET} SELECT date, ticker, {", ".join(f"round(adj_close / lag(adj_close, {k}) OVER ({W}) - 1, 6) AS mom_{n}" for n, k in (("1w", 1), ("1m", 4), ("3m", 12), ("6m", 26), ("12m", 52)))},
round(lag(adj_close, 1) OVER ({W}) / lag(adj_close, 13) OVER ({W}) - 1, 6) AS mom_3m_skip1m,
round(CASE WHEN count(adj_close) OVER ({trail(52)}) >= 13 THEN adj_close / max(adj_close) OVER ({trail(52)}) - 1 END, 6) AS drawdown_12m,
round(CASE WHEN count(ret) OVER ({trail(4)}) >= 2 THEN stddev_samp(ret) OVER ({trail(4)}) END, 6) AS vol_1m,
round(CASE WHEN count(ret) OVER ({trail(12)}) >= 6 THEN stddev_samp(ret) OVER ({trail(12)}) END, 6) AS vol_3m FROM rets""")
def price_features(spark, d):
    return families.price_family(panel(spark, d)).select("date", "ticker", "mom_1w", "mom_1m", "mom_3m", "mom_6m", "mom_12m", "mom_3m_skip1m", "drawdown_12m", "vol_1m", "vol_3m")


@query(f"""WITH {PANEL}, {RET}, mk AS (SELECT date, avg(ret) AS mkt FROM rets GROUP BY date), j AS (SELECT r.date, r.ticker, r.ret, m.mkt FROM rets r LEFT JOIN mk m ON r.date = m.date),
b AS (SELECT *, CASE WHEN count(CASE WHEN ret IS NOT NULL AND mkt IS NOT NULL THEN 1 END) OVER ({trail(52)}) >= 26 THEN covar_samp(ret, mkt) OVER ({trail(52)}) END AS c,
CASE WHEN count(mkt) OVER ({trail(52)}) >= 26 THEN var_samp(mkt) OVER ({trail(52)}) END AS v FROM j) SELECT date, ticker, round(c / nullif(v, 0), 6) AS beta_12m FROM b""")
def rolling_beta(spark, d):
    rets = windows.with_padded(panel(spark, d), "adj_close").withColumn("_ret1", windows.change(F.col("_pad"))).drop("_pad")
    market = rets.groupBy("date").agg(F.avg("_ret1").alias("mkt"))
    return families.price_family(rets.join(market, "date", "left"), market="mkt").select("date", "ticker", "beta_12m")


@query(f"""WITH {PANEL}, s AS (SELECT *, short_pct - lag(short_pct) OVER ({W}) AS diff, list(short_pct) OVER ({trail(52)}) AS seen FROM panel)
SELECT date, ticker, round(CASE WHEN count(short_pct) OVER ({trail(52)}) >= 13 AND stddev_pop(short_pct) OVER ({trail(52)}) > 0 THEN (short_pct - avg(short_pct) OVER ({trail(52)})) / stddev_pop(short_pct) OVER ({trail(52)}) END, 6) AS si_z_12m,
round(CASE WHEN len(seen) >= 12 THEN (len(list_filter(seen, lambda v: v < short_pct)) + (len(list_filter(seen, lambda v: v = short_pct)) + 1) / 2.0) / len(seen) END, 6) AS si_percentile_12m,
round(CASE WHEN count(diff) OVER ({trail(5)}) >= 3 THEN sum((diff > 0)::INT::DOUBLE) OVER ({trail(5)}) END, 6) AS si_persistence,
round(short_pct - lag(short_pct, 4) OVER ({W}), 6) AS si_build_rate_1m,
round(CASE WHEN count(volume) OVER ({trail(20)}) >= 10 THEN short_positions / nullif(avg(volume) OVER ({trail(20)}), 0) END, 6) AS days_to_cover FROM s""")
def short_interest_features(spark, d):
    return families.short_family(panel(spark, d)).select("date", "ticker", "si_z_12m", "si_percentile_12m", "si_persistence", "si_build_rate_1m", "days_to_cover")


@query(f"""WITH {PANEL}, {RET}, a AS (SELECT *, adj_close * volume AS dv, CASE WHEN adj_close * volume > 0 THEN abs(ret) / (adj_close * volume) END AS il FROM rets)
SELECT date, ticker, round(CASE WHEN count(dv) OVER ({trail(20)}) >= 5 THEN avg(dv) OVER ({trail(20)}) END + 1e-6, 4) AS adv, round(1e6 * CASE WHEN count(il) OVER ({trail(20)}) >= 5 THEN avg(il) OVER ({trail(20)}) END, 6) AS amihud_e6 FROM a""")
def liquidity_features(spark, d):
    out = families.liquidity_family(panel(spark, d))
    return out.select("date", "ticker", F.round(F.col("adv") + 1e-6, 4).alias("adv"), (F.col("amihud") * 1e6).alias("amihud_e6"))


@query(f"WITH {PANEL} SELECT date, ticker, round({PCT.format(x='short_pct')}, 6) AS short_pct_rk, round({PCT.format(x='volume')}, 6) AS volume_rk, round({PCT.format(x='adj_close')}, 6) AS adj_close_rk FROM panel")
def cross_sectional_ranks(spark, d):
    return xsection.rank_columns(panel(spark, d), ["short_pct", "volume", "adj_close"]).select("date", "ticker", "short_pct_rk", "volume_rk", "adj_close_rk")


@query(f"""WITH {PANEL}, q AS (SELECT date, quantile_cont(short_pct, 0.01) AS lo, quantile_cont(short_pct, 0.99) AS hi FROM panel GROUP BY date),
x AS (SELECT p.date, p.ticker, greatest(least(short_pct, hi), lo) AS v FROM panel p JOIN q ON p.date = q.date)
SELECT date, ticker, round(CASE WHEN stddev_pop(v) OVER (PARTITION BY date) > 0 THEN (v - avg(v) OVER (PARTITION BY date)) / stddev_pop(v) OVER (PARTITION BY date) END, 6) AS short_pct_z FROM x""")
def winsorized_zscore(spark, d):
    return xsection.with_zscore(panel(spark, d), ["short_pct"]).select("date", "ticker", "short_pct_z")


@query(f"WITH {PANEL} SELECT date, ticker, round(adj_close - avg(adj_close) OVER (PARTITION BY date, sector) + 1e-8, 6) AS adj_close_neutral FROM panel")
def sector_neutral(spark, d):
    return xsection.neutralize(panel(spark, d), "adj_close", ["sector"]).select("date", "ticker", (F.col("adj_close_neutral") + 1e-8).alias("adj_close_neutral"))


@query(f"WITH {PANEL}, {BUCKET.format(k=5, x='adj_close', src='panel')} SELECT date, ticker, bucket FROM bucketed")
def rank_qcut_bucket(spark, d):
    return xsection.with_bucket(panel(spark, d), "adj_close", 5).select("date", "ticker", "bucket")


@query(f"""WITH {PANEL}, e AS (SELECT date, count(adj_close) AS n, list_distinct(quantile_cont(adj_close, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1.0])) AS e FROM panel GROUP BY date)
SELECT p.date, p.ticker, CASE WHEN n >= 10 AND len(e) > 1 THEN greatest(len(list_filter(e, lambda v: v < adj_close)) - 1, 0) END::INT AS decile FROM panel p JOIN e ON p.date = e.date""")
def decile_label(spark, d):
    return xsection.with_decile_label(panel(spark, d), "adj_close").select("date", "ticker", "decile")


FWD = f"fw AS (SELECT *, lead(adj_close, 4) OVER ({W}) / adj_close - 1 AS fwd, lag(adj_close, 1) OVER ({W}) / adj_close - 1 AS rev FROM panel)"


def _fwd(spark, d):
    p = panel(spark, d)
    return p.withColumns({"fwd": windows.forward_change(F.col("adj_close"), 4), "rev": nulls.divide(F.lag("adj_close").over(windows.ordered()), F.col("adj_close")) - 1})


CORR = "CASE WHEN count({a}) > 1 AND min({a}) < max({a}) AND min({b}) < max({b}) THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END"


@query(f"WITH {PANEL}, {FWD}, c AS (SELECT date, CASE WHEN fwd IS NOT NULL THEN rev END AS a, CASE WHEN rev IS NOT NULL THEN fwd END AS b FROM fw) SELECT date, round({CORR.format(a='a', b='b')}, 6) AS ic FROM c GROUP BY date")
def ic_by_date(spark, d):
    return xsection.ic(_fwd(spark, d), "rev", "fwd")


RIC = f"""{FWD}, pr AS (SELECT date, (rank() OVER (PARTITION BY date ORDER BY rev) + (count(*) OVER (PARTITION BY date, rev) - 1) / 2.0)::DOUBLE AS a,
(rank() OVER (PARTITION BY date ORDER BY fwd) + (count(*) OVER (PARTITION BY date, fwd) - 1) / 2.0)::DOUBLE AS b FROM fw WHERE rev IS NOT NULL AND fwd IS NOT NULL),
ric AS (SELECT dd.date, x.ic FROM (SELECT DISTINCT date FROM fw) dd LEFT JOIN (SELECT date, {CORR.format(a='a', b='b')} AS ic FROM pr GROUP BY date) x ON x.date = dd.date)"""


@query(f"WITH {PANEL}, {RIC} SELECT date, round(ic, 6) AS ic FROM ric")
def rank_ic_by_date(spark, d):
    return xsection.rank_ic(_fwd(spark, d), "rev", "fwd")


@query(f"WITH {PANEL}, {RIC} SELECT round(avg(ic), 6) AS mean, round(stddev_samp(ic), 6) AS std, round(avg(ic) / (stddev_samp(ic) / sqrt(count(ic))), 6) AS t, round(avg((ic > 0)::INT), 6) AS hit, count(ic) AS n FROM (SELECT round(ic, 12) AS ic FROM ric) AS q WHERE ic IS NOT NULL", dates="")
def rank_ic_summary(spark, d):
    # a correlation of nothing but rounding noise must count as 0 in the share above 0
    return xsection.ic_summary(xsection.rank_ic(_fwd(spark, d), "rev", "fwd").withColumn("ic", F.round("ic", 12)))


@query(f"""WITH {PANEL}, {FWD}, pairs AS (SELECT * FROM fw WHERE rev IS NOT NULL AND fwd IS NOT NULL), {BUCKET.format(k=10, x='rev', src='pairs')}
SELECT dd.date, round(s.spread, 6) AS spread FROM (SELECT DISTINCT date FROM fw) dd LEFT JOIN (SELECT date, CASE WHEN count(*) >= 10 THEN avg(CASE WHEN bucket = 9 THEN fwd END) - avg(CASE WHEN bucket = 0 THEN fwd END) END AS spread FROM bucketed GROUP BY date) s ON s.date = dd.date""")
def decile_spread(spark, d):
    return xsection.bucket_spread(_fwd(spark, d), "rev", "fwd", 10)


@query(f"""WITH {PANEL}, {DAILY}, j AS (SELECT p.date, p.ticker, x.date AS hit, x.adj_close AS px FROM (SELECT date + 1 AS t, * FROM panel) p ASOF LEFT JOIN daily x ON p.ticker = x.ticker AND p.t >= x.date)
SELECT date, ticker, CASE WHEN date + 1 - hit <= 3 THEN hit END AS quote_date, CASE WHEN date + 1 - hit <= 3 THEN round(px, 6) END AS quote FROM j""", dates="date quote_date")
def asof_price(spark, d):
    left = panel(spark, d).select("date", "ticker").withColumn("t", F.date_add("date", 1))
    right = daily(spark, d).select("ticker", F.col("date").alias("q"), F.col("adj_close").alias("quote"))
    return asof.asof_join(left, right, "ticker", "t", "q", ["quote"], tolerance_days=3, time_as="quote_date").select("date", "ticker", "quote_date", "quote")


@query(f"""WITH {PANEL}, {FILINGS}, j AS (SELECT p.date, p.ticker, f.accepted_date, f.revenue FROM panel p ASOF LEFT JOIN filings f ON p.ticker = f.ticker AND CAST(p.date AS TIMESTAMP) >= f.accepted_date)
SELECT date, ticker, accepted_date, round(revenue, 6) AS revenue, floor(date_diff('second', accepted_date, CAST(date AS TIMESTAMP)) / 86400.0)::INT AS filing_lag_days FROM j""", times="accepted_date")
def asof_filing(spark, d):
    out = asof.asof_join(panel(spark, d).select("date", "ticker"), filings(spark, d).select("ticker", "accepted_date", "revenue"), "ticker", "date", "accepted_date", ["accepted_date", "revenue"])
    return out.withColumn("filing_lag_days", cal.filing_lag_days(F.col("date"), F.col("accepted_date")))


@query(f"""WITH {PANEL}, {DAILY}, j AS (SELECT p.date, p.ticker, x.date AS hit, x.adj_close AS px FROM panel p ASOF LEFT JOIN daily x ON p.ticker = x.ticker AND p.date <= x.date)
SELECT date, ticker, hit AS next_date, round(px, 6) AS next_px FROM j""", dates="date next_date")
def asof_next_price(spark, d):
    right = daily(spark, d).select("ticker", F.col("date").alias("q"), F.col("adj_close").alias("next_px"))
    return asof.asof_join(panel(spark, d).select("date", "ticker"), right, "ticker", "date", "q", ["next_px"], time_as="next_date", forward=True)


def _fwd_sql(h: int) -> str:
    return f"f{h} AS (SELECT p.date, p.ticker, CASE WHEN p.t - x.date <= 7 AND x.date > p.date THEN x.adj_close / p.adj_close - 1 END AS v FROM (SELECT date + {7 * h} AS t, * FROM panel WHERE adj_close > 0) p ASOF LEFT JOIN (SELECT * FROM panel WHERE adj_close > 0) x ON p.ticker = x.ticker AND p.t >= x.date)"


@query(f"WITH {PANEL}, {', '.join(_fwd_sql(h) for h in (1, 4, 12))} SELECT p.date, p.ticker, round(f1.v, 6) AS fwd_ret_1w, round(f4.v, 6) AS fwd_ret_1m, round(f12.v, 6) AS fwd_ret_3m FROM panel p " + " ".join(f"LEFT JOIN f{h} ON f{h}.date = p.date AND f{h}.ticker = p.ticker" for h in (1, 4, 12)))
def forward_labels(spark, d):
    p = panel(spark, d)
    return asof.forward_returns(p, p, [1, 4, 12]).select("date", "ticker", "fwd_ret_1w", "fwd_ret_1m", "fwd_ret_3m")


FUND = f"""{PANEL}, {FILINGS}, fp AS (SELECT p.date, p.ticker, f.* EXCLUDE (ticker) FROM panel p ASOF LEFT JOIN filings f ON p.ticker = f.ticker AND CAST(p.date AS TIMESTAMP) >= f.accepted_date)"""


def _fund(spark, d):
    f = filings(spark, d)
    return asof.asof_join(panel(spark, d).select("date", "ticker"), f, "ticker", "date", "accepted_date", [c for c in f.columns if c != "ticker"])


@query(f"""WITH {FUND} SELECT date, ticker, round(net_income / nullif(total_equity, 0), 6) AS roe, round(0.79::DOUBLE * operating_income / nullif(total_equity + total_debt - cash, 0), 6) AS roic, round(net_income / nullif(total_assets, 0), 6) AS roa,
round(gross_profit / nullif(revenue, 0), 6) AS gross_margin, round(operating_income / nullif(revenue, 0), 6) AS operating_margin, round(net_income / nullif(revenue, 0), 6) AS net_margin, round(-((net_income - operating_cash_flow) / nullif(total_assets, 0)), 6) AS accruals,
round(CASE WHEN net_income > 0 THEN operating_cash_flow / net_income END, 6) AS cfo_to_ni FROM fp""")
def quality_features(spark, d):
    return families.quality_family(_fund(spark, d)).select("date", "ticker", "roe", "roic", "roa", "gross_margin", "operating_margin", "net_margin", "accruals", "cfo_to_ni")


def _pos(num: str, den: str, name: str) -> str:
    return f"round(CASE WHEN {den} > 0 THEN {num} / ({den}) END, 6) AS {name}"


@query(f"WITH {FUND} SELECT date, ticker, {_pos('(mkt_cap + total_debt - cash)', 'ebitda', 'ev_ebitda')}, {_pos('mkt_cap', 'net_income', 'pe')}, {_pos('mkt_cap', 'total_equity', 'pb')}, {_pos('mkt_cap', 'revenue', 'ps')}, {_pos('free_cash_flow', 'mkt_cap', 'fcf_yield')}, {_pos('net_income', 'mkt_cap', 'earnings_yield')}, {_pos('revenue', 'mkt_cap', 'sales_yield')} FROM fp")
def valuation_features(spark, d):
    return families.valuation_family(_fund(spark, d)).select("date", "ticker", "ev_ebitda", "pe", "pb", "ps", "fcf_yield", "earnings_yield", "sales_yield")


def _tiny(num: str, den: str, name: str) -> str:
    return f"round(CASE WHEN abs({den}) > 1e-12 THEN {num} / ({den}) END, 6) AS {name}"


@query(f"""WITH {FUND}, l AS (SELECT *, lag(revenue, 4) OVER ({W}) AS r4, lag(total_assets, 4) OVER ({W}) AS a4 FROM fp) SELECT date, ticker, {_tiny('total_debt', 'total_equity', 'debt_equity')}, {_tiny('(total_debt - cash)', 'ebitda', 'net_debt_to_ebitda')},
{_tiny('operating_income', 'abs(interest_expense)', 'interest_coverage')}, {_tiny('current_assets', 'current_liabilities', 'current_ratio')}, {_tiny('(revenue - r4)', 'abs(r4)', 'revenue_growth')}, {_tiny('(total_assets - a4)', 'abs(a4)', 'assets_growth')} FROM l""")
def leverage_growth_features(spark, d):
    return families.growth_family(_fund(spark, d)).select("date", "ticker", "debt_equity", "net_debt_to_ebitda", "interest_coverage", "current_ratio", "revenue_growth", "assets_growth")


@query()
def feature_matrix(spark, d):
    """All six families over the panel with the filings known at each date, ranks of every factor, and sector dummies."""
    names = [r["n_name"] for r in read(spark, d, "nation").select("n_name").orderBy("n_name").collect()]
    f = filing_sums(spark, d)
    known = asof.asof_join(panel(spark, d), f, "ticker", "date", "accepted_date", [c for c in f.columns if c != "ticker"])
    return build.build_features(known, sectors=names, derive=statement_items())


@query(f"WITH {PANEL}, c AS (SELECT date, ticker, adj_close / lag(adj_close) OVER ({W}) - 1 AS change FROM panel) SELECT date, ticker, round(change, 6) AS change FROM c WHERE abs(change) > 1.5")
def corrupted_returns(spark, d):
    return windows.suspicious(panel(spark, d), "adj_close").select("date", "ticker", "change")


@query(f"WITH {PANEL}, c AS (SELECT *, adj_close / lag(adj_close) OVER ({W}) - 1 AS ch FROM panel) SELECT date, ticker, CASE WHEN NOT coalesce(abs(ch) > 1.5, false) THEN round(adj_close, 6) END AS adj_close, coalesce(abs(ch) > 1.5, false) AS excluded_corrupted, NOT coalesce(abs(ch) > 1.5, false) AS investable FROM c")
def clean_panel(spark, d):
    p = panel(spark, d).select("date", "ticker", "adj_close")
    return conservative_clean(p, windows.suspicious(p, "adj_close"), strict_gate=False).select("date", "ticker", "adj_close", "excluded_corrupted", "investable")


@query(f"WITH {PANEL}, m AS (SELECT *, max(date) OVER (PARTITION BY date_trunc('month', date)) AS l FROM panel) SELECT date, ticker, round(adj_close, 6) AS adj_close FROM m WHERE date = l")
def month_snapshot(spark, d):
    return windows.month_snapshot(panel(spark, d)).select("date", "ticker", "adj_close")


@query("""WITH kinds AS (SELECT event_type, ntile(2) OVER (ORDER BY event_type) = 1 AS off FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL)),
log AS (SELECT CAST(user_id AS VARCHAR) AS symbol, CAST(ts AS DATE) AS date, max(off::INT) AS gone FROM events JOIN kinds ON kinds.event_type = events.event_type GROUP BY 1, 2),
syms AS (SELECT symbol, arg_max(gone, date) = 0 AS held FROM log GROUP BY 1), days AS (SELECT DISTINCT last_day(CAST(ts AS DATE)) AS date FROM events),
nx AS (SELECT d.date, s.symbol, s.held, (SELECT arg_min(gone, l.date) FROM log l WHERE l.symbol = s.symbol AND l.date > d.date) AS g FROM days d, syms s)
SELECT date, symbol FROM nx WHERE CASE WHEN g = 1 THEN true WHEN g = 0 THEN false ELSE held END""")
def membership_panel(spark, d):
    """All events are changes: the first half of the types, by name, take a symbol off the list, the others put it on; those last put on are its members today."""
    e = read(spark, d, "events")
    kinds = e.where("event_type IS NOT NULL").select("event_type").distinct().withColumn("off", F.ntile(2).over(Window.orderBy("event_type")) == 1)
    log = e.join(kinds, "event_type").select(F.col("user_id").cast("string").alias("symbol"), F.to_date("ts").alias("date"), F.when(F.col("off"), "removed").otherwise("added").alias("op"))
    last = log.groupBy("symbol").agg(F.max(F.struct("date", "op")).alias("s"))  # of one day's changes a removal counts
    return asof.membership(log, last.where("s.op = 'added'").select("symbol"), e.select(F.last_day(F.to_date("ts")).alias("date")).distinct())


@query(f"WITH {PANEL}, k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY short_pct DESC, ticker) AS r, count(*) OVER (PARTITION BY date) AS n FROM panel WHERE short_pct IS NOT NULL) SELECT date, ticker, round(-1.0 / 20, 6) AS weight, -1 AS side FROM k WHERE r <= 20 AND n >= 20")
def top_k_short(spark, d):
    return selection.top_k_short(selection.eligible(panel(spark, d), score="short_pct"), 20, "short_pct")


@query(f"WITH {PANEL}, {BUCKET.format(k=10, x='adj_close', src='panel')}, t AS (SELECT *, max(bucket) OVER (PARTITION BY date) AS top FROM bucketed) SELECT date, ticker, round(-1.0 / count(*) OVER (PARTITION BY date), 6) AS weight, -1 AS side FROM t WHERE bucket = top AND top > 0")
def decile_short(spark, d):
    return selection.quantile_short(panel(spark, d), 10, "adj_close")


LS = f"""{BUCKET.format(k=10, x='adj_close', src='panel')}, t AS (SELECT *, max(bucket) OVER (PARTITION BY date) AS top, min(bucket) OVER (PARTITION BY date) AS low FROM bucketed),
book AS (SELECT date, ticker, CASE WHEN bucket = top THEN -1.0 ELSE 1.0 END / count(*) OVER (PARTITION BY date, bucket) AS weight, CASE WHEN bucket = top THEN -1 ELSE 1 END AS side FROM t WHERE top > low AND bucket IN (top, low))"""


@query(f"WITH {PANEL}, {LS} SELECT date, ticker, round(weight, 6) AS weight, side FROM book")
def long_short_decile(spark, d):
    return selection.long_short(panel(spark, d), 10, "adj_close")


@query(f"WITH {PANEL}, k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY short_pct DESC, ticker) AS rank, count(*) OVER (PARTITION BY date) AS n FROM panel WHERE short_pct IS NOT NULL) SELECT date, ticker, rank FROM k WHERE rank <= greatest(round_even(n * 0.1::DOUBLE, 0), 1)")
def top_fraction(spark, d):
    return selection.top_rows(panel(spark, d), share=0.1, score="short_pct").select("date", "ticker", F.col("rank").cast("long").alias("rank"))


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) - ((isodow(o_orderdate) + 2) % 7)::INT AS friday, CAST(o_orderdate AS DATE) - CASE WHEN isodow(o_orderdate) <= 4 THEN 6 WHEN isodow(o_orderdate) = 7 THEN 5 ELSE 4 END AS as_of, CAST(date_trunc('week', o_orderdate) AS DATE) + 4 AS week_friday FROM orders", dates="d friday as_of week_friday")
def calendar_functions(spark, d):
    day = F.to_date("o_orderdate")
    return read(spark, d, "orders").select(day.alias("d"), cal.recent_friday(day).alias("friday"), cal.as_of_date(day).alias("as_of"), cal.week_friday(F.col("o_orderdate")).alias("week_friday")).distinct()


@query("SELECT s_suppkey, regexp_matches(replace(trim(s_name), '.', ''), '^[A-Za-z0-9]{1,6}$') AND NOT contains(trim(s_name), ' ') AND NOT starts_with(lower(trim(s_name)), 'product code') AS ticker_ok, upper(trim(s_name)) || '.AX' AS vendor_symbol, substr(sha1(concat_ws('|', s_name, CAST(s_nationkey AS VARCHAR))), 1, 16) AS key FROM supplier", dates="")
def text_functions(spark, d):
    s = read(spark, d, "supplier")
    name = F.col("s_name")
    return s.select("s_suppkey", text.is_ticker(name).alias("ticker_ok"), text.vendor_symbol(name).alias("vendor_symbol"), text.hash_key(name, F.col("s_nationkey").cast("string")).alias("key"))
