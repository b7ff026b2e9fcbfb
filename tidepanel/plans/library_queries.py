"""Queries over selections, names, dates, labels and model reports. Each stands beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidepanel.features import build, families, refresh
from tidepanel.functions import calendar as cal
from tidepanel.functions import nulls, text
from tidepanel.models import attribution, audit, boosting, scores, splits
from tidepanel.operators import aggregates as agg
from tidepanel.operators import selection, windows, xsection
from tidepanel.panel import clean, universe
from tidepanel.plans.panel_queries import FWD, PCT, W, _fwd, trail
from tidepanel.plans.report_queries import _features
from tidepanel.plans.tables import FILINGS, PANEL, filings, panel, read, registrar
from tidepanel.portfolio import metrics
from tidepanel.reports import tables as reports
from tidepanel.sources.shared import shared_folder, stored

QUERIES, SQL = {}, {}
query = registrar(QUERIES, SQL)


@query(f"""WITH {PANEL} SELECT date, ticker FROM panel WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'
AND ticker IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal > 0) AND ticker NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal > 5000)""")
def clipped_universe(spark, d):
    listed = read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("ticker"), "s_acctbal")
    rows = selection.clip_dates(panel(spark, d).select("date", "ticker"), "1996-01-01", "1998-12-31")
    return universe.exclude(universe.restrict(rows, listed.where("s_acctbal > 0")), listed.where("s_acctbal > 5000"))


@query("""WITH raw AS (SELECT p_partkey, p_name || CASE WHEN p_size > 10 THEN ' Ordinary' ELSE ' note' END AS company FROM part)
SELECT DISTINCT array_to_string(list_transform(string_split(regexp_replace(company, ' Ordinary', ''), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name FROM raw WHERE contains(upper(company), 'ORDINARY')""", dates="")
def ordinary_names(spark, d):
    raw = read(spark, d, "part").select("p_partkey", F.concat("p_name", F.when(F.col("p_size") > 10, " Ordinary").otherwise(" note")).alias("company"))
    return text.unique_key(universe.ordinary_only(raw).select(text.company_name(F.col("company")).alias("name")), "name")


@query("""SELECT p_partkey, (p_size || '000.5')::DOUBLE AS parsed, NULL::DOUBLE AS junk, CASE WHEN p_size > 25 THEN p_size ELSE p_retailprice END::DOUBLE AS preferred, p_retailprice AS first_there FROM part""", dates="")
def numbers_and_choices(spark, d):
    p = read(spark, d, "part")
    own = F.when(F.col("p_size") > 25, F.col("p_size").cast("double"))
    return nulls.require(p, "p_size", "p_retailprice").select(
        "p_partkey", nulls.number(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(",000.5 "))).alias("parsed"), nulls.number(F.col("p_name")).alias("junk"),
        nulls.prefer_rows(own, F.col("p_retailprice")).alias("preferred"), nulls.first_present(p, "p_absent", "p_retailprice").alias("first_there"),
    )


@query("""WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day FROM orders), s AS (SELECT min(day) AS a, max(day) AS b FROM o), d AS (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS date FROM s),
ends AS (SELECT 'friday' AS kind, date FROM d WHERE isodow(date) = 5 UNION ALL SELECT 'month', date FROM d WHERE date = last_day(date) UNION ALL SELECT 'quarter', date FROM d WHERE date = last_day(date) AND month(date) % 3 = 0
UNION ALL SELECT 'back', b - ((isodow(b) + 2) % 7)::INT - 7 * i::INT FROM s, range(10) AS r(i))
SELECT kind, date, (SELECT count(*) FROM o WHERE day = date) AS n_orders FROM ends""")
def period_ends(spark, d):
    """Ends of weeks, months and quarters between the first and the last order, with the orders of that day."""
    days = read(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"))
    first, last = (str(x) for x in days.agg(F.min("date"), F.max("date")).first())
    kinds = {"friday": cal.week_ends(spark, first, last), "month": cal.month_ends(spark, first, last), "quarter": cal.quarter_ends(spark, first, last), "back": cal.fridays_back(spark, 10, last)}
    ends = xsection.union_all(*[df.select(F.lit(k).alias("kind"), "date") for k, df in kinds.items()])
    return ends.join(days.groupBy("date").agg(F.count(F.lit(1)).alias("n_orders")), "date", "left").fillna(0, ["n_orders"])


@query(f"""WITH {PANEL}, s AS (SELECT *, adj_close / lag(adj_close) OVER ({W}) - 1 AS r, coalesce((short_pct > lag(short_pct) OVER ({W}))::INT, 0)::DOUBLE AS up, adj_close / lag(adj_close, 12) OVER ({W}) - 1 AS mom, list(short_pct) OVER ({trail(52)}) AS seen FROM panel),
t AS (SELECT date, ticker, mom, CASE WHEN len(seen) >= 12 THEN (len(list_filter(seen, lambda v: v < short_pct)) + (len(list_filter(seen, lambda v: v = short_pct)) + 1) / 2.0) / len(seen) END AS pct, sum(up) OVER ({trail(5)}) AS up_weeks,
CASE WHEN count(r) OVER ({trail(4)}) >= 3 THEN stddev_samp(r) OVER ({trail(4)}) END AS vol FROM s)
SELECT date, ticker, round(mom, 6) AS mom_12w, round(pct, 6) AS si_pct_52w, up_weeks, round(vol, 6) AS vol_4w, round(pct * -mom, 6) AS si_x_mom FROM t""")
def classic_signals(spark, d):
    return families.classic_signals(panel(spark, d)).select("date", "ticker", "mom_12w", "si_pct_52w", "up_weeks", "vol_4w", "si_x_mom")


@query(f"""WITH {FILINGS}, g AS (SELECT *, lag(revenue, 4) OVER (PARTITION BY ticker ORDER BY accepted_date) AS b FROM filings) SELECT ticker, accepted_date, round((revenue - b) / nullif(abs(b), 0), 6) AS revenue_yoy FROM g""", dates="", times="accepted_date")
def quarter_growth(spark, d):
    return families.quarter_growth(filings(spark, d), "revenue", "ticker", "accepted_date").select("ticker", "accepted_date", "revenue_yoy")


_SHARES = "CASE WHEN CAST(ticker AS INT) % 3 <> 0 THEN 1000.0::DOUBLE + CAST(ticker AS INT) END"


@query(f"""WITH {PANEL}, s AS (SELECT *, {_SHARES} AS shares FROM panel), f AS (SELECT *, CASE WHEN CAST(ticker AS INT) % 2 = 0 THEN 0.5::DOUBLE * shares END AS ff FROM s)
SELECT date, ticker, round(short_positions / coalesce(ff, 0.75::DOUBLE * shares) * 100, 6) AS short_pct_free_float,
round(CASE WHEN count(volume / shares) OVER ({trail(20)}) >= 5 THEN avg(volume / shares) OVER ({trail(20)}) END, 6) AS turnover_pct, round(ln(shares * adj_close), 6) AS log_mktcap FROM f""")
def float_and_turnover(spark, d):
    n = F.col("ticker").cast("int")
    p = panel(spark, d).withColumn("shares_outstanding", F.when(n % 3 != 0, n + 1000.0))
    p = p.withColumns({"free_float": F.when(n % 2 == 0, F.col("shares_outstanding") * 0.5), "insider_share": F.lit(0.25), "mkt_cap": F.col("shares_outstanding") * F.col("adj_close")})
    return families.liquidity_family(families.short_family(p)).select("date", "ticker", "short_pct_free_float", "turnover_pct", "log_mktcap")


@query(f"""WITH {FILINGS}, c AS (SELECT *, CASE WHEN mkt_cap <= 500000 THEN mkt_cap END AS cap FROM filings)
SELECT 'mkt_cap' AS metric, round(avg((cap IS NULL)::INT), 6) AS value FROM c UNION ALL SELECT 'net_income', round(avg((net_income IS NULL)::INT), 6) FROM c""", dates="")
def capped_missing(spark, d):
    return agg.missing_share(clean.cap_large(filings(spark, d), most=500000.0), ["mkt_cap", "net_income"])


@query(f"""WITH {PANEL}, seen AS (SELECT ticker, mode(company) AS company, min(date) AS first_seen, max(date) AS last_seen, count(*) AS n_reports FROM panel GROUP BY ticker)
SELECT seen.*, CASE WHEN CAST(ticker AS INT) % 2 = 0 THEN n_name ELSE company END AS name FROM seen LEFT JOIN supplier ON CAST(s_suppkey AS VARCHAR) = ticker LEFT JOIN nation ON n_nationkey = s_nationkey""", dates="first_seen last_seen")
def universe_table(spark, d):
    s, n = read(spark, d, "supplier"), read(spark, d, "nation")
    named = F.when(F.col("s_suppkey") % 2 == 0, F.col("n_name")).otherwise(" ")
    profiles = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").cast("string").alias("ticker"), named.alias("name"))
    return universe.build_universe(panel(spark, d), profiles)


@query(f"""WITH {PANEL}, r AS (SELECT date, ticker, company, short_pct, volume, ({PCT.format(x="volume")} + {PCT.format(x="short_pct")}) / 2 AS consensus FROM panel WHERE date = (SELECT max(date) FROM panel)),
k AS (SELECT *, row_number() OVER (ORDER BY consensus DESC, ticker) AS rank FROM r) SELECT date, ticker, company, round(short_pct, 6) AS short_pct, round(volume, 6) AS volume, round(consensus, 6) AS consensus, rank::INT AS rank FROM k WHERE rank <= 10""")
def current_picks(spark, d):
    return reports.current_picks(panel(spark, d).select("date", "ticker", "company", "short_pct", "volume"), ["volume", "short_pct"])


_TAME = "series AS (SELECT date, (avg(short_pct) - 25) / 1000 AS r FROM panel GROUP BY date)"


@query(f"""WITH {PANEL}, {_TAME}, eq AS (SELECT date, r, product(1 + r) OVER (ORDER BY date) AS e FROM series), dd AS (SELECT *, e / max(e) OVER (ORDER BY date) - 1 AS dd FROM eq),
s AS (SELECT count(*) AS n, product(1 + r) AS total, min(dd) AS low FROM dd) SELECT n, round(total - 1, 6) AS total, round(total ** (52.0::DOUBLE / n) - 1, 6) AS cagr, round(low, 6) AS max_drawdown, round((total ** (52.0::DOUBLE / n) - 1) / abs(nullif(low, 0)), 6) AS calmar FROM s""", dates="")
def growth_ratios(spark, d):
    series = panel(spark, d).groupBy("date").agg(((F.avg("short_pct") - 25) / 1000).alias("ret"))
    return metrics.summary(series).select("n", "total", "cagr", "max_drawdown", "calmar")


@query(f"""WITH {PANEL}, {_TAME}, y AS (SELECT year(date) AS y, product(1 + r) - 1 AS r FROM series GROUP BY 1), span AS (SELECT unnest(range((SELECT min(y) FROM y), (SELECT max(y) + 1 FROM y))) AS y)
SELECT make_date(s.y, 12, 31) AS period, round(coalesce(r, 0.0), 6) AS ret FROM span s LEFT JOIN y ON y.y = s.y""", dates="period")
def annual_returns(spark, d):
    series = panel(spark, d).groupBy("date").agg(((F.avg("short_pct") - 25) / 1000).alias("ret"))
    return metrics.calendar_returns(series, "YY")


@query(f"""WITH {PANEL}, e AS (SELECT date, ticker, product(1 + (short_pct - 25) / 1100) OVER ({W} ROWS UNBOUNDED PRECEDING) AS equity FROM panel)
SELECT date, ticker, round(equity, 6) AS equity, round(equity / max(equity) OVER ({W} ROWS UNBOUNDED PRECEDING) - 1, 6) AS drawdown FROM e""")
def equity_by_ticker(spark, d):
    grown = panel(spark, d).select("date", "ticker", windows.running_product((F.col("short_pct") - 25) / 1100).alias("equity"))
    return grown.withColumn("drawdown", windows.drawdown(F.col("equity")))


@query(f"""WITH {PANEL}, {FWD}, e AS (SELECT date, count(fwd) AS n, list_distinct(quantile_cont(fwd, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1.0])) AS e FROM fw GROUP BY date)
SELECT f.date, f.ticker, (fwd < 0)::INT::DOUBLE AS y, (9 - CASE WHEN n >= 10 AND len(e) > 1 AND fwd IS NOT NULL THEN greatest(len(list_filter(e, lambda v: v < fwd)) - 1, 0) END)::DOUBLE AS relevance FROM fw f JOIN e ON e.date = f.date""")
def model_labels(spark, d):
    return scores.with_labels(xsection.with_decile_label(_fwd(spark, d), "fwd"), "fwd").select("date", "ticker", "y", "relevance")


@query(f"""WITH {PANEL}, {FWD}, e AS (SELECT list_distinct(quantile_cont(short_pct, [{", ".join(f"{i}.0::DOUBLE / 12" for i in range(13))}])) AS e FROM fw)
SELECT 'short' AS model, greatest(len(list_filter(e, lambda v: v < short_pct)) - 1, 0)::INT AS bucket, round(avg(fwd), 6) AS mean_target, count(*) AS n FROM fw, e WHERE fwd IS NOT NULL GROUP BY 2""", dates="")
def pooled_buckets(spark, d):
    return audit.pooled_bucket_means(_fwd(spark, d).select(F.lit("short").alias("model"), F.col("short_pct").alias("score"), F.col("fwd").alias("fwd_ret")))


_REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE")


@query(f"WITH {PANEL} SELECT date, ticker, " + ", ".join(f"coalesce(industry = '{r}', false)::TINYINT AS sec_{r}" for r in _REGIONS) + " FROM panel")
def group_dummies(spark, d):
    return xsection.one_hot(panel(spark, d), "industry", list(_REGIONS)).select("date", "ticker", *[f"sec_{r}" for r in _REGIONS])


@query(f"WITH {PANEL}, g AS (SELECT date, count(*) AS n FROM panel WHERE adj_close > 1000 GROUP BY date) SELECT date, n FROM g")
def fold_group_sizes(spark, d):
    return splits.group_sizes(panel(spark, d).where("adj_close > 1000"))


@query(f"WITH {PANEL} SELECT date, ticker, round(adj_close, 6) AS level, volume AS traded, round(short_pct, 6) AS si_level, short_positions AS held FROM panel")
def endpoint_columns(spark, d):
    """Two endpoints with a column of the same name: without prefixes the first one's keeps it, the other stays apart."""
    p = panel(spark, d)
    prices = build.prefixed(p.select("date", "ticker", F.col("adj_close").alias("level"), F.col("volume").alias("traded")), "px")
    shorts = build.prefixed(p.select("date", "ticker", F.col("short_pct").alias("level"), F.col("short_positions").alias("held")), "si")
    return build.unprefixed(prices.join(shorts, ["date", "ticker"]), ["px", "si"])


@query(f"""WITH {PANEL}, c AS (SELECT *, count(*) OVER (PARTITION BY date) AS n, count(DISTINCT sector) OVER (PARTITION BY date) + count(DISTINCT industry) OVER (PARTITION BY date) AS k, avg(ln(adj_close)) OVER (PARTITION BY date) AS m, avg(ln(adj_close)) OVER (PARTITION BY date, sector) AS ms FROM panel WHERE sector IS NOT NULL)
SELECT date, ticker, round(ln(adj_close) - CASE WHEN n <= k THEN m ELSE ms END, 6) AS residual FROM c""")
def nested_group_neutral(spark, d):
    """Sectors lie within industries, so that both sets of dummies leave the distance from the sector's mean."""
    rows = panel(spark, d).where("sector is not null").select("date", "ticker", F.ln("adj_close").alias("level"), "sector", "industry")
    return xsection.neutralize(rows, "level", ["sector", "industry"], name="residual").select("date", "ticker", "residual")


RANKED = f"""{FWD}, moved AS (SELECT *, adj_close / lag(adj_close, 4) OVER ({W}) - 1 AS mom FROM fw),
ranked AS (SELECT *, coalesce({PCT.format(x="short_pct")}, 0.5)::DOUBLE AS a, coalesce({PCT.format(x="mom")}, 0.5)::DOUBLE AS b, coalesce({PCT.format(x="volume")}, 0.5)::DOUBLE AS c, {PCT.format(x="short_pct")} AS naive FROM moved),
summed AS (SELECT *, (a + (1 - b)) / 2 AS mean_rk FROM ranked),
days AS (SELECT date, CASE WHEN row_number() OVER (ORDER BY date DESC) <= 36 THEN 'OOS' ELSE 'IS' END AS period FROM (SELECT DISTINCT date FROM panel)),
stacked AS (SELECT date, ticker, fwd, 'naive' AS model, naive AS score FROM summed UNION ALL SELECT date, ticker, fwd, 'ew', {PCT.format(x="mean_rk")} FROM summed),
stamped AS (SELECT s.*, period FROM stacked s JOIN days d ON d.date = s.date)"""


def _rank_ic_sql(source: str, keys: str) -> str:
    """Rank correlation of ``score`` and ``fwd`` by group."""
    place = lambda x: f"(rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0)::DOUBLE"
    return f"""placed AS (SELECT {keys}, {place("score")} AS u, {place("fwd")} AS v FROM {source} WHERE score IS NOT NULL AND fwd IS NOT NULL),
ics AS (SELECT {keys}, round(CASE WHEN count(*) > 1 AND min(u) < max(u) AND min(v) < max(v) THEN covar_pop(u, v) / (stddev_pop(u) * stddev_pop(v)) END, 12) AS ic FROM placed GROUP BY {keys})"""


_IC_STATS = "round(avg(ic), 6) AS mean, round(stddev_samp(ic), 6) AS std, round(avg(ic) / (nullif(stddev_samp(ic), 0) / sqrt(count(ic))), 6) AS t, round(avg((ic > 0)::INT), 6) AS hit, count(ic) AS n"


@query(f"""WITH {PANEL}, {RANKED}, long AS ({" UNION ALL ".join(f"SELECT date, '{n}_rk' AS factor, {x} AS score, fwd FROM summed" for n, x in (("short_pct", "a"), ("mom", "b"), ("volume", "c")))}), {_rank_ic_sql("long", "factor, date")},
stats AS (SELECT factor, {_IC_STATS} FROM ics WHERE ic IS NOT NULL GROUP BY factor)
SELECT *, CASE WHEN abs(coalesce(t, 0)) < 2 THEN 'WEAK' WHEN mean < 0 THEN 'KEEP' ELSE 'WRONG SIGN' END AS verdict FROM stats WHERE n >= 12""", dates="")
def factor_audit(spark, d):
    return audit.factor_audit(_features(spark, d), ["short_pct_rk", "mom_rk", "volume_rk"], "fwd")


def _scored(spark, d):
    f = scores.naive_score(scores.equal_weight(_features(spark, d), ["short_pct_rk", "mom_rk"], flip=("mom_rk",)))
    return splits.stamp_period(scores.stacked(f, ["naive", "ew"], "fwd"))


@query(f"""WITH {PANEL}, {RANKED}, twice AS (SELECT * FROM stamped UNION ALL SELECT * REPLACE ('ALL' AS period) FROM stamped), {_rank_ic_sql("twice", "model, period, date")},
ordered AS (SELECT *, row_number() OVER (PARTITION BY model, period, date ORDER BY score, ticker) AS r, count(*) OVER (PARTITION BY model, period, date) AS m FROM twice WHERE score IS NOT NULL AND fwd IS NOT NULL),
dealt AS (SELECT *, CASE WHEN r = 1 THEN 0 ELSE ceil((r - 1) * 10::DOUBLE / (m - 1)) - 1 END AS bucket FROM ordered),
spreads AS (SELECT model, period, date, CASE WHEN count(*) >= 10 THEN avg(fwd) FILTER (bucket = 9) - avg(fwd) FILTER (bucket = 0) END AS spread FROM dealt GROUP BY ALL)
SELECT i.model, i.period, mean, std, t, hit, n, mean_spread FROM (SELECT model, period, {_IC_STATS} FROM ics WHERE ic IS NOT NULL GROUP BY ALL) i JOIN (SELECT model, period, round(avg(spread), 6) AS mean_spread FROM spreads GROUP BY ALL) s ON s.model = i.model AND s.period = i.period""", dates="")
def model_metrics(spark, d):
    return audit.model_table(_scored(spark, d))


_TAILS = [(f"{side}_{round(t * 100)}", f"x > {t}::DOUBLE" if side == "up" else f"x < -({t}::DOUBLE)") for side in ("up", "down") for t in (0.1, 0.25, 0.5, 1.0)]


@query(f"""WITH {PANEL}, {RANKED}, placed AS (SELECT *, row_number() OVER (PARTITION BY model, date ORDER BY score DESC, ticker) AS r, count(*) OVER (PARTITION BY model, date) AS m FROM stamped WHERE score IS NOT NULL),
cuts AS (SELECT * FROM (VALUES ('top5', 5.0::DOUBLE, NULL::DOUBLE), ('top10', 10.0, NULL), ('top20', 20.0, NULL), ('decile', NULL, 0.1), ('quintile', NULL, 0.2)) AS v(bucket, most, share)),
picked AS (SELECT p.*, bucket, -fwd AS x FROM placed p JOIN cuts ON r <= coalesce(most, greatest(round_even(m * share, 0), 1))),
matched AS (SELECT DISTINCT date FROM stamped WHERE model = 'naive' AND period = 'IS' AND score IS NOT NULL),
every AS (SELECT * FROM picked UNION ALL SELECT * REPLACE ('ALL' AS period) FROM picked UNION ALL SELECT * REPLACE ('IS_matched' AS period) FROM picked WHERE period = 'IS' AND date IN (SELECT date FROM matched))
SELECT model, bucket, period, count(*) AS n, round(avg((x > 0)::INT), 6) AS win_rate, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max, count(*) FILTER (x > 0) AS wins, count(*) FILTER (x <= 0) AS losses,
round(avg(x) FILTER (x > 0), 6) AS mean_win, round(avg(x) FILTER (x <= 0), 6) AS mean_loss, round(median(x) FILTER (x > 0), 6) AS median_win, round(median(x) FILTER (x <= 0), 6) AS median_loss,
{", ".join(f"round(avg(({t})::INT), 6) AS {n}" for n, t in _TAILS)}, {", ".join(f"round(quantile_cont(x, {q}), 6) AS {n}" for n, q in (("p5", 0.05), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95)))},
round(avg(x) FILTER (x > 0) / nullif(abs(avg(x) FILTER (x <= 0)), 0), 6) AS win_loss_ratio FROM every WHERE x IS NOT NULL GROUP BY ALL""", dates="")
def signal_report(spark, d):
    return reports.signal_report(_scored(spark, d), "naive")


@query(f"""WITH {PANEL}, m AS (SELECT *, adj_close / lag(adj_close, 4) OVER ({W}) - 1 AS mom_1m, adj_close / lag(adj_close, 52) OVER ({W}) - 1 AS mom_12m FROM panel)
SELECT date, ticker, round(mom_1m, 6) AS mom_1m, round(mom_12m, 6) AS mom_12m, round({PCT.format(x='mom_1m')}, 6) AS mom_1m_rk, round({PCT.format(x='short_pct')}, 6) AS short_pct_rk FROM m""")
def refreshed_features(spark, d):
    """Features of the panel laid out by week, built up to its last eight weeks and then refreshed with these."""
    place = f"{shared_folder(spark)}/weekly-{uuid.uuid4().hex}"
    weeks, rows = f"{place}/panel", stored(panel(spark, d), "panel")
    cut = rows.agg(F.date_sub(F.max("date"), 56)).first()[0]
    for part in (F.col("date") <= cut, F.col("date") > cut):
        refresh.write_weeks(rows.where(part), weeks)
        refresh.refresh_features(spark, weeks, f"{place}/out", families=("price", "short"))
    return refresh.current_features(spark, f"{place}/out").select("date", "ticker", "mom_1m", "mom_12m", "mom_1m_rk", "short_pct_rk")


def _trained(spark, d):
    cols = ["short_pct_rk", "mom_rk", "volume_rk"]
    f = scores.with_labels(xsection.with_decile_label(_features(spark, d), "fwd"), "fwd")
    return stored(f.select("date", "ticker", *cols, "y", "relevance"), "model-rows"), cols


def _tasks(spark):
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@query()
def model_trees_importance(spark, d):
    """Gain, splits and mean absolute attribution of each factor of the boosted classifier, over all rows."""
    rows, cols = _trained(spark, d)
    model = scores.fit_trees(rows, cols)
    mean = attribution.mean_absolute(attribution.attributions(model, rows.select("date", "ticker", *cols), partitions=_tasks(spark)), cols)
    return boosting.importance_frame(spark, model).join(mean, "feature")


@query()
def model_tree_attributions(spark, d):
    """Attributions of every row's margin, with the margin's probability."""
    rows, cols = _trained(spark, d)
    model = scores.fit_trees(rows, cols)
    return attribution.attributions(model, model.score(rows.select("date", "ticker", *cols)), partitions=_tasks(spark)).drop(*cols)


@query()
def model_ranker_scores(spark, d):
    """Scores of all rows by the ranker that learns from the labelled ones."""
    rows, cols = _trained(spark, d)
    return scores.fit_ranker(rows.where("relevance IS NOT NULL"), cols).score(rows).select("date", "ticker", "score")


@query()
def model_inference(spark, d):
    rows, cols = _trained(spark, d)
    return spark.createDataFrame(scores.inference_table(rows, cols), "name string, coefficient double, std_error double, p double")


@query()
def sampled_tickers(spark, d):
    return agg.hash_sample(panel(spark, d), "ticker", 25)
