from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidepanel.models.splits import walk_forward
from tidepanel.operators import asof
from tidepanel.operators.aggregates import lookahead_audit
from tidepanel.portfolio import backtest as bt
from tidepanel.portfolio import metrics

D = [date(2024, 1, 5) + timedelta(weeks=i) for i in range(4)]


def test_asof_tolerance_and_ties(spark):
    left = spark.createDataFrame([("A", date(2024, 1, 8)), ("A", date(2024, 1, 9)), ("B", date(2024, 1, 8)), (None, date(2024, 1, 8))], "k string, t date")
    right = spark.createDataFrame([("A", date(2024, 1, 1), 1.0), ("A", date(2024, 1, 1), 2.0), ("A", date(2024, 2, 1), 9.0)], "k string, u date, v double")
    got = {(r["k"], r["t"].day): r["v"] for r in asof.asof_join(left, right, "k", "t", "u", ["v"], tolerance_days=7).collect()}
    assert got == {("A", 8): 2.0, ("A", 9): None, ("B", 8): None, (None, 8): None}
    ahead = asof.asof_join(left, right, "k", "t", "u", ["v"], forward=True).where("k = 'A'").collect()
    assert {r["v"] for r in ahead} == {9.0}


def test_filing_is_visible_at_midnight_only(spark):
    left = spark.createDataFrame([("A", date(2024, 1, 8))], "k string, t date")
    right = spark.createDataFrame([("A", datetime(2024, 1, 8, 9), 1.0)], "k string, u timestamp, v double")
    assert asof.asof_join(left, right, "k", "t", "u", ["v"]).first()["v"] is None


def test_forward_labels_end_in_nulls(spark):
    rows = [("A", D[0] + timedelta(weeks=i), float(i + 1)) for i in range(12)]
    p = spark.createDataFrame(rows, "ticker string, date date, adj_close double")
    got = [r["fwd_ret_1m"] for r in asof.forward_returns(p, p, [4]).orderBy("date").collect()]
    # the fourth row from the end may use the last price within the tolerance of seven days
    assert got[0] == 4.0 and got[-3:] == [None] * 3 and 0.0 not in got


def test_membership_replays_backwards(spark):
    log = spark.createDataFrame([("X", D[2], "added"), ("Y", D[1], "removed"), ("Z", D[2], "added"), ("Z", D[2], "removed")], "symbol string, date date, op string")
    now = spark.createDataFrame([("X",), ("W",)], "symbol string")
    dates = spark.createDataFrame([(D[0],), (D[3],)], "date date")
    got = {(r["date"], r["symbol"]) for r in asof.membership(log, now, dates).collect()}
    assert got == {(D[0], "W"), (D[0], "Y"), (D[0], "Z"), (D[3], "W"), (D[3], "X")}


def test_lookahead_audit(spark):
    df = spark.createDataFrame([(30,), (-3,), (-15,), (None,)], "filing_lag_days int")
    assert tuple(lookahead_audit(df).first()) == (3, 2, 15)


def book(spark):
    w = {"AAA": 0.5, "BBB": -0.5, "CCC": 0.0}
    rows = [(d, t, x) for d in D for t, x in w.items()]
    px = [(d, t, f(i)) for i, d in enumerate(D) for t, f in (("AAA", lambda i: 100 * 1.1**i), ("BBB", lambda i: 100 * 0.95**i), ("CCC", lambda i: 100.0))]
    return spark.createDataFrame(rows, "date date, ticker string, weight double"), spark.createDataFrame(px, "date date, ticker string, adj_close double")


def test_hand_computed_book(spark):
    weights, prices = book(spark)
    rows = bt.backtest(weights, prices, bt.Costs(commission_bps=100, slippage_bps=50, borrow_rate=0.052)).orderBy("date").collect()
    assert len(rows) == 3
    assert all(r["ret_gross"] == pytest.approx(0.075) for r in rows)
    assert [r["turnover"] for r in rows] == [0.5, 0.0, 0.0]
    assert (rows[0]["commission"], rows[0]["slippage"]) == (pytest.approx(0.01), pytest.approx(0.005))
    assert all(r["borrow"] == pytest.approx(0.0005) and r["n_positions"] == 2 and r["gross_exposure"] == 1.0 and r["net_exposure"] == 0.0 for r in rows)
    both = bt.backtest(weights, prices, bt.Costs(borrow_rate=0.052, borrow_longs=True)).first()
    assert both["borrow"] == pytest.approx(0.001)
    assert bt.trade_log(weights).count() == 2


def test_hard_stop(spark):
    prices = spark.createDataFrame([("A", D[0] + timedelta(weeks=i), v) for i, v in enumerate([100.0, 105.0, 111.0, 90.0, 95.0, 99.0])], "ticker string, date date, adj_close double")
    rows = bt.hard_stop(prices).orderBy("entry_date").collect()
    assert len(rows) == 2 and rows[0]["stopped"] and rows[0]["pnl"] == pytest.approx(-0.1) and not rows[1]["stopped"]


def test_empty_month_is_zero(spark):
    r = spark.createDataFrame([(date(2024, 1, 5), 0.1), (date(2024, 3, 8), 0.2)], "date date, ret double")
    assert [round(x["ret"], 9) for x in metrics.calendar_returns(r).orderBy("period").collect()] == [0.1, 0.0, 0.2]


def test_folds_keep_the_embargo():
    folds = walk_forward(date(2020, 1, 3), date(2024, 1, 5))
    assert folds and all((f.test_start - f.train_end).days == 29 for f in folds)
    assert folds[-1].test_end <= date(2024, 1, 5)


def test_no_reentry_sees_the_whole_universe(spark, monkeypatch):
    from tidepanel.plans import report_queries as rq

    # scores persist, so the best tickers stay open; every seventh row is missing and T09 trades rarely, so exits lie far ahead
    weeks = [date(2024, 1, 5) + timedelta(weeks=i) for i in range(16)]
    rows = [(d, f"T{t:02d}", 10.0 + (i * 7 + t * 3) % 5 * 0.2, 90.0 - t // 2) for i, d in enumerate(weeks) for t in range(90) if (i + t) % 7 and (t != 9 or i % 3 == 0)]
    prices = spark.createDataFrame(rows, "date date, ticker string, adj_close double, short_pct double")
    monkeypatch.setattr(rq, "panel", lambda spark, d: prices)
    score = {(r[0], r[1]): r[3] for r in rows}
    week_trades = {}
    for r in bt.hard_stop(prices, 4, 0.1).collect():
        week_trades.setdefault(r["entry_date"], []).append((-score[r["entry_date"], r["ticker"]], r["ticker"], r["exit_date"]))
    open_until, want = {}, []
    for day in sorted(week_trades):
        free = [x for x in sorted(week_trades[day]) if open_until.get(x[1], day) <= day][:15]
        open_until |= {t: e for _, t, e in free}
        want += [(day, t, e) for _, t, e in free]
    got = sorted((r["entry_date"], r["ticker"], r["exit_date"]) for r in rq.no_reentry_trades(spark, "").collect())
    assert got == sorted(want)
    assert rq.capital_timeline(spark, "").agg(F.sum("opened")).first()[0] == len(want)
    # few candidates and a small k
    few = bt.hard_stop(prices.where("ticker < 'T12'"), 4, 0.1).withColumn("score", -F.substring("ticker", 2, 2).cast("double"))
    assert bt.in_reach(few, 1).count() < few.count()
    cut = {tuple(r) for r in bt.no_reentry(few, 1).select("entry_date", "ticker").collect()}
    open_until, all_rows = {}, {}
    for r in few.collect():
        all_rows.setdefault(r["entry_date"], []).append((-r["score"], r["ticker"], r["exit_date"]))
    for day in sorted(all_rows):
        first = next(x for x in sorted(all_rows[day]) if open_until.get(x[1], day) <= day)
        open_until[first[1]] = first[2]
        assert (day, first[1]) in cut


def test_walk_forward_refuses_bad_spans():
    from datetime import date

    from tidepanel.models.splits import walk_forward

    for spans in ({"test_weeks": 0}, {"step_weeks": 0}, {"min_train_weeks": -1}, {"embargo_weeks": -1}):
        with pytest.raises(ValueError):
            walk_forward(date(2020, 1, 3), date(2024, 1, 5), **spans)
    assert walk_forward(date(2020, 1, 3), date(2024, 1, 5), step_weeks=13)


def test_of_several_closes_the_last_counts(spark):
    from tidepanel.portfolio.backtest import period_returns

    rows = [("A", "2024-01-05", 10.0, 1), ("A", "2024-01-12", 30.0, 2), ("A", "2024-01-12", 20.0, 3)]
    prices = spark.createDataFrame(rows, "ticker string, date string, adj_close double, row int").selectExpr("ticker", "date(date) date", "adj_close", "row")
    dates = prices.select("date").distinct()
    assert {r["ret"] for r in period_returns(prices, dates, "row").collect()} == {1.0, None}
    assert {r["ret"] for r in period_returns(prices, dates).collect()} == {2.0, None}


def test_look_ahead_stops_the_feature_build(spark):
    from tidepanel.features.build import checked_features

    panel = spark.createDataFrame([("A", 3), ("B", -8)], "ticker string, filing_lag_days int")
    with pytest.raises(ValueError, match="1 of 2 rows.*8 days"):
        checked_features(panel)
