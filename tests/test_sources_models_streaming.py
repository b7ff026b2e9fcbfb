import json
from datetime import date, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.features.build import build_features, rankable, unprefixed
from tidepanel.functions.text import header_map, normal_report
from tidepanel.models import scores
from tidepanel.models.splits import walk_forward
from tidepanel.panel.assemble import assemble
from tidepanel.panel.clean import conservative_clean
from tidepanel.sources import files
from tidepanel.sources.rest import RestReader, TransientError, with_retries
from tidepanel.streaming.panel import sessions, windowed_bars

D = date(2024, 1, 5)


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("A", 1.0), ("B", float("nan"))], "ticker string, x double")
    files.write_parquet(df, f"{tmp_path}/p")
    assert {r["x"] for r in files.read_parquet(spark, f"{tmp_path}/p").collect()} == {1.0, None}
    assert files.write_tables({"a": df, "b": df.limit(0)}, f"{tmp_path}/t") == ["a"]
    files.write_csv(df, f"{tmp_path}/c")
    (tmp_path / "l.txt").write_text("A\n\nB\nA\n")
    assert files.read_list(spark, f"{tmp_path}/l.txt").count() == 2
    assert "| A | 1.0000 |" in files.markdown(df) and "more rows" not in files.markdown(df)
    assert files.markdown(df, rows=1).endswith("1 more rows are not shown.")
    (tmp_path / "r.bin").write_bytes(b"x")
    got = files.report_documents(spark, f"{tmp_path}/r.bin", lambda b: pd.DataFrame({"n": [len(b)]}), "n long").first()
    assert got["n"] == 1


def test_report_headers_drift(spark):
    assert header_map(["Product", "Product Code", "Reported Short Positions", "Total Product in Issue", "% of Total Product in Issue"])["Product Code"] == "ticker"
    raw = spark.createDataFrame([("Foo ORDINARY", "FOO", "1,234", "junk", "1.5"), ("x", "not a code", "1", "1", "1")], ["Product", "Product Code", "Reported Short Positions", "Total Product in Issue", "% of Total"])
    rows = normal_report(raw).collect()
    assert len(rows) == 1 and rows[0]["short_positions"] == 1234 and rows[0]["total_volume"] is None


def test_rest_reader_retries():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise TransientError
        return "ok"

    assert with_retries(flaky, wait_s=0) == "ok"
    reader = RestReader({"endpoint": "e", "fetch": "builtins:sorted", "symbols": "A,B"})
    assert [p.value for p in reader.partitions()] == [(["A"], 0.0), (["B"], 0.0)]
    assert json.dumps({"a": 1})


def test_panel_uses_only_what_was_known(spark):
    reports = spark.createDataFrame([(D, D + timedelta(days=6), "A", 5.0)], "date date, release_date date, ticker string, short_pct double")
    prices = spark.createDataFrame([("A", D + timedelta(days=i), 10.0 + i) for i in range(0, 60)], "symbol string, date date, adj_close double")
    income = spark.sql("SELECT 'A' symbol, date'2023-12-31' date, timestamp'2024-01-10 10:00:00' accepted_date, '2023' fiscal_year, 'Q4' period, 7.0D net_income, 1e8D shares UNION ALL SELECT 'A', date'2024-01-31', timestamp'2024-01-20 10:00:00', '2024', 'Q1', 9.0D, 1e8D")
    r = assemble(reports, prices, income).first()
    assert r["date"] == D + timedelta(days=6) and r["as_of_date"] == D
    assert r["adj_close"] == 16.0 and r["fiscal_year"] == "2023" and r["income_net_income"] == 7.0
    assert r["filing_lag_days"] == 0 and r["investable"] and r["fwd_ret_1w"] == pytest.approx(7 / 16)
    cleaned = conservative_clean(assemble(reports, prices, income), spark.createDataFrame([(r["date"], "A")], "date date, ticker string")).first()
    assert cleaned["adj_close"] is None and cleaned["fwd_ret_1w"] is not None and not cleaned["investable"]


def test_builder_ranks_factors_only(spark):
    df = spark.createDataFrame([(D, f"T{i}", float(i), float(i), 1.0, 0.1) for i in range(4)], "date date, ticker string, short_pct double, adj_close double, volume double, fwd_ret_1m double")
    assert rankable(df) == ["short_pct"]
    out = build_features(df.withColumns({"short_positions": F.lit(1.0), "sector": F.lit("X")}), families=("short",), sectors=["X", "Y"])
    assert "short_pct_rk" in out.columns and "fwd_ret_1m_rk" not in out.columns and out.first()["sec_X"] == 1
    both = unprefixed(df.select(F.lit(1).alias("income_a"), F.lit(2).alias("cash_a")), ["income", "cash"])
    assert both.columns == ["a", "cash_a"]


def test_logit_orders_and_folds_fit(spark):
    rows = [(D + timedelta(weeks=w), f"T{i}", i / 20, float(i + w % 3 > 10)) for w in range(60) for i in range(20)]
    df = spark.createDataFrame(rows, "date date, ticker string, x double, y double")
    folds = walk_forward(D, D + timedelta(weeks=59), min_train_weeks=20, test_weeks=20)
    got = scores.fit_predict(df, folds, ["x"], "y", scores.fit_logit)
    assert got.where("score is null").count() == 0
    means = {r["y"]: r["s"] for r in got.groupBy("y").agg(F.avg("score").alias("s")).collect()}
    assert means[1.0] > 0.7 > 0.3 > means[0.0]
    with pytest.raises(ValueError):
        scores.fit_logit(df.where("y = 1"), ["x"])


def test_streams_equal_batches(spark, tmp_path):
    sql = "SELECT 1L user_id, timestamp'2024-01-01 01:00:00' ts, 2.0D value UNION ALL SELECT 1L, timestamp'2024-01-01 02:00:00', 3.0D UNION ALL SELECT 1L, timestamp'2024-01-05 00:00:00', 4.0D"
    events = spark.sql(sql)
    events.write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    q = windowed_bars(stream).writeStream.format("memory").queryName("bars").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination(60)
    assert {(r["n"], r["total"]) for r in spark.table("bars").collect()} == {(2, 5.0), (1, 4.0)}
    assert sessions(events).count() == 2
