"""The panel's roles played by the supplied tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.calendar import week_friday


#: Added before rounding, so that quotients that end in an exact half round alike in every engine.
TIE = 1e-8


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, sector, industry): a supplier's nation and region."""
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return joined.select(F.col("s_suppkey").cast("string").alias("ticker"), F.col("n_name").alias("sector"), F.col("r_name").alias("industry"), F.col("s_name").alias("company"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per Friday and supplier with shipments in its week."""
    li = read(spark, sf_dir, "lineitem").where(F.col("l_shipdate").isNotNull() & F.col("l_suppkey").isNotNull())
    q, sold = F.col("l_quantity"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0))
    weekly = li.groupBy(week_friday(F.col("l_shipdate")).alias("date"), F.col("l_suppkey").cast("string").alias("ticker")).agg(
        F.round(F.sum("l_extendedprice") / F.sum(q) + TIE, 6).alias("adj_close"), F.sum(q).alias("volume"), sold.alias("short_positions"), F.round(100 * sold / F.sum(q), 6).alias("short_pct")
    )
    return weekly.join(sectors(spark, sf_dir), "ticker", "left").select("date", "ticker", "adj_close", "volume", "short_positions", "short_pct", "sector", "industry", "company")


PANEL = """bars AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) + 4 AS date, CAST(l_suppkey AS VARCHAR) AS ticker,
  round(sum(l_extendedprice) / sum(l_quantity) + 1e-8, 6) AS adj_close, sum(l_quantity) AS volume,
  sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0 END) AS short_positions,
  round(100 * sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0 END) / sum(l_quantity), 6) AS short_pct
  FROM lineitem WHERE l_shipdate IS NOT NULL AND l_suppkey IS NOT NULL GROUP BY 1, 2),
panel AS (SELECT b.date, b.ticker, adj_close, volume, short_positions, short_pct, n_name AS sector, r_name AS industry, s_name AS company
  FROM bars b LEFT JOIN supplier ON CAST(s_suppkey AS VARCHAR) = b.ticker LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: (ticker, date, adj_close, volume)."""
    li = read(spark, sf_dir, "lineitem").where(F.col("l_shipdate").isNotNull())
    return li.groupBy(F.col("l_suppkey").cast("string").alias("ticker"), F.to_date("l_shipdate").alias("date")).agg(F.round(F.sum("l_extendedprice") / F.sum("l_quantity") + TIE, 6).alias("adj_close"), F.sum("l_quantity").alias("volume"))


DAILY = """daily AS (SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS date,
  round(sum(l_extendedprice) / sum(l_quantity) + 1e-8, 6) AS adj_close, sum(l_quantity) AS volume FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1, 2)"""


def filing_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filings: one per customer and day, accepted at the order's time, as sums from which the statement items follow."""
    o = read(spark, sf_dir, "orders").where(F.col("o_orderdate").isNotNull())
    price, closed = F.col("o_totalprice"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0)
    return o.groupBy(F.col("o_custkey").cast("string").alias("ticker"), F.col("o_orderdate").alias("accepted_date")).agg(
        F.sum(price).alias("revenue"), F.sum(closed).alias("_cash_in"), F.max(price).alias("_largest")
    )


def statement_items() -> dict[str, Column]:
    """Statement items of a row of ``filing_sums``."""
    r = F.col("revenue")
    return {
        "net_income": F.round(F.col("_cash_in") - 0.4 * r, 4), "total_equity": F.round(0.5 * r - 50000, 4), "total_assets": F.round(1.5 * r, 4), "total_debt": F.round(0.3 * r, 4),
        "cash": F.round(0.1 * r, 4), "operating_income": F.round(0.2 * r - 10000, 4), "gross_profit": F.round(0.45 * r, 4), "operating_cash_flow": F.round(0.25 * r, 4),
        "ebitda": F.round(0.22 * r - 10000, 4), "free_cash_flow": F.round(0.12 * r, 4), "interest_expense": F.round(-0.02 * r, 4), "current_assets": F.round(0.6 * r, 4),
        "current_liabilities": F.round(0.35 * r, 4), "mkt_cap": F.round(2.5 * F.col("_largest"), 4),
    }


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings with their statement items."""
    return filing_sums(spark, sf_dir).withColumns(statement_items()).drop("_cash_in", "_largest")


FILINGS = """filing_sums AS (SELECT CAST(o_custkey AS VARCHAR) AS ticker, o_orderdate AS accepted_date, sum(o_totalprice) AS revenue,
  sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0.0 END) AS cash_in, max(o_totalprice) AS largest FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1, 2),
filings AS (SELECT ticker, accepted_date, revenue, round(cash_in - 0.4::DOUBLE * revenue, 4) AS net_income, round(0.5::DOUBLE * revenue - 50000, 4) AS total_equity,
  round(1.5::DOUBLE * revenue, 4) AS total_assets, round(0.3::DOUBLE * revenue, 4) AS total_debt, round(0.1::DOUBLE * revenue, 4) AS cash, round(0.2::DOUBLE * revenue - 10000, 4) AS operating_income,
  round(0.45::DOUBLE * revenue, 4) AS gross_profit, round(0.25::DOUBLE * revenue, 4) AS operating_cash_flow, round(0.22::DOUBLE * revenue - 10000, 4) AS ebitda, round(0.12::DOUBLE * revenue, 4) AS free_cash_flow,
  round(-0.02::DOUBLE * revenue, 4) AS interest_expense, round(0.6::DOUBLE * revenue, 4) AS current_assets, round(0.35::DOUBLE * revenue, 4) AS current_liabilities, round(2.5::DOUBLE * largest, 4) AS mkt_cap FROM filing_sums)"""


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and dates and times as text, so that engines can be compared by value."""
    forms = {"date": "yyyy-MM-dd", "timestamp": "yyyy-MM-dd HH:mm:ss", "timestamp_ntz": "yyyy-MM-dd HH:mm:ss"}
    changed = {c: F.round(c, digits) for c, t in df.dtypes if t == "double"} | {c: F.date_format(c, forms[t]) for c, t in df.dtypes if t in forms}
    return df.withColumns(changed) if changed else df


def registrar(queries: dict, sql: dict):
    """A decorator that registers a query under its function's name, with its SQL if it has one.

    ``dates`` and ``times`` name the result's columns that become text on the SQL side.
    """

    def query(text: str | None = None, dates: str = "date", times: str = ""):
        def put(f):
            queries[f.__name__] = lambda spark, sf_dir: plain(f(spark, sf_dir))
            if text:
                shown = [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in dates.split()] + [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in times.split()]
                sql[f.__name__] = f"SELECT * REPLACE ({', '.join(shown)}) FROM (\n{text}\n) AS q" if shown else text
            return f

        return put

    return query
