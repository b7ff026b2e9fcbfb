"""Files: Parquet, CSV, JSON payloads, text lists, report documents, Markdown."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.nulls import scrub


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return scrub(spark.read.parquet(path))


def write_parquet(df: DataFrame, path: str, *, by: list[str] | None = None) -> None:
    """Snappy Parquet, replaced as a whole; ``by`` lays out partitions that later filters can skip."""
    writer = df.write.mode("overwrite").option("compression", "snappy")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_tables(tables: dict[str, DataFrame], root: str) -> list[str]:
    """One Parquet folder for each table that has rows."""
    names = [n for n, t in tables.items() if not t.isEmpty()]
    for n in names:
        write_parquet(tables[n], f"{root}/{n}")
    return names


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Raw payloads, one JSON document a file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Files with headers, as many as ``df`` has partitions; they read back as one table."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_list(spark: SparkSession, path: str, name: str = "ticker") -> DataFrame:
    """A text file with one entry a line."""
    return spark.read.text(path).select(F.trim("value").alias(name)).where(f"{name} <> ''").distinct()


def price_rows(payload: DataFrame, symbol: str, price: str = "adjClose") -> DataFrame:
    """(symbol, date, adj_close, volume) of a payload; junk dates go, junk numbers are null."""
    return payload.select(F.lit(symbol).alias("symbol"), F.col("date").try_cast("date").alias("date"), F.col(price).try_cast("double").alias("adj_close"), (F.col("volume").try_cast("bigint") if "volume" in payload.columns else F.lit(None).cast("bigint")).alias("volume")).where("date is not null")


def coerce_dates(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.try_to_timestamp(F.col(c).cast("string")) for c in cols})


def report_documents(spark: SparkSession, path: str, parse: Callable[[bytes], pd.DataFrame], schema: str) -> DataFrame:
    """Tables that ``parse`` finds in landed report documents, with their paths; no parser is bundled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for place, content in zip(batch["path"], batch["content"], strict=True):
                yield parse(content).assign(path=place)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"{schema}, path string")


def markdown(df: DataFrame, digits: int = 4, rows: int = 1000) -> str:
    """A small result as a Markdown table; where there are more than ``rows`` rows, a last line says how many are left out."""
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    found = df.limit(rows + 1).collect()
    lines += ["| " + " | ".join(show(v) for v in r) + " |" for r in found[:rows]]
    if len(found) > rows:
        lines.append(f"\n{df.count() - rows} more rows are not shown.")
    return "\n".join(lines)
