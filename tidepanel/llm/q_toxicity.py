"""Query of the toxicity operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.common import table
from tidepanel.llm.toxicity import fit_toxicity, score_toxicity


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


QUERIES = {"op3_toxicity": op3_toxicity}
SQL: dict[str, str] = {}
