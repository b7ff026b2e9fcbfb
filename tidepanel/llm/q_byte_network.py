"""Query of the quality classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepanel.llm.byte_network import fit_quality, fold_of, score_quality
from tidepanel.llm.common import table


def op13_byte_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit_quality(docs, table(spark, sf_dir, "labels"), folds=4, held=2)
    return score_quality(docs, net, threshold=0.7).select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


QUERIES = {"op13_byte_quality": op13_byte_quality}
SQL: dict[str, str] = {}
