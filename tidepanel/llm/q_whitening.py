"""Query of the embedding whitening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepanel.llm.common import table
from tidepanel.llm.whitening import fit_whitening, whiten


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whiten(vectors, fit_whitening(vectors, components=4), components=4)


QUERIES = {"op12_embedding_whitening": op12_embedding_whitening}
SQL: dict[str, str] = {}
