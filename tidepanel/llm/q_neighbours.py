"""Query of the nearest-neighbour search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepanel.llm.common import table
from tidepanel.llm.permutation_index import search


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


QUERIES = {"op6_permutation_index": op6_permutation_index}
SQL: dict[str, str] = {}
