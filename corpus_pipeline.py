"""A corpus pipeline: quality rules, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last
return the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidepanel.llm.common import materialize, ship_package, table
from tidepanel.llm.minhash import MinHashPlan, drop_near_duplicates
from tidepanel.llm.packing import pack_documents
from tidepanel.llm.quality import keep_good
from tidepanel.llm.toxicity import fit_toxicity, keep_civil

#: Five words, a similarity of 0.8 or more.
NEAR = MinHashPlan(shingle=5, percent=80)
#: Keys of chunks that a packing worker remembers: workers stay for a while after their stage and share the executor with the next.
TABLE_BYTES = 2 << 20
#: Bytes of the batches that go to Python, but for a row that is larger. Both sides of the pipe hold a batch or two for each task.
BATCH_BYTES = 4 << 20
#: No SQL expresses the trained classifier or the packing.
ORACLE_SQL = None


def prepare(spark: SparkSession) -> None:
    """Ship the package and, from now on in this session, send Python batches of at most about ``BATCH_BYTES``.

    A stage's result is computed after the stage has returned, so the setting stays. It changes no result.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts go."""
    return keep_good(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not called toxic; the model learns from labelled rows of ``docs`` in the training folds."""
    prepare(spark)
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return keep_civil(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates; one row of those equal in id and text."""
    prepare(spark)
    return drop_near_duplicates(docs, NEAR)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens."""
    prepare(spark)
    packed = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0, payload="crc32", table_bytes=TABLE_BYTES)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality_rules", quality_stage), ("toxicity", toxicity_stage), ("near_duplicates", near_duplicate_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
