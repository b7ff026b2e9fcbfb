"""Queries of the operators that use the public tokenizers: 2, 4 and 8."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidepanel.llm.common import table
from tidepanel.llm.packing import pack_documents
from tidepanel.llm.pieces import encode_documents
from tidepanel.llm.token_counts import token_counts


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), payload="digest")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    packed = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0, payload="crc32")
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "partition_bins", "partition_bound")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


QUERIES = {"op2_sentencepiece": op2_sentencepiece, "op4_best_fit_packing": op4_best_fit_packing, "op8_token_counts": op8_token_counts}
SQL: dict[str, str] = {}
