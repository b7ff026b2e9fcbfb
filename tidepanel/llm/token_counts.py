"""Operator 8: token counts of whole texts, lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.chunks import ChunkTable, collect, piece_chunks, piece_model, word_chunks
from tidepanel.llm.common import column_list, slices

#: Bytes of text that one round of encoding takes.
BATCH_BYTES = 2 << 20
_TABLES: dict[str, tuple] = {}


def drops_white_space(tokenizer_json: str) -> bool:
    """True if the tokenizer keeps only matches that hold no white space, so texts may be cut there."""
    import json

    pre = json.loads(tokenizer_json).get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    return first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and "[^\\s" in pattern


def counter(path: str) -> tuple:
    """(cut, table of lengths) for a vocabulary file; kept by the worker for later tasks."""
    if path not in _TABLES:
        if path.endswith(".model"):
            model, safe = piece_model(path)
            cut = piece_chunks if safe else lambda text: [text]
            table = ChunkTable(lambda chunks: list(map(len, model.encode(chunks, num_threads=1))))
        elif path.endswith(".json"):
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_padding()
            tokenizer.no_truncation()
            cut = word_chunks if drops_white_space(tokenizer.to_str()) else lambda text: [text]
            table = ChunkTable(lambda chunks: [len(e.ids) for e in tokenizer.encode_batch(chunks, add_special_tokens=False)])
        else:
            raise ValueError(f"no library for {path}")
        _TABLES[path] = (cut, table)
    return _TABLES[path]


def count_texts(texts: list[str | None], path: str) -> list[int]:
    cut, table = counter(path)
    return collect(texts, cut, table, sum, sum)


def token_counts(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Tokens of every whole text, without begin, end or added special tokens.

    Batches: an Arrow batch is cut into rounds of about ``BATCH_BYTES`` of text; within a round each
    text is split at safe boundaries and every distinct chunk goes to the library once, in calls of
    balanced bytes. Only lengths leave the worker. A text of any length passes through windows of
    bounded size. Ids repeated or null are counted row by row. A null or empty text has 0 bytes and
    0 tokens. An empty table gives an empty result. Other columns of ``docs`` are not read.

    Returns id, ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                counts = count_texts(column_list(batch, "text"), vocabulary)
                n_bytes = pc.binary_length(batch.column(1)).fill_null(0)
                yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes.cast(pa.int64()), pa.array(counts, pa.int64())], [id_col, "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
