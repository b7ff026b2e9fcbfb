"""Operator 1: stupid-backoff scores of documents, from n-gram counts of the corpus.

The relations are held in blocks, so that neither n-grams nor counts travel as single rows:

* documents are dealt to blocks by a hash of id and text, so that rows without an id spread; a block's distinct n-grams, with their
  counts in the block, leave it as one row for each hash partition (*exploded n-grams*),
* the rows of a hash partition form its *count table*: equal n-grams of all blocks are added up,
* the table is joined back to the rows it came from: each gets the totals of its n-grams, in their
  order, so that keys need not travel twice,
* a block's documents are joined with its totals; each n-gram is scored and summed per document.

A frequent n-gram leaves a block once, however often it occurs there, so no partition is hot. What is
gathered grows with the corpus; nothing is collected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import block_plan, parts_for, text_bytes

#: Bytes of text of a block, and of the corpus for one hash partition of the counts.
BLOCK_BYTES = 12 << 20
TABLE_BYTES = 16 << 20
BACKOFF = 0.4

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(text: str | None, order: int) -> list[np.ndarray]:
    """64-bit fingerprints of the 1- to ``order``-grams of a text, in order of their last words.

    Words stand between ASCII white space, A-Z lower-cased. Item n holds the (n + 1)-grams; entry i of
    it ends with word i + n.
    """
    from xxhash import xxh3_64_intdigest

    words = text.encode().lower().split() if text else []
    out = [np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))]
    for n in range(1, order):
        out.append(_mixed(out[-1][:-1] * _ODD + out[0][n:] + np.uint64(n)))
    return out


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte plane by byte plane, so that the high zero bytes compress away."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _distinct(texts, order: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct n-grams in order, with their counts in it."""
    return np.unique(np.concatenate([np.concatenate(grams(t, order)) for t in texts]), return_counts=True)


def _block_grams(order: int, parts: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _distinct(block["text"], order)
        # partitions are ranges of the hash, so that a block's rows in order of partition are in order of key
        part = (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        found, starts = np.unique(part, return_index=True)
        split = lambda a: np.split(a, starts[1:]) if len(found) else []
        return pd.DataFrame({
            "part": found.astype(np.int64),
            "block": int(block["block"].iloc[0]),
            "keys": [packed_keys(k) for k in split(keys)],
            "counts": [c.astype("<u4").tobytes() for c in split(counts)],
        })

    return run


def _table_totals(rows: pd.DataFrame) -> pd.DataFrame:
    """Add up a hash partition's counts and give each block the totals of its own n-grams, in their order."""
    keys = [unpacked_keys(k) for k in rows["keys"]]
    counts = np.concatenate([np.frombuffer(c, "<u4") for c in rows["counts"]])
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.zeros(len(distinct), np.int64)
    np.add.at(totals, place, counts)
    ends = np.cumsum([len(k) for k in keys])[:-1]
    planes = lambda t: np.ascontiguousarray(t).view(np.uint8).reshape(-1, 8).T.tobytes()
    return pd.DataFrame({"block": rows["block"], "part": rows["part"], "totals": [planes(t) for t in np.split(totals[place], ends)]})


def _score_block(order: int, backoff: float, corpus_words: int):
    def run(docs: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        keys, _ = _distinct(docs["text"], order)
        held_by_part = totals.sort_values("part")["totals"]
        counts = np.concatenate([np.empty(0, np.int64), *[np.ascontiguousarray(np.frombuffer(t, np.uint8).reshape(8, -1).T).view(np.int64).ravel() for t in held_by_part]])
        if len(keys) != len(counts):
            raise ValueError("the totals of a block do not match its n-grams")
        scores, lengths = [], []
        for text in docs["text"]:
            own = grams(text, order)
            n = len(own[0])
            lengths.append(n)
            if not n:
                scores.append(0.0)
                continue
            # counts in all other documents: the corpus less this text
            held = []
            for g in own:
                distinct, place, here = np.unique(g, return_inverse=True, return_counts=True)
                held.append((counts[np.searchsorted(keys, distinct)] - here)[place])
            rest = corpus_words - n
            # add-one for words that no other document has
            score = np.log((held[0] + 1) / (rest + 1))
            for k in range(1, order):
                longer, context = held[k], held[k - 1][: n - k]
                seen = longer > 0
                backed = score[k:] + np.log(backoff)
                score[k:] = np.where(seen, np.log(np.maximum(longer, 1) / np.maximum(context, 1)), backed)
            scores.append(float(score.sum()))
        return pd.DataFrame({"id": docs["id"], "n_words": lengths, "log_score": scores})

    return run


def backoff_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = 2, backoff: float = BACKOFF) -> DataFrame:
    """id, ``n_words``, ``log_score`` (sum of natural logs) and ``mean_log_score`` of every whole text.

    The score of a word after its context is count(context, word) / count(context) if that n-gram
    occurs outside the document, otherwise ``backoff`` times the score with a context one word shorter;
    the shortest score is (count(word) + 1) / (words + 1). All counts are those of the corpus without
    the document itself, so a document does not vouch for itself. The first words of a text have as much
    context as there is.

    Null and empty texts have no words, a score of 0 and a null mean. Rows that repeat an id are
    documents of their own, and vouch for each other. An empty table gives an empty result. Long texts are
    scored whole; a block holds one text at least, and rows equal in id and text share one. Other columns
    are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    total = text_bytes(source, "text")
    (blocks, partitions), parts = block_plan(total, BLOCK_BYTES, BLOCK_BYTES), parts_for(total, TABLE_BYTES)
    words = source.select(F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long").alias("n")).agg(F.sum("n").alias("n")).first()["n"] or 0
    # both branches read this exchange; it is written once
    dealt = source.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks))).repartition(partitions, "block")
    exploded = dealt.groupBy("block").applyInPandas(_block_grams(order, parts), "part long, block long, keys binary, counts binary")
    joined = exploded.groupBy("part").applyInPandas(_table_totals, "block long, part long, totals binary")
    scored = dealt.groupBy("block").cogroup(joined.groupBy("block")).applyInPandas(_score_block(order, backoff, words), f"id {kind}, n_words long, log_score double")
    return scored.select(F.col("id").alias(id_col), "n_words", "log_score", F.try_divide("log_score", "n_words").alias("mean_log_score"))
