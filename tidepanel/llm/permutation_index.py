"""Operator 6: nearest neighbours by a permutation index.

Each vector is represented by its nearest pivots in order. An index block posts a vector in the inverted
files of these pivots only, with its place in each. A query reads the files of its own nearest pivots,
adds up how little the places differ (the footrule distance, over the pivots both have), and ranks the
best share of the block again by the exact measure.

Blocks are built once and written to the shared folder. A block with one block of queries is one unit
of work, so no task holds more than one of each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import discard, materialize, parts_for

#: Pivots, from a sample of twice as many distinct vectors, by a hash of the vector. They bound the model.
PIVOTS = 1_024
#: Pivots whose files a vector is posted in, and whose files a query reads.
POSTED = 64
#: Sampled vectors with a larger cosine to an earlier one become no pivots, so that a crowd takes few of them.
APART = 0.8
#: Share of a block that is ranked by the exact measure, and vectors of it at least.
SHARE = 0.1
LEAST = 512
#: Deviations added to a cosine that footrule estimates, so that a long vector is not passed over.
HOPE = 2.0
#: Distinct vectors of an index block (under 2**16), and queries of a query block.
INDEX_BLOCK = 16_384
QUERY_BLOCK = 4_096


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors without those that are null, empty, zero or not finite, or lack an id."""
    kind = dict(vectors.dtypes)[vector_col]
    v = F.col(vector_col).cast(kind if kind in ("array<float>", "array<double>") else "array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False))).select(F.col(id_col).alias("id"), v.alias("v"))


def dense(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of a matrix; short lists are followed by zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), dtype=flat.dtype)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


@dataclass
class Pivots:
    """Unit vectors, and the line that gives a cosine from a footrule sum: slope, value at 0, deviation."""

    vectors: np.ndarray
    posted: int
    slope: float = 1.0
    base: float = 0.0
    spread: float = 0.0

    def order(self, vectors: np.ndarray) -> np.ndarray:
        """For each vector its ``posted`` nearest pivots (largest inner product), nearest first."""
        sims = vectors.astype(np.float64) @ self.vectors.T
        best = np.argpartition(-sims, self.posted - 1, axis=1)[:, : self.posted]
        return np.take_along_axis(best, np.argsort(-np.take_along_axis(sims, best, axis=1), axis=1, kind="stable"), axis=1)


class InvertedFiles:
    """For each pivot the rows that are posted in its file and their places."""

    def __init__(self, starts: np.ndarray, rows: np.ndarray, places: np.ndarray, n: int):
        self.starts, self.rows, self.places, self.n = starts, rows, places, n

    @classmethod
    def of(cls, order: np.ndarray, pivots: int) -> InvertedFiles:
        n, m = order.shape
        flat = order.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        starts = np.searchsorted(flat[by_pivot], np.arange(pivots + 1)).astype(np.int32)
        return cls(starts, (by_pivot // m).astype(np.uint16), (by_pivot % m).astype(np.uint8), n)

    def sums(self, order: np.ndarray) -> np.ndarray:
        """For every row the sum over shared pivots of ``m`` less the difference of places; 0: in no file read.

        The largest sum is the smallest footrule distance, with pivots that only one side has at distance m.
        """
        m = len(order)
        total = np.zeros(self.n, dtype=np.int32)
        for place, pivot in enumerate(order.tolist()):
            part = slice(self.starts[pivot], self.starts[pivot + 1])
            total[self.rows[part]] += m - np.abs(self.places[part].astype(np.int32) - place)
        return total


def choose_pivots(sample: np.ndarray, pivots: int, posted: int) -> Pivots:
    """Pivots from a sample, and the calibration of footrule sums on the sample itself."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    close = unit @ unit.T
    chosen = unit[~(np.triu(close > APART, 1).any(axis=0))][:pivots]
    out = Pivots(chosen, min(posted, len(chosen)))
    order = out.order(unit)
    files = InvertedFiles.of(order, len(chosen))
    asked = range(0, len(unit), max(1, len(unit) // 128))
    x = np.concatenate([files.sums(order[i]) for i in asked]).astype(float)
    y = np.concatenate([close[i] for i in asked])
    other = y < 1 - 1e-9
    x, y = x[other], y[other]
    if len(x) > 1 and x.std() > 0:
        out.slope = max(float(((x - x.mean()) * (y - y.mean())).mean() / x.var()), 1e-9)
        out.base = float(y.mean() - out.slope * x.mean())
        out.spread = float((y - out.base - out.slope * x).std())
    return out


def search(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, pivots: int = PIVOTS, posted: int = POSTED, share: float = SHARE, least: int = LEAST, index_block: int = INDEX_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` nearest found of each query: query_id, rank (from 1), id, score (inner product).

    Candidates are all vectors but the query's own row (its id). Ties go to the smaller id. Vectors that
    are null, zero or hold null or non-finite components take no part, nor do rows without an id. A vector
    shorter than another counts as followed by zeros. Equal vectors are indexed once with their ``k + 1``
    smallest ids, as no other can be among the nearest. Every vector is indexed; only the pivots are a
    sample. Where a query's files hold fewer than ``least`` vectors of a block, others fill up, so no
    query gets fewer than ``k`` rows while there are candidates. Rows that repeat an id are
    candidates once for each vector that differs; a query id that repeats is answered once. An empty table
    gives an empty result.

    The exact ranking takes ``share`` of a block, so work grows with queries times vectors, at the cost of
    ``posted ** 2 / pivots`` additions and ``share`` inner products for a pair of them.
    """
    spark = vectors.sparkSession
    id_type = dict(vectors.dtypes)[id_col]
    schema = f"query_id {id_type}, rank int, `{id_col}` {id_type}, score double"
    base = usable(vectors, id_col, vector_col)
    # the smallest ids of each distinct vector: limited before and behind one exchange
    each = Window.partitionBy("h", "v").orderBy("id")
    first = base.withColumn("h", F.xxhash64("v")).withColumn("r", F.dense_rank().over(each)).where(F.col("r") <= k + 1)
    classes = materialize(first.groupBy("h", "v").agg(F.array_sort(F.collect_set("id")).alias("ids")), "vectors")
    row = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    if not row["n"]:
        return spark.createDataFrame([], schema)
    width = row["width"]
    # in the order of a hash, which is that of no property of the vectors
    sample = classes.orderBy("h", "v").limit(2 * pivots).select("v").toArrow()
    model = choose_pivots(dense(sample.column("v"), width).astype(np.float64), pivots, posted)
    blocks = parts_for(row["n"], index_block)
    index = classes.select(F.pmod("h", F.lit(blocks)).alias("block"), "v", "ids").groupBy("block").applyInArrow(_build(model, width), f"block long, n long, starts binary, rows binary, places binary, vectors binary, sizes binary, ids array<{id_type}>")
    index = materialize(index, "permutation-index")
    discard(classes)
    asked = materialize(usable(queries, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v")), "queries")
    q_blocks = parts_for(max(asked.count(), 1), query_block)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = index.withColumn("q_block", every(q_blocks))
    right = asked.withColumn("q_block", F.pmod(F.xxhash64("id"), F.lit(q_blocks))).groupBy("q_block").agg(F.collect_list(F.struct("id", "v")).alias("asked")).withColumn("block", every(blocks))
    found = left.groupBy("block", "q_block").cogroup(right.groupBy("block", "q_block")).applyInArrow(_search_pair(model, width, share, max(least, k + 1), k), f"query_id {id_type}, id {id_type}, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def _build(model: Pivots, width: int):
    def run(block: pa.Table) -> pa.Table:
        v = dense(block.column("v"), width)
        files = InvertedFiles.of(model.order(v), len(model.vectors))
        ids = block.column("ids").combine_chunks()
        parts = (files.starts, files.rows, files.places, v, np.diff(ids.offsets.to_numpy()).astype(np.int32))
        held = [pa.array([x.tobytes()], pa.binary()) for x in parts]
        return pa.Table.from_arrays([block.column("block").combine_chunks()[:1], pa.array([len(v)], pa.int64()), *held, pa.ListArray.from_arrays(pa.array([0, len(ids.flatten())], pa.int32()), ids.flatten())], ["block", "n", "starts", "rows", "places", "vectors", "sizes", "ids"])

    return run


def _search_pair(model: Pivots, width: int, share: float, least: int, k: int):
    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        form = index.schema.field("ids").type.value_type
        out_q, out_id, out_score = [], [], []
        for at in range(index.num_rows * asked.num_rows and 1):
            read = lambda c, kind: np.frombuffer(index.column(c)[at].as_py(), kind)  # noqa: E731, B023
            n = index.column("n")[at].as_py()
            raw = index.column("vectors")[at].as_py()
            vectors = np.frombuffer(raw, np.float32 if len(raw) == 4 * n * width else np.float64).reshape(n, width)
            lengths = np.linalg.norm(vectors.astype(np.float64), axis=1)
            files = InvertedFiles(read("starts", np.int32), read("rows", np.uint16), read("places", np.uint8), n)
            ids = index.column("ids")[at].values.to_pylist()
            ends = np.cumsum(read("sizes", np.int32))
            starts = np.concatenate([[0], ends[:-1]])
            held = asked.column("asked")[0].values
            queries = dense(held.field("v"), width).astype(np.float64)
            count = min(n, max(least, int(np.ceil(share * n))))
            for query, q_id, order in zip(queries, held.field("id").to_pylist(), model.order(queries), strict=True):
                if count == n:
                    rows = np.arange(n)
                else:
                    sums = files.sums(order)
                    likely = lengths * (model.base + HOPE * model.spread + model.slope * sums)
                    likely[sums == 0] = -np.inf
                    rows = np.argpartition(-likely, count - 1)[:count]
                # row by row in one order of additions, so that equal vectors get equal scores
                scores = (vectors[rows] * query).sum(axis=1)
                # classes that may hold one of the best k, ties included
                if len(scores) > k + 1:
                    bar = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
                    rows, scores = rows[scores >= bar], scores[scores >= bar]
                hits = [(-s, i) for r, s in zip(rows.tolist(), scores.tolist(), strict=True) for i in ids[starts[r] : ends[r]] if i != q_id]
                hits.sort()
                for s, i in hits[:k]:
                    out_q.append(q_id)
                    out_id.append(i)
                    out_score.append(-s)
        return pa.table([pa.array(out_q, form), pa.array(out_id, form), pa.array(out_score, pa.float64())], names=["query_id", "id", "score"])

    return run
