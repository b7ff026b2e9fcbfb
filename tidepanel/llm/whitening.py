"""Operator 12: embedding whitening by Chan's merge of partition moments.

1. Each vector becomes integers, x = floor(scale * c). The distinct x vectors are the *fit list*; they are found by a hash
   aggregation that combines before its exchange, so copies of one vector cost one row for each task.
2. Each partition computes count, exact integer sums, local mean and centred scatter of its part of the fit list; a tree reduction
   merges them pairwise by Chan's formula, so nothing is centred on a value far from its data and one
   small matrix for each branch travels.
3. The driver takes the eigenvectors of the merged covariance (width x width, whatever the number of vectors).
4. A second pass over the fit list computes the covariance of the whitened values, by the same merge, and compares it with the identity.
5. Every row is projected where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import discard, materialize

#: Levels of the tree reduction.
DEPTH = 3
#: Eigenvalues below this share of the largest are nothing but rounding: such a component has no whitened values.
RANK_TOLERANCE = 1e-12
#: Vectors whose scatter is computed at once.
BLOCK = 4096


@dataclass
class Moments:
    """Count, exact sums, mean and centred scatter of some vectors."""

    n: int
    sums: list[int]
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        """Moments of a block of at least one vector; sums are exact for integers."""
        mean = x.mean(axis=0, dtype=np.longdouble).astype(np.float64)
        centred = x - mean
        drift = centred.mean(axis=0)  # what rounding has left of the mean
        mean, centred = mean + drift, centred - drift
        sums = x.sum(axis=0).tolist() if np.issubdtype(x.dtype, np.integer) else []
        return cls(len(x), sums, mean, centred.T @ centred)

    def merge(self, other: Moments) -> Moments:
        """Chan, Golub and LeVeque: scatter of a union from the scatters and the distance of the means."""
        if not self.n or not other.n:
            return self if self.n else other
        n = self.n + other.n
        apart = other.mean - self.mean
        return Moments(
            n,
            [a + b for a, b in zip(self.sums, other.sums, strict=True)],
            self.mean + apart * (other.n / n),
            self.scatter + other.scatter + np.outer(apart, apart) * (self.n * (other.n / n)),
        )


NOTHING = Moments(0, [], np.empty(0), np.empty((0, 0)))


@dataclass
class Whitening:
    """What a fit list gives: its size and sums, eigenvalues from the largest, their vectors in rows, the trace, the error of the second pass."""

    width: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened values of integer vectors, one column for each component."""
        mean = np.array([s // self.n + (s % self.n) / self.n for s in self.sums]) if self.n else np.zeros(self.width)
        return (x - mean) @ (self.vectors / np.sqrt(self.values)[:, None]).T

    def deviations(self, x: np.ndarray) -> list[int]:
        """sum over dimensions of (n * x - S)^2, exactly."""
        largest = self.n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in self.sums), default=0)
        if largest and largest**2 * max(self.width, 1) > np.iinfo(np.int64).max:  # beyond machine integers
            out = [sum((self.n * a - s) ** 2 for a, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
            if max(out, default=0) > np.iinfo(np.int64).max:
                raise ArithmeticError("a deviation does not fit into a long")
            return out
        away = x * self.n - np.array(self.sums, np.int64)
        return (away * away).sum(axis=1).tolist()


def integers(flat: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * c) as longs; an error where that does not fit."""
    x = np.floor(flat.astype(np.float64) * scale)
    if len(x) and np.abs(x).max() >= 2.0**63:
        raise ArithmeticError("a scaled entry does not fit into a long")
    return x.astype(np.int64)


def vectors_of(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, lengths, flat integers) of the vectors that are not null and hold neither null nor non-finite entries."""
    lengths = np.diff(column.offsets.to_numpy())
    starts = column.offsets.to_numpy()[:-1]
    values = column.values.to_numpy(zero_copy_only=False)  # null entries become NaN
    fine = np.isfinite(values.astype(np.float64))
    before = np.concatenate([[0], np.cumsum(fine)])
    good = column.is_valid().to_numpy(zero_copy_only=False) & (before[starts + lengths] - before[starts] == lengths)
    places = np.flatnonzero(good)
    member = np.repeat(good, lengths)
    own = values[starts[0] : starts[-1] + lengths[-1]] if len(starts) else values[:0]
    return places, lengths[places], integers(own[member], scale)


def packed(row: np.ndarray) -> bytes:
    """Integers in the narrowest of three forms, which the first byte names; equal vectors give equal bytes."""
    low, high = (int(row.min()), int(row.max())) if len(row) else (0, 0)
    for form in ("<i2", "<i4"):
        if np.iinfo(form).min <= low and high <= np.iinfo(form).max:
            return form[2].encode() + row.astype(form).tobytes()
    return b"8" + row.astype("<i8").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{chr(data[0])}", offset=1).astype(np.int64)


def _fit_list(vectors: DataFrame, vector_col: str, scale: float) -> DataFrame:
    """Distinct x vectors: ``width`` and ``x``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, lengths, flat = vectors_of(batch.column(0), scale)
            rows = np.split(flat, np.cumsum(lengths)[:-1]) if len(lengths) else []
            yield pa.RecordBatch.from_arrays([pa.array(lengths.astype(np.int32)), pa.array([packed(r) for r in rows], pa.binary())], ["width", "x"])

    return vectors.select(F.col(f"`{vector_col}`").alias("v")).mapInArrow(run, "width int, x binary").groupBy("width", "x").agg(F.lit(True).alias("held")).select("width", "x")


def _blocks(rows) -> Iterator[np.ndarray]:
    held: list[np.ndarray] = []
    for row in rows:
        held.append(unpacked(row.x))
        if len(held) == BLOCK:
            yield np.stack(held)
            held = []
    if held:
        yield np.stack(held)


def _moments(fit: DataFrame, change=None) -> Moments:
    """Moments of a fit list (or of ``change`` of its blocks), merged in a tree."""

    def local(rows) -> Iterator[Moments]:
        own = NOTHING
        for block in _blocks(rows):
            own = own.merge(Moments.of(block if change is None else change(block)))
        yield own

    parts = fit.select("x").rdd.mapPartitions(local)
    return parts.treeReduce(Moments.merge, depth=DEPTH) if parts.getNumPartitions() else NOTHING


def fit_whitening(vectors: DataFrame, *, vector_col: str = "embedding", scale: float = 256.0, components: int = 4) -> Whitening:
    """Principal components of the distinct integer vectors, with the error that a second pass finds.

    Vectors that are null or hold null or non-finite entries take no part. Where widths differ, the one with most distinct
    vectors counts (the smaller of two), and the others take no part. Copies count once. Without vectors, or where all
    are equal, there is no component. Entries whose scaled value does not fit into a long stop the job.
    """
    fit = materialize(_fit_list(vectors, vector_col, scale), "whitening-fit")
    top = fit.groupBy("width").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width").first()
    width = top["width"] if top else 0
    own = fit.where(F.col("width") == width)
    m = _moments(own)
    if not m.n or not width:
        discard(fit)
        return Whitening(width, m.n, m.sums, np.empty(0), np.empty((0, width)), 0.0)
    cov = m.scatter / m.n
    values, vectors_ = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(values.max(), 0.0) * RANK_TOLERANCE]
    model = Whitening(width, m.n, m.sums, values[order], vectors_[:, order].T.copy(), float(np.trace(cov)))
    if len(order):
        again = _moments(own, model.project)
        model.identity_error = float(np.abs(again.scatter / again.n - np.eye(len(order))).max())
    discard(fit)
    return model


def whiten(vectors: DataFrame, model: Whitening, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, components: int = 4) -> DataFrame:
    """One row for each usable vector and component: id, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Usable vectors have the model's width and no null or non-finite entry. There are as many components as
    ``components`` and the width allow; one beyond the rank of the fit list has null ``whitened``, and ``explained`` is 0 (null
    where all vectors are equal). Rows that repeat an id, or have none, are treated row by row. An empty table gives an empty
    result. Other columns are not read, whatever they are called.
    """
    count = min(components, model.width)
    rank = len(model.values)
    kind = vectors.select(F.col(f"`{id_col}`").alias("id")).dtypes[0][1]
    explained = [float(v / model.trace) for v in model.values] + [0.0 if model.trace else None] * (count - rank)
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, lengths, flat = vectors_of(batch.column(1), scale)
            right = lengths == model.width
            x = flat[np.repeat(right, lengths)].reshape(-1, model.width)
            if not len(x) or not count:
                continue
            places = places[right]
            white = np.full((len(x), count), np.nan)
            white[:, :rank] = model.project(x)
            rows = len(x) * count
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(places, count))),
                pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                pa.array(np.full(rows, model.n, np.int64)),
                pa.array(np.repeat(np.array(model.deviations(x), np.int64), count)),
                pa.array(white.ravel(), mask=np.isnan(white.ravel())),
                pa.array(explained * len(x), pa.float64()),
                pa.array([model.identity_error] * rows, pa.float64()),
            ], names)

    source = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    out = source.mapInArrow(run, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", id_col)
