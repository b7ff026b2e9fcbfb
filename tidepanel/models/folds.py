"""Logistic regressions of all walk-forward folds in one fit.

Training spans grow from one start, so a fold's rows are those up to its end. Counts, means and deviations come from one pass that adds
up moments by training span piece; the running sums over the pieces are the folds' own. Newton steps of all folds are taken at once: a job
computes, for every row, the probabilities under the coefficients of all folds that hold it, and adds up their gradients and
curvatures in a tree. So there is one job a step, whatever the number of folds, and what travels is folds times features squared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.models.splits import Fold
from tidepanel.sources.shared import fresh, ship_package, stored


@dataclass
class FoldLogits:
    """Coefficients on standardised features by fold; ``fitted``: folds with rows of both classes."""

    folds: list[Fold]
    cols: list[str]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    constant: np.ndarray
    fitted: np.ndarray
    steps: int
    moved: float

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """Rows of the folds' test spans with ``fold`` and score: no UDF, one row for each span that holds it.

        A row with a missing feature gets a null score. Spans of a fold that was not fitted give no rows.
        """
        spark = df.sparkSession
        own, x = fresh(df, "_fold"), [F.col(f"`{c}`").cast("double") for c in self.cols]
        rows = [(f.fold, f.test_start, f.test_end, [float(v) for v in self.weights[i] / self.scale[i]], float(self.constant[i] - (self.weights[i] / self.scale[i] * self.mean[i]).sum())) for i, f in enumerate(self.folds) if self.fitted[i]]
        # one row for each fold
        spans = F.broadcast(spark.createDataFrame(rows, "fold int, a date, b date, w array<double>, c double").select(F.struct("*").alias(own)))
        joined = df.join(spans, F.col("date").between(F.col(f"{own}.a"), F.col(f"{own}.b")))
        margin = F.col(f"{own}.c")
        for i, v in enumerate(x):
            margin = margin + F.when(~F.isnan(v), v) * F.col(f"{own}.w")[i]
        return joined.withColumns({name: 1 / (1 + F.exp(-margin)), "fold": F.col(f"{own}.fold")}).drop(own)


def _packed(df: DataFrame, cols: list[str], y: str, folds: list[Fold]) -> DataFrame:
    """Complete labelled rows with the first fold that holds them, written once: piece, y, x."""
    x = [F.col(f"`{c}`").cast("double") for c in cols]
    label = F.col(f"`{y}`").cast("double")
    piece = F.lit(None).cast("int")
    for i, f in reversed(list(enumerate(folds))):
        piece = F.when(F.col("date").between(f.train_start, f.train_end), i).otherwise(piece)
    known = label.isin(0.0, 1.0)
    for v in x:
        known = known & v.isNotNull() & ~F.isnan(v)
    return stored(df.where(known).select(piece.alias("piece"), label.alias("y"), *[v.alias(f"x{i}") for i, v in enumerate(x)]).where("piece IS NOT NULL"), "fold-rows")


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    piece, y, *x = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
    return piece.astype(int), y, np.stack(x, axis=1)


def _added(rows: DataFrame, work, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of ``work(piece, y, x)`` over all batches: within partitions first, then in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += work(*_arrays(batch))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = rows.mapInArrow(run, "sums binary").rdd.map(lambda r: np.frombuffer(r["sums"]).reshape(shape))
    return parts.treeReduce(np.add, depth=3) if parts.getNumPartitions() else np.zeros(shape)


def fit_fold_logits(df: DataFrame, folds: list[Fold], cols: list[str], y: str = "y", *, c: float = 1.0, steps: int = 100, tolerance: float = 1e-10) -> FoldLogits:
    """Standardised, L2-penalised, class-balanced logistic regressions of all folds, by Newton steps with halving.

    Each equals the single fit on its rows: both classes weigh alike, the penalty is 1 / (2 c) of the squared weights, the constant
    has none. Rows without a label or with a missing feature are left out. Folds must grow from one start. A fold without both
    classes is not fitted. ``moved`` is the last step's largest change; one above ``tolerance`` means that ``steps`` were too few.
    """
    if any(f.train_start != folds[0].train_start or f.train_end < g.train_end for g, f in zip(folds, folds[1:], strict=False)):
        raise ValueError("folds must grow from one start")
    ship_package(df.sparkSession)
    k, d = len(folds), len(cols)
    nothing = np.zeros((k, d))
    if not k:
        return FoldLogits(folds, cols, nothing, nothing, nothing, np.zeros(0), np.zeros(0, bool), 0, 0.0)
    rows = _packed(df, cols, y, folds)

    def first(piece: np.ndarray, label: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(piece, weights=v, minlength=k) for v in (np.ones(len(label)), label, *x.T)], axis=1)

    sums = np.cumsum(_added(rows, first, (k, 2 + d)), axis=0)
    n, positive = sums[:, 0], sums[:, 1]
    mean = sums[:, 2:] / np.maximum(n, 1)[:, None]
    # deviations about the last fold's mean, moved to each fold's own
    centre = mean[-1]

    def second(piece: np.ndarray, label: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(piece, weights=v, minlength=k) for v in ((x - centre) ** 2).T], axis=1)

    squares = np.cumsum(_added(rows, second, (k, d)), axis=0) - n[:, None] * (mean - centre) ** 2
    deviation = np.sqrt(np.maximum(squares, 0) / np.maximum(n - 1, 1)[:, None])
    scale = np.where(deviation > 0, deviation, 1.0)
    fitted = (positive > 0) & (positive < n)
    up, down = (n / (2 * np.maximum(part, 1)) for part in (positive, n - positive))
    at = np.zeros((k, d + 1))  # the constant last

    def loss_parts(piece: np.ndarray, label: np.ndarray, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """By fold: loss, gradient, curvature."""
        out = np.zeros((k, 1 + (d + 1) + (d + 1) ** 2))
        for f in range(k):
            if not fitted[f]:
                continue
            own = piece <= f
            z = np.concatenate([(x[own] - mean[f]) / scale[f], np.ones((int(own.sum()), 1))], axis=1)
            t, w = label[own], np.where(label[own] == 1, up[f], down[f])
            s = z @ at[f]
            p = 1 / (1 + np.exp(-s))
            out[f, 0] = (w * (np.logaddexp(0, s) - t * s)).sum()
            out[f, 1 : d + 2] = z.T @ (w * (p - t))
            out[f, d + 2 :] = ((z * (w * p * (1 - p))[:, None]).T @ z).ravel()
        return out

    held = np.append(np.full(d, 1 / c), 0.0)
    value = np.full(k, np.inf)
    best, ahead, share, moved, done = at.copy(), np.zeros_like(at), np.ones(k), np.inf, 0
    while done < steps:
        here = at
        sums = _added(rows, lambda piece, label, x, here=here: loss_parts(piece, label, x, here), (k, 1 + (d + 1) + (d + 1) ** 2))
        done += 1
        now = sums[:, 0] + 0.5 * (held * at**2).sum(axis=1)
        worse = now > value * (1 + 1e-12) + 1e-12
        share = np.where(worse, share / 2, 1.0)
        for f in range(k):
            if fitted[f] and not worse[f]:
                g = sums[f, 1 : d + 2] + held * at[f]
                h = sums[f, d + 2 :].reshape(d + 1, d + 1) + np.diag(held)
                best[f], value[f], ahead[f] = at[f], now[f], np.linalg.lstsq(h, -g, rcond=None)[0]
        at = best + share[:, None] * ahead
        moved = float(np.abs(at - best)[fitted].max(initial=0.0))
        if moved < tolerance:
            break
    return FoldLogits(folds, cols, mean, scale, best[:, :d], best[:, d], fitted, done, moved)
