"""Moments of wide matrices: correlations over complete pairs and missing shares of thousands of columns.

One pass: each task adds up, in Arrow batches, the moments of pairs of column tiles as matrix products (rows of both present, sums,
squares, products). Values are taken from the task's first one of their column, so that nothing cancels; when two tasks' sums meet, one is
moved to the other's origin. They meet by tile and salt first, then by tile, so that no task gathers a tile from all others at
once and the driver gathers nothing. Work is rows times columns squared; the plan has as many nodes for 2 columns as for 2,000.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.models.boosting import matrix
from tidepanel.sources.shared import ship_package

#: Columns of a tile, rows of a product, salts of the first sums.
TILE, ROWS, SALTS = 256, 2048, 16
#: A column whose deviation is below this share of its distance from the origin does not vary.
FLAT = 1e-12


class Sums:
    """Moments of tiles I and J about origins ``a`` and ``b``: [n, x, y, xx, yy, xy], each (columns of I, columns of J)."""

    def __init__(self, a: np.ndarray, b: np.ndarray, m: np.ndarray | None = None):
        self.a, self.b = a, b
        self.m = np.zeros((6, len(a), len(b))) if m is None else m

    def add(self, x: np.ndarray, y: np.ndarray, has_x: np.ndarray, has_y: np.ndarray) -> None:
        n, sx, sy, xx, yy, xy = self.m
        n += has_x @ has_y.T
        sx += x @ has_y.T
        sy += has_x @ y.T
        xx += (x * x) @ has_y.T
        yy += has_x @ (y * y).T
        xy += x @ y.T

    def merge(self, other: Sums) -> Sums:
        """The sums of both; ``other`` is moved to these origins. A column without an origin takes the other's."""
        a, b = (np.where(np.isnan(own), theirs, own) for own, theirs in ((self.a, other.a), (self.b, other.b)))
        n, sx, sy, xx, yy, xy = other.m
        dx, dy = np.nan_to_num(other.a - a)[:, None], np.nan_to_num(other.b - b)[None, :]
        moved = np.stack([n, sx + dx * n, sy + dy * n, xx + 2 * dx * sx + dx * dx * n, yy + 2 * dy * sy + dy * dy * n, xy + dy * sx + dx * sy + dx * dy * n])
        return Sums(a, b, self.m + moved)

    def correlations(self) -> np.ndarray:
        """NaN for fewer than two pairs or a side that does not vary."""
        n, sx, sy, xx, yy, xy = self.m
        with np.errstate(all="ignore"):
            mx, my = sx / n, sy / n
            vx, vy = xx / n - mx * mx, yy / n - my * my
            corr = (xy / n - mx * my) / np.sqrt(vx * vy)
            fine = (n > 1) & (vx > FLAT**2 * mx * mx) & (vy > FLAT**2 * my * my) & (vx > 0) & (vy > 0)
        return np.where(fine & np.isfinite(corr), corr, np.nan)


def _tiles(width: int) -> list[slice]:
    return [slice(i, min(i + TILE, width)) for i in range(0, width, TILE)]


def pair_moments(df: DataFrame, cols: list[str]):
    """RDD of ((I, J), Sums) of all pairs of column tiles, I up to J."""
    ship_package(df.sparkSession)
    width, tiles = len(cols), _tiles(len(cols))
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(cols)])

    def run(batches: Iterator) -> Iterator:
        import pickle

        import pyarrow as pa

        origin, sums = np.full(width, np.nan), {}
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                x = matrix(batch.slice(start, ROWS), range(width))
                has = np.isfinite(x)
                new = np.isnan(origin) & has.any(axis=1)
                origin[new] = x[new, has[new].argmax(axis=1)]
                x = np.where(has, x - origin[:, None], 0.0)
                has = has.astype(float)
                for i, s in enumerate(tiles):
                    for j in range(i, len(tiles)):
                        t = tiles[j]
                        own = sums.setdefault((i, j), Sums(origin[s], origin[t]))
                        own.add(x[s], x[t], has[s], has[t])
        # origins may have been found after a tile's sums began: they are views of one array
        out = [(i, j, pickle.dumps((s.a.copy(), s.b.copy(), s.m))) for (i, j), s in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["i", "j", "sums"])

    def opened(part: int, found) -> Iterator:
        import pickle

        for r in found:
            yield (r["i"], r["j"], part % SALTS), Sums(*pickle.loads(r["sums"]))

    pairs = len(tiles) * (len(tiles) + 1) // 2
    parts = rows.mapInArrow(run, "i int, j int, sums binary").rdd.mapPartitionsWithIndex(opened)
    salted = parts.reduceByKey(Sums.merge, min(pairs * SALTS, parts.getNumPartitions() or 1))
    return salted.map(lambda kv: (kv[0][:2], kv[1])).reduceByKey(Sums.merge, pairs)


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, n, corr) of all pairs of columns over the rows where both are finite; ``a`` stands before ``b`` in ``cols``.

    Fewer than two such rows, or a side that does not vary, give null. An empty table gives n = 0 for every pair.
    """
    tiles = _tiles(len(cols))
    first = df.sparkSession.sparkContext.parallelize([((i, j), None) for i in range(len(tiles)) for j in range(i, len(tiles))], 1)

    def rows(item) -> Iterator[tuple]:
        (i, j), (_, sums) = item
        s, t = tiles[i], tiles[j]
        corr = sums.correlations() if sums is not None else None
        for p in range(s.start, s.stop):
            for q in range(max(t.start, p + 1), t.stop):
                value = float(corr[p - s.start, q - t.start]) if corr is not None else float("nan")
                n = int(sums.m[0, p - s.start, q - t.start]) if sums is not None else 0
                yield cols[p], cols[q], n, value if value == value else None

    made = first.leftOuterJoin(pair_moments(df, cols)).flatMap(rows)
    return df.sparkSession.createDataFrame(made, "a string, b string, n long, corr double")


def missing(df: DataFrame, cols: list[str]) -> DataFrame:
    """(metric, value): share of rows of each column that are null or not finite; null for an empty table."""
    tiles, counted = _tiles(len(cols)), pair_moments(df, cols)
    total = df.count()

    def rows(item) -> Iterator[tuple]:
        (i, _), sums = item
        for k, n in enumerate(np.diagonal(sums.m[0])):
            yield cols[tiles[i].start + k], float(1 - n / total)

    if not total:
        return df.sparkSession.createDataFrame([(c, None) for c in cols], "metric string, value double")
    return df.sparkSession.createDataFrame(counted.filter(lambda kv: kv[0][0] == kv[0][1]).flatMap(rows), "metric string, value double")
