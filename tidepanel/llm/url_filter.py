"""Operator 7: URL filters by rules and by the ratio of two character language models.

URLs that a rule decides train two variable-order Markov models over characters, one of the accepted and
one of the rejected. The others are judged by the difference of their log-likelihoods per character
against a threshold that is calibrated on a part of the decided URLs that the models have not seen.

All counts are exact and lie in tables that grow with the URLs:

* a character with the five before it is a number of 48 bits; the n-grams and contexts of all orders
  are parts of it, so the only table that is kept counts these numbers by class,
* the estimate of each order is joined to the next by the part they share; at most 256 n-grams have
  one context, and at most 256 have one shorter n-gram, so no key is hot,
* URLs are dealt to blocks; a block's distinct numbers leave it once, however often they occur there, and
  come back with the logarithm that each adds. A number that all blocks hold has as many rows as there are blocks: one in a million
  of all rows or less, as blocks grow with the input and hold many numbers. Nothing is collected but the histogram of the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import block_plan, column_list, materialize, slices, text_bytes


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Longest context: with its character it fills 48 bits of a number.
ORDER = 5
#: Bytes of URLs of a block, and of those that are counted at once.
BLOCK_BYTES, MOST_BLOCK_BYTES = 256 << 10, 8 << 20
COUNT_BYTES = 2 << 20
#: Steps of the histogram on which the threshold is chosen, and its half width.
STEPS, REACH = 400, 4.0


def url_host(url: Column) -> Column:
    """Behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; none: empty."""
    tail = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(tail, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_columns(rules: tuple[UrlRule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """(name of the longest rule that fits, its verdict); null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # the longest is asked first; of rules of one length the one listed first
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def _windows(data: bytes) -> np.ndarray:
    """For each character, it and the ``ORDER`` before it as one number; the character is the lowest byte.

    Contexts that would reach over the start are padded with a start mark.
    """
    x = np.frombuffer(b"\x02" * ORDER + data, dtype=np.uint8).astype(np.int64)
    n = len(data)
    out = np.zeros(n, dtype=np.int64)
    for k in range(ORDER + 1):
        out = out << 8 | x[k : k + n]
    return out


def _all_windows(urls: list) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *[_windows(u.encode()) for u in urls if u]])


@dataclass
class UrlModel:
    """Exact counts by class (``n0`` rejected, ``n1`` accepted) of each ``key`` of ``_windows``, and the threshold.

    The table lies in the shared folder and grows with the distinct n-grams.
    """

    counts: DataFrame
    threshold: float = 0.0

    def ratio(self, url: str | None) -> float:
        """Log-likelihood as accepted less that as rejected, per character; 0 for an empty URL.

        Each order's estimate is mixed with that of the order below, the more the fewer the
        characters seen in the context; below the lowest lies the uniform distribution.
        """
        one = self.counts.sparkSession.createDataFrame([(0, url)], "id int, url string")
        return _ratios(one, self, ("id",)).first()["ratio"]


def _count_table(decided: DataFrame) -> DataFrame:
    """(key, n0, n1) over all decided URLs; each slice of a batch sends one row for each key it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "url", COUNT_BYTES):
                urls, sides = column_list(part, "url"), column_list(part, "side")
                held = [_all_windows([u for u, s in zip(urls, sides, strict=True) if s == side]) for side in (0, 1)]
                keys, place = np.unique(np.concatenate(held), return_inverse=True)
                n0, n1 = (np.bincount(x, minlength=len(keys)) for x in np.split(place, [len(held[0])]))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, n0, n1)], ["key", "n0", "n1"])

    rows = decided.select("url", "side").mapInArrow(run, "key long, n0 long, n1 long")
    return materialize(rows.groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "url-counts")


def _log_ratios(counts: DataFrame) -> DataFrame:
    """(key, v): what the character of each key adds to the log-likelihood ratio after its context."""
    tail = lambda k: F.col("key").bitwiseAND(F.lit(256**k - 1))
    grams = [counts]
    for k in range(ORDER, 0, -1):
        grams.insert(0, grams[0].groupBy(tail(k).alias("key")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    # item k of grams: the n-grams with k characters before the last
    context = Window.partitionBy(F.shiftright("key", 8))
    below = None
    for k, rows in enumerate(grams):
        rows = rows.withColumns({f"s{i}": F.sum(f"n{i}").over(context) for i in (0, 1)})
        if k:
            rows = rows.withColumn("low", tail(k)).join(below.withColumnRenamed("key", "low"), "low")
        else:
            rows = rows.withColumns({f"p{i}": F.lit(1 / 256) for i in (0, 1)})
        below = rows.select("key", *[((F.col(f"n{i}") + 2.0 * F.col(f"p{i}")) / (F.col(f"s{i}") + 2.0)).alias(f"p{i}") for i in (0, 1)])
    return below.select("key", (F.log("p1") - F.log("p0")).alias("v"))


def _ratios(rows: DataFrame, model: UrlModel, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` of each row and the ratio of its ``url``; ``id`` and ``url`` deal rows to blocks."""
    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n in keep)

    def distinct(block: pa.Table) -> pa.Table:
        keys = np.unique(_all_windows(block.column("url").to_pylist()))
        return pa.table({"block": pa.array(np.full(len(keys), block.column("block")[0].as_py()), pa.int64()), "key": pa.array(keys, pa.int64())})

    def score(block: pa.Table, values: pa.Table) -> pa.Table:
        keys, v = values.column("key").to_numpy(), values.column("v").to_numpy()
        order = np.argsort(keys)
        keys, v = keys[order], v[order]
        ratios = [float(v[np.searchsorted(keys, _windows(u.encode()))].sum() / len(u.encode())) if u else 0.0 for u in block.column("url").to_pylist()]
        return pa.table([*(block.column(k) for k in keep), pa.array(ratios, pa.float64())], names=[*keep, "ratio"])

    blocks, partitions = block_plan(text_bytes(rows, "url"), BLOCK_BYTES, MOST_BLOCK_BYTES)
    # both branches read this exchange
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "url"), F.lit(blocks))).repartition(partitions, "block")
    windows = dealt.select("block", "url").groupBy("block").applyInArrow(distinct, "block long, key long")
    asked = windows.select("key", F.lit(0).cast("long").alias("n0"), F.lit(0).cast("long").alias("n1"))
    counts = model.counts.unionByName(asked).groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    values = windows.join(_log_ratios(counts), "key").select("block", "key", "v")
    return dealt.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(score, f"{fields}, ratio double")


def fit_urls(pages: DataFrame, rules: tuple[UrlRule, ...], *, id_col: str = "page_id", url_col: str = "url", fold: int = 5) -> UrlModel:
    """Models of all URLs that a rule decides, less the calibration fold, and the calibrated threshold.

    The threshold is the one with the best mean of the two classes' accuracies on the calibration
    fold (crc32 of the id mod ``fold`` is 0), the middle one of equals. If a class has no URL, the
    models say nothing and the threshold lets every URL pass.
    """
    url = F.col(url_col)
    _, verdict = rule_columns(rules, url_host(url), url_path(url))
    in_fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % fold == 0
    decided = pages.select(F.col(id_col).alias("id"), url.alias("url"), verdict.alias("verdict"), in_fold.alias("calibrate")).where(F.col("verdict").isNotNull())
    decided = decided.select("id", "url", "calibrate", (F.col("verdict") == "allow").cast("int").alias("side"))
    model = UrlModel(_count_table(decided.where(~F.col("calibrate"))))
    if not all(model.counts.agg(F.sum("n0"), F.sum("n1")).first()):
        model.threshold = -float("inf")
        return model
    values = _ratios(decided.where("calibrate"), model, ("side",))
    step = F.least(F.greatest(F.floor((F.col("ratio") + REACH) / (2 * REACH) * STEPS), F.lit(0)), F.lit(STEPS - 1)).cast("int")
    counts = np.zeros((2, STEPS))
    for r in values.groupBy("side", step.alias("s")).count().collect():
        counts[r["side"], r["s"]] = r["count"]
    sums = counts.sum(axis=1)
    if not sums.all():
        return model
    below = np.concatenate([np.zeros((2, 1)), counts.cumsum(axis=1)], axis=1)
    accuracy = (below[0] / sums[0] + 1 - below[1] / sums[1]) / 2
    best = np.flatnonzero(accuracy >= accuracy.max() - 1e-12)
    model.threshold = float(best[len(best) // 2] / STEPS * 2 * REACH - REACH)
    return model


def judge_urls(pages: DataFrame, rules: tuple[UrlRule, ...], model: UrlModel, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, ``host``, ``path``, ``rule``, ``verdict`` and ``ratio`` of every URL.

    The verdict is that of the longest rule that fits, or else ``allow`` if the ratio is at least the
    threshold. A null URL or one without ``://`` has an empty host and path; no rule fits it, a null or
    empty one has ratio 0. Repeated rows are judged alike; an empty table gives an empty result; other
    columns are not read.
    """
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rows = _ratios(rows, model, ("id", "url"))
    rows = rows.withColumns({"host": url_host(url), "path": url_path(url)})
    name, verdict = rule_columns(rules, F.col("host"), F.col("path"))
    judged = F.when(F.col("ratio") >= F.lit(model.threshold), "allow").otherwise("block")
    return rows.select(F.col("id").alias(id_col), "host", "path", name.alias("rule"), F.coalesce(verdict, judged).alias("verdict"), "ratio")
