"""Cross-sections: everything that compares the entities of one date."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidepanel.functions.nulls import divide, finite
from tidepanel.sources.shared import ship_package


def percentile_rank(x: Column, by: str | Column = "date", *, ascending: bool = True, pct: bool = True) -> Column:
    """Average-tie rank among the non-null values of the group, over their number; null stays null."""
    order = x.asc_nulls_last() if ascending else x.desc_nulls_last()
    rank = F.rank().over(Window.partitionBy(by).orderBy(order))
    ties = F.count(F.lit(1)).over(Window.partitionBy(by, x))
    place = rank + (ties - 1) / 2
    return F.when(x.isNotNull(), place / F.count(x).over(Window.partitionBy(by)) if pct else place)


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Average-tie ranks of values over their number; NaN is the largest value and equals itself."""
    order = np.argsort(x)
    v = x[order]
    new = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1]))])) if len(v) else np.empty(0, int)
    ties = np.diff(new, append=len(v))
    out = np.empty(len(v))
    out[order] = np.repeat((new + 1 + (ties - 1) / 2) / max(len(v), 1), ties)
    return out


def rank_columns(df: DataFrame, cols: list[str], by: str = "date", suffix: str = "_rk", keys: tuple[str, ...] = ("date", "ticker")) -> DataFrame:
    """Percentile ranks of many columns within ``by``; rows without one of ``keys`` get none.

    The rows of a group meet in one task, which ranks column by column: one exchange and one sort of the rows as they are, whatever the number of
    columns. In long form every value would be a row of its own in three exchanges.
    """
    if not cols:
        return df
    ship_package(df.sparkSession)
    names = [*keys, *[c for c in df.columns if c not in keys]]
    made = [c + suffix for c in cols]
    rows = df.select(*[F.col(f"`{c}`") for c in names])
    schema = StructType([*rows.schema.fields, *[StructField(m, DoubleType()) for m in made]])

    def ranked(table: pa.Table) -> pa.Table:
        whole = np.logical_and.reduce([table.column(k).is_valid().to_numpy() for k in keys])
        for c, m in zip(cols, made, strict=True):
            column = table.column(c).cast(pa.float64())
            there = column.is_valid().to_numpy()
            out = np.zeros(len(there))
            out[there] = average_ranks(column.fill_null(0.0).to_numpy()[there])
            table = table.append_column(m, pa.array(out, pa.float64(), mask=~(there & whole)))
        return table

    return rows.groupBy(by).applyInArrow(ranked, schema)


def winsorized(x: Column, by: str = "date", lower: float = 0.01, upper: float = 0.99) -> Column:
    edges = F.percentile(x, F.array(F.lit(lower), F.lit(upper))).over(Window.partitionBy(by))
    return F.when(x.isNotNull(), F.greatest(F.least(x, edges[1]), edges[0]))


def with_zscore(df: DataFrame, cols: list[str], by: str = "date", suffix: str = "_z", winsor: tuple[float, float] | None = (0.01, 0.99)) -> DataFrame:
    """Winsorised z-scores with the population deviation; NULL where nothing varies."""
    d = Window.partitionBy(by)
    step = df.withColumns({f"_w_{c}": winsorized(F.col(c), by, *winsor) if winsor else F.col(c) for c in cols})

    def z(c: str) -> Column:
        x = F.col(f"_w_{c}")
        sd = F.stddev_pop(x).over(d)
        return F.when(sd > 0, divide(x - F.avg(x).over(d), sd))

    return step.withColumns({c + suffix: z(c) for c in cols}).drop(*[f"_w_{c}" for c in cols])


def neutralized(x: Column, group: str, by: str = "date") -> Column:
    """Residual of a regression on one set of dummies: the distance from the group's mean."""
    return x - F.avg(x).over(Window.partitionBy(by, group))


def neutralize(df: DataFrame, factor: str, groups: list[str], by: str = "date", name: str | None = None) -> DataFrame:
    """Residuals per date on the dummies of all ``groups``; rows without a factor or group keep their value.

    One group needs no regression; several are swept over all dates at once. With several, dates with no more rows than
    dummies are only centred.
    """
    name = name or f"{factor}_neutral"
    if len(groups) == 1:
        known = F.col(factor).isNotNull() & F.col(groups[0]).isNotNull()
        return df.withColumn(name, F.when(known, neutralized(F.when(known, F.col(factor)), groups[0], by)).otherwise(F.col(factor)))
    from tidepanel.operators.neutral import neutralize_crossed

    return neutralize_crossed(df, factor, groups, by, name)


def qcut_bucket(order: Column, n: Column, k: int) -> Column:
    """Bucket 0 to k - 1 of the row with rank ``order`` (1 to n), by equal-frequency edges on ranks."""
    return F.when(order == 1, 0).otherwise(F.ceil((order - 1) * k / (n - 1)) - 1).cast("long")


def with_bucket(df: DataFrame, col: str, k: int = 10, by: str = "date", tie: str = "ticker", name: str = "bucket") -> DataFrame:
    """Buckets of first-method ranks; ties are broken by ``tie``; rows without a value get none."""
    has = F.col(col).isNotNull().cast("int")
    w = Window.partitionBy(by, has).orderBy(col, tie)
    n = F.count(F.lit(1)).over(Window.partitionBy(by, has))
    return df.withColumns({"_r": F.row_number().over(w), "_n": n}).withColumn(name, F.when(F.col(col).isNotNull(), qcut_bucket(F.col("_r"), F.col("_n"), k))).drop("_r", "_n")


def with_decile_label(df: DataFrame, col: str, by: str = "date", name: str = "decile", least: int = 10) -> DataFrame:
    """Deciles of raw values: ties share one, equal edges count once; fewer than ``least`` values give none.

    A group of equal values has one edge and no label.
    """
    x, d = F.col(col), Window.partitionBy(by)
    cuts = F.array(*[F.lit(i / 10) for i in range(11)])
    step = df.withColumns({"_e": F.array_distinct(F.percentile(x, cuts).over(d)), "_n": F.count(x).over(d)})
    below = F.size(F.filter("_e", lambda e: e < x))
    label = F.greatest(below - 1, F.lit(0)).cast("int")
    return step.withColumn(name, F.when(x.isNotNull() & (F.col("_n") >= least) & (F.size("_e") > 1), label)).drop("_e", "_n")


def guarded_corr(a: Column, b: Column) -> Column:
    """Pearson correlation of an aggregate; NULL for fewer than two pairs or a constant side."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    varies = (F.count(x) > 1) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, finite(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))))


def ic(df: DataFrame, pred: str, target: str, by: str | list[str] = "date", name: str = "ic") -> DataFrame:
    """Pearson correlation of prediction and target by group, over complete pairs."""
    return df.groupBy(by).agg(guarded_corr(F.col(pred).cast("double"), F.col(target).cast("double")).alias(name))


def rank_ic(df: DataFrame, pred: str, target: str, by: str | list[str] = "date", name: str = "ic") -> DataFrame:
    """Spearman correlation by group: average ranks among the complete pairs, then Pearson.

    Twelve digits are kept, so that a correlation of nothing but rounding noise is 0 and no hit.
    """
    keys = [by] if isinstance(by, str) else by
    pairs = df.where(F.col(pred).isNotNull() & F.col(target).isNotNull())

    def rank(c: str) -> Column:
        return F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2

    groups = df.select(*keys).distinct()
    got = pairs.withColumns({"_a": rank(pred), "_b": rank(target)}).groupBy(*keys).agg(F.round(guarded_corr(F.col("_a"), F.col("_b")), 12).alias(name))
    return groups.join(got, keys, "left")


def ic_stats(x: Column) -> list[Column]:
    """Aggregates of the non-null values: mean, sample deviation, t, share above 0 and number."""
    n, m, s = F.count(x), F.avg(x), F.stddev_samp(x)
    return [m.alias("mean"), s.alias("std"), F.when(s > 0, m / (s / F.sqrt(n))).alias("t"), F.avg((x > 0).cast("double")).alias("hit"), n.alias("n")]


def ic_summary(df: DataFrame, name: str = "ic", by: list[str] | None = None) -> DataFrame:
    """``ic_stats`` by group; groups without a value are left out."""
    x = F.col(name)
    return df.where(x.isNotNull()).groupBy(*(by or [])).agg(*ic_stats(x))


def bucket_spread(df: DataFrame, pred: str, target: str, n: int = 10, by: str = "date", tie: str = "ticker") -> DataFrame:
    """Mean target of the top bucket less that of the bottom one; groups of fewer than ``n`` pairs give null."""
    pairs = with_bucket(df.where(F.col(pred).isNotNull() & F.col(target).isNotNull()), pred, n, by, tie)
    top, bottom = F.avg(F.when(F.col("bucket") == n - 1, F.col(target))), F.avg(F.when(F.col("bucket") == 0, F.col(target)))
    got = pairs.groupBy(by).agg(F.when(F.count(F.lit(1)) >= n, top - bottom).alias("spread"))
    return df.select(by).distinct().join(got, by, "left")


def row_mean(*cols: Column) -> Column:
    """Mean of the values that are there; NULL if none is."""
    held = F.filter(F.array(*[c.cast("double") for c in cols]), lambda v: v.isNotNull())
    return F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda a, v: a + v) / F.size(held))


def one_hot(df: DataFrame, col: str, values: list[str], prefix: str = "sec_") -> DataFrame:
    """A byte column for each value; a null value sets none."""
    return df.withColumns({prefix + v: F.coalesce((F.col(col) == v), F.lit(False)).cast("byte") for v in values})


def consensus(df: DataFrame, scores: list[str], by: str = "date") -> Column:
    """Mean of the models' percentile ranks."""
    return row_mean(*[percentile_rank(F.col(c), by) for c in scores])


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
