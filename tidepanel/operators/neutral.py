"""Residuals of a regression on several sets of dummies, by alternating projections over all dates at once.

Rows of one date with the same groups share their fitted value, so the iteration runs on *cells* (date and one group of each set) with counts and
mean residuals, not on rows. A sweep takes, set by set, the weighted mean of each (date, group) off its cells; what is left
converges to the least squares residual, whatever the rank of the dummies. All is DataFrame windows: cells are dealt by date once, and
a few sweeps are one job, after which cells are written to the shared folder and the largest change decides whether more are needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.sources.shared import fresh, stored

#: Sweeps of one job, jobs at most, and the error that is left at most, as a share of the largest distance of a cell from its date's mean.
SWEEPS, JOBS, TOLERANCE = 6, 60, 1e-12


class NotConverged(ArithmeticError):
    """The sweeps did not settle; the message has the last change."""


def cell_residuals(cells: DataFrame, by: str, groups: list[str]) -> DataFrame:
    """``cells`` (date, groups, n, m) with ``m`` swept until the error is within the tolerance.

    Changes shrink by a constant factor in the end, so what is left to come is the last change over one less that factor.
    """
    day = Window.partitionBy(by)
    cells = cells.repartition(by).withColumn("m", F.col("m") - F.sum(F.col("n") * F.col("m")).over(day) / F.sum("n").over(day))
    scale, left = None, None
    for _ in range(JOBS):
        if scale is None:
            cells = cells.withColumn("size", F.abs("m"))
        for sweep in range(SWEEPS):
            if sweep >= SWEEPS - 2:
                cells = cells.withColumn(f"was{SWEEPS - sweep}", F.col("m"))
            for g in groups:
                w = Window.partitionBy(by, g)
                cells = cells.withColumn("m", F.col("m") - F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
        cells = stored(cells, "neutral-cells")
        changes = [F.max(F.abs(F.col("m") - F.col("was1"))).alias("last"), F.max(F.abs(F.col("was1") - F.col("was2"))).alias("before")]
        found = cells.agg(*changes, *([F.max("size").alias("size")] if scale is None else [])).first()
        scale = found["size"] if scale is None else scale
        cells = cells.drop("was1", "was2", "size")
        last, before = found["last"] or 0.0, found["before"] or 0.0
        left = last if last >= before else last / (1 - last / before)
        if not scale or left <= TOLERANCE * scale or last <= 4e-16 * scale:
            return cells
        cells = cells.repartition(by)
    raise NotConverged(f"after {SWEEPS * JOBS} sweeps values are still {left} from the end")


def neutralize_crossed(df: DataFrame, factor: str, groups: list[str], by: str = "date", name: str | None = None) -> DataFrame:
    """``df`` with the residuals, per date, of ``factor`` on the dummies of all ``groups``.

    Rows without a factor or without one of the groups keep their value and take no part. Dates with no more rows than dummies are
    only centred. Repeated rows count as often as they occur; an empty table gives an empty result.
    """
    name = name or f"{factor}_neutral"
    x, keys = fresh(df, "_x"), [fresh(df, f"_g{i}") for i in range(len(groups))]
    known = F.col(f"`{factor}`").isNotNull() & ~F.isnan(F.col(f"`{factor}`").cast("double"))
    for g in groups:
        known = known & F.col(f"`{g}`").isNotNull()
    day = fresh(df, "_by")
    rows = df.withColumns({x: F.when(known, F.col(f"`{factor}`").cast("double")), day: F.when(known, F.col(f"`{by}`"))} | {k: F.when(known, F.col(f"`{g}`").cast("string")) for k, g in zip(keys, groups, strict=True)})
    own = rows.where(F.col(x).isNotNull() & F.col(day).isNotNull())
    cells = own.groupBy(F.col(day).alias("by"), *[F.col(k).alias(f"g{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("m"))
    cells = stored(cells.withColumn("mean", F.col("m")), "neutral-cells")
    sets = [f"g{i}" for i in range(len(groups))]
    sizes = cells.groupBy("by").agg(F.sum("n").alias("rows"), sum((F.count_distinct(s) for s in sets), F.lit(0)).alias("dummies"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("centre"))
    swept = cell_residuals(cells, "by", sets).join(sizes, "by")
    # what the fit takes off each row of a cell
    fit = F.when(F.col("rows") <= F.col("dummies"), F.col("centre")).otherwise(F.col("mean") - F.col("m"))
    fits = swept.select(F.col("by").alias(day), *[F.col(s).alias(k) for s, k in zip(sets, keys, strict=True)], fit.alias("_fit"))
    fits = fits.withColumnRenamed("_fit", held := fresh(rows, "_fit"))
    joined = rows.join(fits, [day, *keys], "left")
    value = F.when(F.col(held).isNotNull(), F.col(x) - F.col(held)).otherwise(F.col(f"`{factor}`").cast("double"))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], value.alias(name))
