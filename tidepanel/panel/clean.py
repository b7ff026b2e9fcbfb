"""Cleaning of the panel: suspect cells are nulled, rows stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators.asof import key_flags


def conservative_clean(panel: DataFrame, suspects: DataFrame, *, null_labels: bool = False, strict_gate: bool = True) -> DataFrame:
    """Null price and ``ret_*`` of the suspect (date, ticker) cells and flag them.

    Labels named ``fwd_ret_*`` stay unless ``null_labels``. ``investable`` is then priced and not excluded;
    ``strict_gate`` keeps the size and staleness gates of the assembled panel as well.
    """
    out = key_flags(panel, suspects, ["date", "ticker"], "excluded_corrupted")
    cols = [c for c in panel.columns if c == "adj_close" or c.startswith("ret_") or (null_labels and c.startswith("fwd_ret_"))]
    out = out.withColumns({c: F.when(~F.col("excluded_corrupted"), F.col(c)) for c in cols})
    gate = F.col("adj_close").isNotNull() & ~F.col("excluded_corrupted")
    if strict_gate and "investable" in panel.columns:
        gate = gate & F.coalesce(F.col("investable"), F.lit(False))
    return out.withColumns({"has_price": F.col("adj_close").isNotNull(), "suspect_week": F.col("excluded_corrupted"), "investable": gate})


def cap_large(panel: DataFrame, col: str = "mkt_cap", most: float = 3e11) -> DataFrame:
    return panel.withColumn(col, F.when(~(F.col(col) > most), F.col(col)))
