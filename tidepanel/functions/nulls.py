"""Null discipline: NaN and infinities become NULL, and division never fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-12


def finite(x: Column) -> Column:
    """``x``, or NULL where it is NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def scrub(df: DataFrame) -> DataFrame:
    """NaN and infinities of all floating columns to NULL; the step at every source boundary."""
    return df.withColumns({c: finite(F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def divide(num: Column, den: Column) -> Column:
    """NULL where the denominator is 0 or NULL."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def divide_finite(num: Column, den: Column) -> Column:
    """As ``divide``, and NULL where the result is not finite."""
    return finite(divide(num, den))


def divide_positive(num: Column, den: Column) -> Column:
    """NULL unless the denominator is above 0."""
    return F.when(den > 0, divide(num, den))


def divide_tiny(num: Column, den: Column) -> Column:
    """NULL where the denominator is within 1e-12 of 0."""
    return F.when(F.abs(den) > TINY, divide(num, den))


def log_positive(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def number(text: Column) -> Column:
    """Text with thousands commas as a double; junk gives NULL."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast("double")


def first_present(df: DataFrame, *names: str) -> Column:
    """The first of the columns that the frame has, chosen by schema; NULL if it has none."""
    for name in names:
        if name in df.columns:
            return F.col(name).cast("double")
    return F.lit(None).cast("double")


def optional(df: DataFrame, name: str) -> Column:
    return first_present(df, name)


def prefer_rows(vendor: Column, own: Column) -> Column:
    """The vendor's value, row by row, or else our own."""
    return F.coalesce(vendor, own)


def require(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    return df
