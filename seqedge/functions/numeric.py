"""Numeric column expressions: thresholds, clipping, logit/sigmoid, NaN policy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def nan_to_null(col) -> Column:
    """NaN becomes NULL (Spark and DuckDB order NaN above every number)."""
    c = _c(col)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c.cast("double"))


def binarize(col, threshold: float) -> Column:
    """1 if ``col >= threshold`` else 0; NULL stays NULL, and NaN is NULL."""
    return (nan_to_null(col) >= F.lit(threshold)).cast("int")


def clip(col, lo: float, hi: float) -> Column:
    """Clamp into [lo, hi]; NULL stays NULL (greatest/least skip NULLs otherwise)."""
    c = _c(col)
    return F.when(c.isNull(), F.lit(None)).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def logit(col) -> Column:
    """ln(p / (1 - p))."""
    p = _c(col)
    return F.log(p / (F.lit(1.0) - p))


def sigmoid(col) -> Column:
    """1 / (1 + exp(-x))."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(col)))
