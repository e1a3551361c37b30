"""Column helpers with the numeric semantics that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEQ = "seq_id"


def finite(*cs: Column) -> Column:
    """No argument is null, NaN or infinite."""
    out = F.lit(True)
    for c in cs:
        out = out & F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    return out


def above(c: Column, limit: float | Column) -> Column:
    """``c > limit`` where NaN is above nothing."""
    return ~F.isnan(c) & (c > limit)


def norm3(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def nan_median(c: Column) -> Column:
    """Median of a group; NaN if any value is NaN, null for no value."""
    return F.when(F.max(F.isnan(c)), F.lit(float("nan"))).otherwise(F.median(c))


def medians(names: list[str], prefix: str = "") -> list[Column]:
    return [nan_median(F.col(n)).alias(prefix + n) for n in names]


def rounded(*names: str, places: int = 6) -> list[Column]:
    """Coordinates for comparison: rounded, without negative zero."""
    return [(F.round(n, places) + F.lit(0.0)).alias(n) for n in names]
