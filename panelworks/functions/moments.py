"""Guarded aggregate statistics (Spark's own ``corr`` fails on a constant side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def paired(a: Column, b: Column) -> tuple[Column, Column]:
    """Both columns, NULL wherever either one is missing."""
    return F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)


def pearson(a: Column, b: Column, min_count: int = 2, floor: float = 0.0, strict: bool = True) -> Column:
    """Pearson correlation, NULL below ``min_count`` pairs or for a flat side.

    A side is flat when its population deviation is ``<= floor`` (``strict``)
    or ``< floor`` (otherwise).
    """
    x, y = paired(a, b)
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    usable = (sx > floor) & (sy > floor) if strict else (sx >= floor) & (sy >= floor)
    return F.when((F.count(x) >= min_count) & usable, F.covar_pop(x, y) / (sx * sy))
