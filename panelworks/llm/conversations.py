"""Turns of conversations in order, numbered without holding a whole conversation in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.llm.common import kept
from panelworks.operators.ranking import ordinal_rank

#: Rows of one conversation that a task may order or sum by itself.
ROWS_PER_TASK = 1_000_000


def longest(rows: DataFrame, key: str) -> int:
    """Rows of the longest conversation."""
    return int(rows.groupBy(key).count().agg(F.max("count")).first()[0] or 0)


def numbered(rows: DataFrame, key: str, order: Sequence[str], limit: int = ROWS_PER_TASK) -> DataFrame:
    """``rows`` with ``pos``, the 1-based place within ``key`` by ``order`` (NULLs first)."""
    return ordinal_rank(rows, [key], order, "pos", longest(rows, key), limit)


def running_sums(
    rows: DataFrame, key: str, position: str, sums: dict[str, Column], rows_of: str, large: bool, block: int = ROWS_PER_TASK
) -> DataFrame:
    """Running sums by ``position`` (from 1) and, as ``rows_of``, the rows of ``key``.

    With ``large`` a key is cut into blocks of positions, and each block starts from the sums of the earlier ones.
    """
    if not large:
        by = Window.partitionBy(key)
        before = by.orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({n: F.sum(c).over(before) for n, c in sums.items()} | {rows_of: F.count(F.lit(1)).over(by)})
    cut = kept(rows.withColumns({n: c for n, c in sums.items()}).withColumn("_block", F.floor((F.col(position) - 1) / block)))
    parts = cut.groupBy(key, "_block").agg(*[F.sum(n).alias(f"_{n}") for n in sums], F.count(F.lit(1)).alias("_rows"))
    by = Window.partitionBy(key)
    earlier = by.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        key,
        "_block",
        *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums],
        F.sum("_rows").over(by).alias(rows_of),
    )
    inside = Window.partitionBy(key, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.withColumns({n: F.sum(n).over(inside) for n in sums}).join(parts, [key, "_block"])
    return summed.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_block", *[f"_{n}" for n in sums])
