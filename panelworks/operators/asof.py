"""Point-in-time attachment of slow facts to bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, take: Sequence[str]
) -> DataFrame:
    """Attach the latest ``right`` row not after each ``left`` row.

    Both sides are stacked and the last fact is carried forward inside each
    key, ordered by time with facts ahead of bars of the same instant. This is
    one exchange by key and one sort; no range join. Duplicate facts of one
    instant must be resolved by the caller.
    """
    facts = right.select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*take).alias("_fact"))
    rows = left.withColumns({"_t": F.col(left_time), "_side": F.lit(1)})
    stacked = rows.unionByName(facts, allowMissingColumns=True)
    carried = F.last("_fact", ignorenulls=True).over(
        Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        stacked.withColumn("_fact", carried)
        .where(F.col("_side") == 1)
        .select(*left.columns, *[F.col(f"_fact.{name}").alias(name) for name in take])
    )


def attach_turnover(bars: DataFrame, capital: DataFrame) -> DataFrame:
    """``turnover = volume / latest announced capital``; a gap is 0 with its flag at 0."""
    usable = capital.where(F.col("announce_date").isNotNull() & (F.col("circulating_capital") > 0))
    joined = asof_backward(bars, usable, ["symbol"], "trading_date", "announce_date", ["circulating_capital"])
    ratio = F.col("volume") / F.col("circulating_capital")
    return joined.withColumns(
        {"turnover": F.coalesce(ratio, F.lit(0.0)), "turnover_observed": ratio.isNotNull().cast("double")}
    ).drop("circulating_capital")


def attach_status(bars: DataFrame, status: DataFrame) -> DataFrame:
    """``is_st`` from a per-day status table, one row per key, absent means 0."""
    unique = status.dropDuplicates(["symbol", "trading_date"])
    flag = F.coalesce(F.col("is_st_history").cast("double"), F.lit(0.0))
    return bars.join(unique, ["symbol", "trading_date"], "left").withColumn("is_st", flag).drop("is_st_history")
