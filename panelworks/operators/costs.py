"""Sensitivity of a rebalanced selection to trading costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
DAYS_PER_YEAR = 250
COST_STEPS_BPS = (5, 10, 20, 50)
BREAK_EVEN_LIMIT_BPS = 500.0


def cost_sensitivity(periods: DataFrame, horizon: int) -> DataFrame:
    """Annual return after several costs and the cost that uses it up.

    ``periods`` holds ``range_name, factor_id, period, members, entered,
    period_return``. The return falls linearly with the cost, so the break-even
    is a quotient limited to [0, 500] bps.
    """
    later = F.when(F.col("period") > 0, F.col("entered") / F.col("members"))
    yearly = DAYS_PER_YEAR / horizon
    base = periods.groupBy("range_name", "factor_id").agg(
        F.coalesce(F.avg(later), F.lit(1.0)).alias("turnover_proxy"),
        (F.avg("period_return") * yearly).alias("base"),
    )
    drag = F.col("turnover_proxy") * yearly / 10_000

    def after(bps: float) -> Column:
        return F.col("base") - bps * drag

    break_even = (
        F.when(F.col("base") <= 0, 0.0)
        .when(drag == 0, BREAK_EVEN_LIMIT_BPS)
        .otherwise(F.least(F.lit(BREAK_EVEN_LIMIT_BPS), F.col("base") / F.when(drag != 0, drag)))
    )
    return base.select(
        "range_name",
        "factor_id",
        "turnover_proxy",
        *[after(bps).alias(f"return_after_{bps}bps") for bps in COST_STEPS_BPS],
        break_even.alias("break_even_cost_bps"),
    )
