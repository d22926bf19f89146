"""Stability of a factor's IC over time and market regimes.

All inputs have one row per factor and day, so every window here is bounded by
the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.functions.moments import pearson

# Fixed values of the regime rule, in order of precedence.
HIGH_VOLATILITY = 0.03
LOW_VOLATILITY = 0.012
TREND = 0.0008
REGIME_HISTORY = 20
FLAT = 1e-12


def classify_regimes(market: DataFrame, history: int = REGIME_HISTORY) -> DataFrame:
    """Label each day of one market series (``d, market_return``) by its recent past.

    The frame is the day and ``history`` days before it, shorter at the start.
    """
    frame = Window.orderBy("d").rowsBetween(-history, 0)
    mean, dev = F.avg("market_return").over(frame), F.stddev_pop("market_return").over(frame)
    regime = (
        F.when(dev > HIGH_VOLATILITY, "high_vol")
        .when(dev < LOW_VOLATILITY, "low_vol")
        .when(mean > TREND, "bull")
        .when(mean < -TREND, "bear")
        .otherwise("range")
    )
    return market.withColumn("regime", regime)


def _summary() -> list[Column]:
    dev = F.stddev_pop("rank_ic")
    return [
        F.avg("rank_ic").alias("ic_mean"),
        F.when(dev > FLAT, F.avg("rank_ic") / dev).otherwise(0.0).alias("icir"),
        F.count(F.lit(1)).alias("days"),
    ]


def subperiods(ics: DataFrame, parts: int = 4) -> DataFrame:
    """IC summary of ``parts`` near-equal stretches of each factor's IC days."""
    part = F.ntile(parts).over(Window.partitionBy("factor_id").orderBy("d")) - 1
    return ics.withColumn("subperiod", part).groupBy("factor_id", "subperiod").agg(*_summary())


def regime_summary(ics: DataFrame, regimes: DataFrame) -> DataFrame:
    """IC summary per regime.

    IC days and regime labels are matched by their running number, not by date:
    the n-th IC day of a factor takes the n-th label.
    """
    numbered = ics.withColumn("position", F.row_number().over(Window.partitionBy("factor_id").orderBy("d")))
    labels = regimes.select(F.row_number().over(Window.orderBy("d")).alias("position"), "regime")
    return numbered.join(F.broadcast(labels), "position").groupBy("factor_id", "regime").agg(*_summary())


def stability_report(ics: DataFrame, regimes: DataFrame | None = None) -> DataFrame:
    """Worst regime IC, sign consistency and lag-1 autocorrelation per factor."""
    ordered = Window.partitionBy("factor_id").orderBy("d")
    whole = Window.partitionBy("factor_id")
    lagged = ics.withColumns({"next": F.lead("rank_ic").over(ordered), "mean": F.avg("rank_ic").over(whole)})
    agrees = (F.signum("rank_ic") == F.signum("mean")).cast("double")
    report = lagged.groupBy("factor_id").agg(
        F.count(F.lit(1)).alias("ic_days"),
        F.min("rank_ic").alias("worst_day_ic"),
        F.when(F.abs(F.first("mean")) > 1e-9, F.avg(agrees)).otherwise(0.0).alias("ic_sign_consistency"),
        F.when(
            (F.count(F.lit(1)) > 2) & (F.stddev_pop("rank_ic") > FLAT), pearson(F.col("rank_ic"), F.col("next"))
        )
        .otherwise(0.0)
        .alias("rank_stability"),
    )
    if regimes is None:
        return report.withColumnRenamed("worst_day_ic", "worst_regime_ic")
    worst = regime_summary(ics, regimes).groupBy("factor_id").agg(F.min("ic_mean").alias("worst_regime_ic"))
    return report.drop("worst_day_ic").join(worst, "factor_id", "left")
