"""Cross-section neutralisation and the IC that survives it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.operators import evaluate as ev

# Fixed value: ridge added to the Gram diagonal.
RIDGE = 1e-10


def _solve_days(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Regression coefficients from one Gram matrix per row (one row per day)."""
    for batch in batches:
        k = len(batch["xy"].iloc[0]) if len(batch) else 0
        solved = []
        for gram, xy in zip(batch["gram"], batch["xy"], strict=True):
            matrix = np.asarray(gram, dtype=float).reshape(k, k) + RIDGE * np.eye(k)
            try:
                solved.append(np.linalg.solve(matrix, np.asarray(xy, dtype=float)).tolist())
            except np.linalg.LinAlgError:
                solved.append(None)
        yield batch.drop(columns=["gram", "xy"]).assign(beta=solved)


def neutralize(values: DataFrame, exposures: Sequence[str]) -> DataFrame:
    """Replace ``value`` by its regression residual plus the day's mean.

    Per factor and day the Gram sums are plain aggregates with map-side combine;
    only the resulting k x k systems (one per factor and day) are solved in
    Python. Days with too few complete cells keep their values; on other days a
    cell with a missing exposure becomes NULL.
    """
    key = ["factor_id", "d"]
    k = len(exposures)
    complete = F.col("value").isNotNull()
    for name in exposures:
        complete = complete & F.col(name).isNotNull()
    y = F.when(complete, F.col("value"))
    x = [F.when(complete, F.col(name)) for name in exposures]
    n = F.count(y)
    moments = values.groupBy(*key).agg(
        n.alias("n"),
        F.avg(y).alias("y_mean"),
        F.array(*[F.avg(c) for c in x]).alias("x_mean"),
        F.array(*[F.covar_pop(a, b) * n for a in x for b in x]).alias("gram"),
        F.array(*[F.covar_pop(c, y) * n for c in x]).alias("xy"),
    )
    moments = moments.where(F.col("n") >= max(3, k + 2))
    if k == 1:
        fitted = moments.withColumn("beta", F.array(F.col("xy")[0] / (F.col("gram")[0] + RIDGE))).drop("gram", "xy")
    else:
        schema = "factor_id string, d int, n long, y_mean double, x_mean array<double>, beta array<double>"
        fitted = moments.mapInPandas(_solve_days, schema)
    # factors x calendar rows
    joined = values.join(F.broadcast(fitted.where(F.col("beta").isNotNull())), key, "left")
    explained = sum(
        (F.col("beta")[i] * (F.col(name) - F.col("x_mean")[i]) for i, name in enumerate(exposures)), F.lit(0.0)
    )
    value = F.when(F.col("beta").isNull(), F.col("value")).when(complete, F.col("value") - explained)
    return joined.withColumn("value", value).drop("n", "y_mean", "x_mean", "beta")


def neutralize_by_group(values: DataFrame, group: str) -> DataFrame:
    """Industry neutralisation: remove the day's group mean, keep the day's mean.

    Equals the regression on one flag per group up to the ridge.
    """
    sums = values.where(F.col("value").isNotNull()).groupBy("factor_id", "d", group)
    parts = sums.agg(F.count(F.lit(1)).alias("_n"), F.avg("value").alias("_part"))
    days = parts.groupBy("factor_id", "d").agg((F.sum(F.col("_n") * F.col("_part")) / F.sum("_n")).alias("_mean"))
    joined = values.join(parts.drop("_n"), ["factor_id", "d", group]).join(F.broadcast(days), ["factor_id", "d"])
    return joined.withColumn("value", F.col("value") - F.col("_part") + F.col("_mean")).drop("_part", "_mean")


def daily_spearman(values: DataFrame, group_rows: int, forward: str = "fwd") -> DataFrame:
    """Ordinal-rank correlation with the forward return per factor and day."""
    daily = ev.daily_ic(ev.ranked_pairs(values.where(F.col("value").isNotNull()), group_rows, forward), forward)
    return daily.where(F.col("rank_ic").isNotNull()).select("factor_id", "d", "rank_ic")


def neutralized_ic_report(values: DataFrame, neutral: DataFrame, group_rows: int) -> DataFrame:
    """Mean raw and neutralised IC over the days where both exist."""
    raw = daily_spearman(values, group_rows).withColumnRenamed("rank_ic", "raw")
    kept = daily_spearman(neutral, group_rows).withColumnRenamed("rank_ic", "kept")
    report = (
        raw.join(kept, ["factor_id", "d"])
        .groupBy("factor_id")
        .agg(F.avg("raw").alias("raw_ic"), F.avg("kept").alias("neutralized_ic"), F.count(F.lit(1)).alias("evaluated_days"))
    )
    ratio = F.when(F.abs("raw_ic") > 1e-9, F.col("neutralized_ic") / F.col("raw_ic"))
    return report.withColumn("ic_retained_ratio", ratio)
