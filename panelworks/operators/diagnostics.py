"""Factor diagnostics: autocorrelation, IC decay, turnover, capacity, exposure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.functions.moments import pearson
from panelworks.operators import grid
from panelworks.operators.ranking import ordinal_rank, with_group_stats

# Fixed values of the diagnostics.
MIN_PAIRS = 3
FLAT = 1e-12


def autocorrelation(values: DataFrame, lag: int = 1) -> DataFrame:
    """Mean cross-sectional correlation of a factor with itself ``lag`` days earlier."""
    by_cell = Window.partitionBy("factor_id", "symbol").orderBy("d").rangeBetween(-lag, -lag)
    earlier = F.max("value").over(by_cell)
    daily = (
        values.select("factor_id", "symbol", "d", "value", earlier.alias("earlier"))
        .groupBy("factor_id", "d")
        .agg(pearson(F.col("value"), F.col("earlier"), MIN_PAIRS, FLAT).alias("corr"))
    )
    return daily.groupBy("factor_id").agg(F.avg("corr").alias("autocorrelation"))


def forward_columns(max_horizon: int) -> dict[str, Column]:
    """``fwd_1 .. fwd_H`` for the wide panel, all from one window pass."""
    return {f"fwd_{h}": grid.forward_return(h) for h in range(1, max(1, max_horizon) + 1)}


def ic_decay(values: DataFrame, max_horizon: int) -> DataFrame:
    """Mean Pearson IC per horizon; ``values`` carries ``fwd_1 .. fwd_H``.

    All horizons are aggregated in one pass over the pairs instead of repeating
    every cell per horizon.
    """
    horizons = range(1, max(1, max_horizon) + 1)
    day = [name for name in ("slot", "factor_id", "d") if name in values.columns]
    daily = values.groupBy(*day).agg(
        *[pearson(F.col("value"), F.col(f"fwd_{h}"), MIN_PAIRS, FLAT).alias(f"ic_{h}") for h in horizons]
    )
    means = daily.groupBy("factor_id").agg(*[F.avg(f"ic_{h}").alias(f"ic_{h}") for h in horizons])
    curve = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"ic_{h}").alias("ic")) for h in horizons]))
    return means.select("factor_id", curve.alias("point")).select("factor_id", "point.*")


def topk_turnover(values: DataFrame, top_k: int, group_rows: int) -> DataFrame:
    """Mean share of new top-k members between consecutive non-empty days."""
    key = ["factor_id", "d"]
    order = ["value", "symbol"]
    day = ["d", "slot"] if "slot" in values.columns else key
    ranked = with_group_stats(values, day, {"n": F.count(F.lit(1))}, group_rows, order=order)
    ranked = ordinal_rank(ranked, day, order, "k", group_rows)
    members = ranked.where(F.col("k") > F.col("n") - F.least(F.lit(top_k), F.col("n"))).select("factor_id", "d", "symbol")
    # factors x calendar rows
    days = (
        members.select("factor_id", "d")
        .distinct()
        .withColumn("previous", F.lag("d").over(Window.partitionBy("factor_id").orderBy("d")))
    )
    last_seen = F.lag("d").over(Window.partitionBy("factor_id", "symbol").orderBy("d"))
    moves = (
        members.withColumn("last_seen", last_seen)
        .join(F.broadcast(days.where(F.col("previous").isNotNull())), key)
        .groupBy(*key)
        .agg(
            (
                F.count_if(F.col("last_seen").isNull() | (F.col("last_seen") != F.col("previous"))) / F.count(F.lit(1))
            ).alias("share")
        )
    )
    factors = days.select("factor_id").distinct()
    means = moves.groupBy("factor_id").agg(F.avg("share").alias("turnover"))
    return factors.join(means, "factor_id", "left").fillna(0.0, ["turnover"])


def capacity_proxy(panel: DataFrame, participation: float = 0.1, weight: str | None = None) -> DataFrame:
    """Traded volume per calendar day times a participation rate.

    The unit is volume although the figure is called notional. ``weight`` adds
    the share of the largest positive weight.
    """
    traded = F.coalesce(F.sum(F.when(F.col("volume") > 0, F.col("volume"))), F.lit(0.0))
    positive = F.when(F.col(weight) > 0, F.col(weight)) if weight else F.lit(None).cast("double")
    return panel.agg(
        (traded / F.greatest(F.max("d") + 1, F.lit(1)) * participation).alias("daily_notional_capacity_proxy"),
        F.lit(participation).alias("participation_rate"),
        (F.max(positive) / F.sum(positive)).alias("max_weight_concentration"),
    )


def exposures(latest: DataFrame) -> DataFrame:
    """Correlation of the latest factor values with size and liquidity.

    ``latest`` holds ``factor_id, value, market_cap, liquidity``.
    """
    value = F.col("value")
    size = F.when(F.col("market_cap") > 0, F.ln("market_cap"))
    return latest.groupBy("factor_id").agg(
        pearson(value, size, MIN_PAIRS, FLAT).alias("size_exposure"),
        pearson(value, F.col("liquidity"), MIN_PAIRS, FLAT).alias("liquidity_exposure"),
    )


def industry_exposures(latest: DataFrame, industries: DataFrame) -> DataFrame:
    """Correlation with every industry's membership flag, in closed form.

    The correlation with a 0/1 flag follows from the industry's count and mean,
    so no flag columns are built. Industries without a valued symbol get NULL.
    """
    cells = latest.where(F.col("value").isNotNull())
    whole = cells.groupBy("factor_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("dev")
    )
    parts = cells.groupBy("factor_id", "industry").agg(F.count(F.lit(1)).alias("k"), F.avg("value").alias("part_mean"))
    names = industries.select("industry").distinct()
    share = F.col("k") / F.col("n")
    spread = F.sqrt(share * (1 - share))
    usable = (F.col("n") >= MIN_PAIRS) & (F.col("dev") > FLAT) & (spread > FLAT)
    corr = F.when(usable, share * (F.col("part_mean") - F.col("mean")) / (F.col("dev") * spread))
    # factors x industries: report-sized
    return (
        whole.crossJoin(F.broadcast(names))
        .join(parts, ["factor_id", "industry"], "left")
        .select("factor_id", "industry", corr.alias("exposure"))
    )


def diagnostics_bundle(values: DataFrame, max_horizon: int, top_k: int, group_rows: int) -> DataFrame:
    """Autocorrelation, top-k turnover and the IC decay of each factor, one row each."""
    horizons = range(1, max_horizon + 1)
    decay = ic_decay(values, max_horizon).groupBy("factor_id").agg(
        *[F.max(F.when(F.col("horizon") == h, F.col("ic"))).alias(f"ic_decay_{h}") for h in horizons]
    )
    lagged = autocorrelation(values)
    return lagged.join(topk_turnover(values, top_k, group_rows), "factor_id").join(decay, "factor_id")
