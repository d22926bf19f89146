"""Implementation cost, fillability and capacity of a factor.

Cells are dense: one row per ``factor_id``, symbol and calendar day with ``value``
(NULL where missing), ``close``, ``amount``, ``tradable``, ``halted``, ``limit_hit``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.functions.elementwise import finite


@dataclass(frozen=True)
class TradingCosts:
    commission_bps: float = 3.0
    spread_bps: float = 2.0
    impact_bps: float = 5.0
    stamp_tax_bps: float = 5.0

    @property
    def total(self) -> float:
        return self.commission_bps + self.spread_bps + self.impact_bps + self.stamp_tax_bps


@dataclass(frozen=True)
class TradingPolicy:
    max_limit_hit_rate: float = 0.05
    max_halt_exposure: float = 0.05
    max_participation_rate: float = 0.25
    max_turnover: float = 0.80
    min_average_daily_amount: float = 1_000_000.0
    min_net_annualized_return: float = 0.0
    annualization_days: int = 250


PARTICIPATION_RATES = (0.01, 0.025, 0.05, 0.10, 0.20)
HOLDING_PERIODS = (1, 5, 10)
BASE_RATE = 0.01


def with_state(cells: DataFrame, horizons: Sequence[int] = HOLDING_PERIODS) -> DataFrame:
    """Add validity, direction and forward returns; one exchange per factor and symbol."""
    ordered = Window.partitionBy("factor_id", "symbol").orderBy("d")
    valid = (
        F.col("value").isNotNull()
        & F.coalesce(F.col("close") > 0, F.lit(False))
        & F.coalesce(F.col("tradable") > 0, F.lit(False))
    )
    ahead = {
        f"_f{h}": finite(F.when(F.col("close") != 0, F.lead("close", h).over(ordered) / F.col("close") - 1))
        for h in dict.fromkeys((1, *horizons))
    }
    return cells.withColumns({"valid": valid, "direction": F.coalesce(F.signum("value"), F.lit(0.0)), **ahead})


def weight_turnover(cells: DataFrame, holding: Column) -> DataFrame:
    """Mean half L1 change of the day-demeaned, L1-normalised holdings.

    Day totals are aggregated and joined back (factors x calendar rows), so no
    task holds a whole day.
    """
    key = ["factor_id", "d"]
    held = cells.select(*key, "symbol", holding.alias("h"))
    means = held.groupBy(*key).agg(F.avg("h").alias("_m"))
    centred = held.join(F.broadcast(means), key).withColumn("c", F.col("h") - F.col("_m")).drop("_m", "h")
    scales = centred.groupBy(*key).agg(F.sum(F.abs("c")).alias("_s"))
    weights = centred.join(F.broadcast(scales), key).withColumn(
        "w", F.when(F.col("_s") > 0, F.col("c") / F.col("_s")).otherwise(0.0)
    )
    previous = F.lag("w").over(Window.partitionBy("factor_id", "symbol").orderBy("d"))
    moves = weights.withColumn("move", F.abs(F.col("w") - previous)).groupBy(*key).agg(F.sum("move").alias("move"))
    return moves.groupBy("factor_id").agg(F.coalesce(F.avg("move") / 2, F.lit(1.0)).alias("turnover"))


def _participation(state: DataFrame) -> DataFrame:
    """Mean share of the day's traded amount that sits under the factor's weights."""
    held = F.when(F.col("valid"), F.abs("value")).otherwise(0.0)
    daily = state.groupBy("factor_id", "d").agg(
        F.sum(held).alias("scale"),
        F.sum(held * F.coalesce("amount", F.lit(0.0))).alias("traded"),
        F.sum(F.when(F.col("valid"), F.col("amount"))).alias("available"),
    )
    usable = (F.col("scale") > 0) & (F.col("available") > 0)
    rate = F.when(usable, F.col("traded") / F.col("scale") / F.col("available")).otherwise(0.0)
    return daily.groupBy("factor_id").agg(F.avg(rate).alias("weight_share"))


def assess(cells: DataFrame, costs: TradingCosts | None = None, policy: TradingPolicy | None = None) -> DataFrame:
    """One row per factor: gross and net return, turnover, rates, verdict and reasons."""
    costs, policy = costs or TradingCosts(), policy or TradingPolicy()
    state = with_state(cells)
    forward = F.col("valid") & F.col("_f1").isNotNull()
    signed = F.when(forward, F.col("direction") * F.col("_f1"))
    daily = state.groupBy("factor_id", "d").agg(
        F.avg(signed).alias("gross"),
        F.count_if(forward).alias("_fw"),
        F.count_if(forward & F.coalesce(F.col("limit_hit") > 0, F.lit(False))).alias("_lim"),
        F.count_if("valid").alias("_ok"),
        F.count_if(F.col("valid") & F.coalesce(F.col("halted") > 0, F.lit(False))).alias("_halt"),
    )
    rates = daily.groupBy("factor_id").agg(
        F.coalesce(F.avg("gross"), F.lit(0.0)).alias("gross_return"),
        F.when(F.sum("_fw") > 0, F.sum("_lim") / F.sum("_fw")).otherwise(1.0).alias("limit_hit_rate"),
        F.when(F.sum("_ok") > 0, F.sum("_halt") / F.sum("_ok")).otherwise(1.0).alias("halt_exposure"),
    )
    held = F.when(F.col("valid"), F.col("value")).otherwise(0.0)
    joined = rates.join(weight_turnover(state, held), "factor_id").join(_participation(state), "factor_id")
    average = capacity_input(cells)
    joined = joined.join(average, "factor_id", "left")
    drag = F.col("turnover") * costs.total / 10_000
    measured = joined.withColumns(
        {
            "net_return": F.least(F.col("gross_return"), F.col("gross_return") - drag),
            "participation_rate": F.col("weight_share") * F.col("turnover"),
            "cost_drag_bps": drag * 10_000,
        }
    )
    rules = [
        (F.col("limit_hit_rate") > policy.max_limit_hit_rate, "LIMIT_FILLABILITY_FAILED"),
        (F.col("halt_exposure") > policy.max_halt_exposure, "HALT_EXPOSURE_FAILED"),
        (F.col("turnover") > policy.max_turnover, "HIGH_TURNOVER_FAILED"),
        (F.col("participation_rate") > policy.max_participation_rate, "PARTICIPATION_RATE_FAILED"),
        (F.coalesce("average_amount", F.lit(0.0)) < policy.min_average_daily_amount, "CAPACITY_FAILED"),
        (
            F.col("net_return") * policy.annualization_days < policy.min_net_annualized_return,
            "NET_RETURN_BELOW_POLICY_MINIMUM",
        ),
    ]
    reasons = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for rule, name in rules]))
    return measured.withColumn("reasons", reasons).select(
        "factor_id",
        "gross_return",
        "net_return",
        (F.col("net_return") * policy.annualization_days).alias("net_annualized_return"),
        "turnover",
        "cost_drag_bps",
        "limit_hit_rate",
        "halt_exposure",
        "participation_rate",
        "average_amount",
        "reasons",
        (F.size("reasons") == 0).alias("passed"),
    )


def holding_sensitivity(cells: DataFrame, horizons: Sequence[int] = HOLDING_PERIODS) -> DataFrame:
    """Mean signed return per holding period, all periods in one pass."""
    state = with_state(cells, horizons)
    means = state.groupBy("factor_id").agg(
        *[
            F.coalesce(F.avg(F.when(F.col("valid"), F.col("direction") * F.col(f"_f{h}"))), F.lit(0.0)).alias(f"h{h}")
            for h in horizons
        ]
    )
    points = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"h{h}").alias("mean_return")) for h in horizons]))
    return means.select("factor_id", points.alias("p")).select("factor_id", "p.*")


def capacity_input(cells: DataFrame) -> DataFrame:
    """Mean over days of the mean traded amount of tradable symbols."""
    usable = (F.col("amount") > 0) & (F.col("tradable") > 0)
    daily = cells.groupBy("factor_id", "d").agg(F.avg(F.when(usable, F.col("amount"))).alias("_a"))
    return daily.groupBy("factor_id").agg(F.avg("_a").alias("average_amount"))


def capacity_curve(
    cells: DataFrame,
    gross: DataFrame,
    costs: TradingCosts | None = None,
    policy: TradingPolicy | None = None,
    rates: Sequence[float] = PARTICIPATION_RATES,
) -> DataFrame:
    """Deployable capital, impact-scaled cost and net return per participation rate."""
    costs, policy = costs or TradingCosts(), policy or TradingPolicy()
    if any(not 0 < r <= 1 for r in rates):
        raise ValueError("participation rates must lie in (0, 1]")
    turnover = weight_turnover(cells, F.coalesce("value", F.lit(0.0)))
    joined = capacity_input(cells).join(turnover, "factor_id").join(gross.select("factor_id", "gross_return"), "factor_id")
    rate = F.col("participation_rate")
    cost = costs.total * F.greatest(F.lit(1.0), F.sqrt(rate / BASE_RATE))
    capital = F.coalesce("average_amount", F.lit(0.0)) * rate / F.greatest("turnover", F.lit(1e-12))
    net = F.least(F.col("gross_return"), F.col("gross_return") - F.col("turnover") * cost / 10_000)
    return joined.withColumn("participation_rate", F.explode(F.array(*[F.lit(r) for r in rates]))).select(
        "factor_id",
        "participation_rate",
        capital.alias("max_capital"),
        cost.alias("estimated_cost_bps"),
        (net * policy.annualization_days).alias("net_annualized_return"),
    )


# The contract a formal snapshot reference must carry.
SNAPSHOT_CONTRACT = "market-snapshot.v1"


def verdict(assessed: DataFrame, evidence: DataFrame) -> DataFrame:
    """Verdict of each assessment with the inputs it was made from; missing inputs lead the reasons.

    ``assessed`` is as from ``assess``; ``evidence`` holds per ``factor_id``: ``formal``, ``calibration`` and
    ``expected_calibration`` (hashes or NULL), ``has_tradable``, ``has_amount``, ``market_snapshot_id``,
    ``ref_snapshot_id``, ``ref_hash`` and ``contract`` (all three NULL: no reference). Without evidence every input is
    missing and the report is exploratory. An exploratory report never passes.
    """
    joined = assessed.join(evidence, "factor_id", "left")
    flag = {n: F.coalesce(n, F.lit(False)) for n in ("formal", "has_tradable", "has_amount")}
    expected = F.col("expected_calibration")
    no_reference = F.coalesce("ref_snapshot_id", "ref_hash", "contract").isNull()
    fits = (
        F.col("ref_snapshot_id").eqNullSafe(F.col("market_snapshot_id"))
        & (F.coalesce("ref_hash", F.lit("")) != "")
        & F.col("contract").eqNullSafe(F.lit(SNAPSHOT_CONTRACT))
    )
    inputs = [
        (F.col("calibration").isNull(), "EXECUTION_COST_CALIBRATION_MISSING"),
        (flag["formal"] & expected.isNull(), "EXPECTED_EXECUTION_COST_CALIBRATION_MISSING"),
        (expected.isNotNull() & ~F.col("calibration").eqNullSafe(expected), "EXECUTION_COST_CALIBRATION_MISMATCH"),
        (~flag["has_tradable"], "TRADABILITY_FLAGS_MISSING"),
        (~flag["has_amount"], "VOLUME_OR_AMOUNT_MISSING"),
        (flag["formal"] & no_reference, "MARKET_SNAPSHOT_REF_MISSING"),
        (flag["formal"] & ~no_reference & ~fits, "MARKET_SNAPSHOT_MISMATCH"),
    ]
    missing = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for rule, name in inputs]))
    odd = finite(F.col("gross_return")).isNull() | finite(F.col("net_return")).isNull()
    # the return rule stands last, after the one on figures that are no numbers
    below = F.lit("NET_RETURN_BELOW_POLICY_MINIMUM")
    order = F.concat(
        F.array_except("reasons", F.array(below)),
        F.when(odd, F.array(F.lit("NONFINITE_METRIC"))).otherwise(F.array().cast("array<string>")),
        F.array_intersect("reasons", F.array(below)),
    )
    eligible = flag["formal"] & (F.size("missing") == 0)
    return joined.withColumn("missing", missing).select(
        "factor_id",
        F.concat("missing", order).alias("reasons"),
        eligible.alias("formal_eligible"),
        (eligible & (F.size(F.concat("missing", order)) == 0)).alias("passed"),
        F.when(flag["formal"], "FORMAL_RESEARCH").otherwise("EXPLORATORY_REPORT").alias("metric_scope"),
        (~flag["formal"]).alias("report_only"),
    )
