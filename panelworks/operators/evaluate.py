"""Information coefficients, top-k portfolios and their summary per range."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.functions.moments import pearson
from panelworks.operators.ranking import ordinal_rank, with_group_stats
from panelworks.session import stored

# Fixed values of the evaluation.
DAYS_PER_YEAR = 250
TURNOVER_COST = 0.001
MIN_PAIRS = 10
FLAT = 1e-12
ICIR_FALLBACK = 0.01
#: Factor values that are exchanged at a time.
BATCH_CELLS = 1_000_000_000


@dataclass(frozen=True)
class Thresholds:
    min_coverage: float = 0.6
    min_rank_ic: float = 0.02
    min_icir: float = 0.3
    min_excess: float = 0.0


@dataclass(frozen=True)
class DayRange:
    """A named evaluation range ``[start, end)`` over a calendar of ``n_days``."""

    name: str
    start: int
    end: int
    n_days: int

    def last_day(self, horizon: int) -> int:
        return min(self.end, self.n_days - horizon)

    def last_forward(self, horizon: int) -> int:
        """First day whose forward return would look past the range."""
        return max(0, min(self.n_days - horizon, self.end - horizon))


def full_range(n_days: int, horizon: int, eval_window: int | None = None, name: str = "full") -> DayRange:
    start = max(0, n_days - horizon - eval_window) if eval_window else 0
    return DayRange(name, start, n_days, n_days)


def ranked_pairs(values: DataFrame, group_rows: int, forward: str = "fwd") -> DataFrame:
    """Cells with a factor value and a forward return, ranked on both per day."""
    key = ["d", "slot"] if "slot" in values.columns else ["factor_id", "d"]
    by_value = ["sort_value" if "sort_value" in values.columns else "value", "symbol"]
    pairs = values.where(F.col(forward).isNotNull())
    pairs = with_group_stats(pairs, key, {"n": F.count(F.lit(1))}, group_rows, order=by_value)
    pairs = ordinal_rank(pairs, key, by_value, "value_rank", group_rows)
    return ordinal_rank(pairs, key, [forward, "symbol"], "forward_rank", group_rows)


def rank_correlation(x: Column, y: Column) -> Column:
    """Correlation of two permutations of 1..n, from integer sums only."""
    n = F.count(F.lit(1)).cast("double")
    gap = (x - y).cast("double")
    return F.when(n > 1, 1 - 6 * F.sum(gap * gap) / (n * (n * n - 1)))


def daily_ic(pairs: DataFrame, forward: str = "fwd", top_k: int = 0) -> DataFrame:
    """Per factor and day: pair count, both ICs, mean forward return, top-k mean.

    ``ic`` and ``rank_ic`` are NULL on a day with too few pairs or a flat side.
    The pairs are already placed by factor and day, so this adds no exchange.
    """
    value, fwd = F.col("value"), F.col(forward)
    usable = (F.count(F.lit(1)) >= MIN_PAIRS) & (F.stddev_pop(value) >= FLAT) & (F.stddev_pop(fwd) >= FLAT)
    key = ["d", "slot", "factor_id"] if "slot" in pairs.columns else ["factor_id", "d"]
    daily = pairs.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        pearson(value, fwd, MIN_PAIRS, FLAT, strict=False).alias("ic"),
        F.when(usable, rank_correlation(F.col("value_rank"), F.col("forward_rank"))).alias("rank_ic"),
        F.avg(fwd).alias("mean_forward"),
        F.avg(F.when(in_top(top_k), fwd)).alias("top_forward"),
    )
    return daily.drop("slot")


def in_top(top_k: int) -> Column:
    """Membership of the ``top_k`` largest values of the day, by rank."""
    return F.col("value_rank") > F.col("n") - F.least(F.lit(top_k), F.col("n"))


def rank_ic_series(pairs: DataFrame) -> DataFrame:
    """Rank IC of every day with enough pairs (no flatness rule), as a series."""
    key = ["d", "slot", "factor_id"] if "slot" in pairs.columns else ["factor_id", "d"]
    daily = pairs.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        rank_correlation(F.col("value_rank"), F.col("forward_rank")).alias("rank_ic"),
    )
    return daily.where(F.col("n") >= MIN_PAIRS).drop("slot")


def spaced_days(days: Column, gap: int, first: Column) -> Column:
    """Greedy subset of a sorted day array: keep a day at least ``gap`` after the last kept."""
    start = F.struct((first - gap).cast("int").alias("last"), F.array().cast("array<int>").alias("kept"))
    return F.aggregate(
        days,
        start,
        lambda acc, day: F.when(
            day - acc["last"] >= gap,
            F.struct(day.alias("last"), F.array_append(acc["kept"], day).alias("kept")),
        ).otherwise(acc),
        lambda acc: acc["kept"],
    )


def range_column(ranges: Sequence[DayRange], horizon: int) -> Column:
    """The evaluation ranges as one literal array of structs."""
    return F.array(
        *[
            F.struct(
                F.lit(r.name).alias("name"),
                F.lit(max(0, r.start)).alias("day_from"),
                F.lit(r.last_day(horizon)).alias("day_to"),
                F.lit(min(r.last_day(horizon), r.last_forward(horizon))).alias("usable_to"),
            )
            for r in ranges
        ]
    )


def array_mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(values) > 0, total / F.size(values))


def range_series(daily: DataFrame, ranges: Sequence[DayRange], horizon: int) -> DataFrame:
    """Per factor and range: the usable days in order and the rebalancing days among them.

    A factor's days are one array of small structs, so it is bounded by the
    calendar; the single exchange by factor serves every later step.
    """
    record = F.struct("d", "ic", "rank_ic", "mean_forward", "top_forward")
    series = daily.groupBy("factor_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("rank_ic").isNotNull(), record))).alias("days")
    )
    ranged = series.withColumn("range", F.explode(range_column(ranges, horizon))).withColumn(
        "days",
        F.filter("days", lambda x: (x["d"] >= F.col("range.day_from")) & (x["d"] < F.col("range.usable_to"))),
    )
    numbers = F.transform("days", lambda x: x["d"])
    return ranged.withColumn("rebalances", spaced_days(numbers, horizon, F.col("range.day_from")))


def selection_periods(pairs: DataFrame, series: DataFrame, top_k: int, forward: str = "fwd") -> DataFrame:
    """Per factor, range and rebalancing period: members, new members, mean return.

    A member is new unless it was also one in the previous period, so no set of
    symbols is gathered and only the members themselves are shuffled.
    """
    picks = series.select(
        "factor_id",
        F.col("range.name").alias("range_name"),
        F.posexplode("rebalances").alias("period", "d"),
    )
    previous = F.lag("period").over(Window.partitionBy("range_name", "factor_id", "symbol").orderBy("period"))
    members = (
        pairs.where(in_top(top_k))
        .select("factor_id", "symbol", "d", forward)
        .join(F.broadcast(picks), ["factor_id", "d"])  # factors x ranges x calendar / horizon rows
        .withColumn("stays", F.coalesce(previous == F.col("period") - 1, F.lit(False)))
    )
    return members.groupBy("range_name", "factor_id", "period").agg(
        F.count(F.lit(1)).alias("members"),
        F.count_if(~F.col("stays")).alias("entered"),
        F.avg(forward).alias("period_return"),
    )


def mean_turnover(periods: DataFrame) -> DataFrame:
    """Mean share of new members; the first period counts as fully new."""
    return periods.groupBy("range_name", "factor_id").agg(
        F.avg(F.col("entered") / F.col("members")).alias("turnover")
    )


def default_top_k(n_symbols: int) -> int:
    return max(5, int(n_symbols * 0.01))


def evaluate_ranges(
    values: DataFrame,
    ranges: Sequence[DayRange],
    horizon: int,
    top_k: int,
    group_rows: int,
    thresholds: Thresholds | None = None,
    forward: str = "fwd",
) -> DataFrame:
    """One row per factor and range with IC, portfolio and pass figures.

    ``values`` carries the forward return of each cell. Factors without any
    usable day inside a range still get a (failing) row.
    """
    limits = thresholds or Thresholds()
    pairs = ranked_pairs(values, group_rows, forward)
    series = range_series(daily_ic(pairs, forward, top_k), ranges, horizon)
    chosen = F.filter("days", lambda x: F.array_contains("rebalances", x["d"]))
    rank_ics = F.transform("days", lambda x: x["rank_ic"])
    center = array_mean(rank_ics)
    summary = (
        series.withColumns({"chosen": chosen, "rank_ics": rank_ics, "rank_ic": center})
        .withColumn("squares", F.transform("rank_ics", lambda v: (v - F.col("rank_ic")) * (v - F.col("rank_ic"))))
        .select(
            "factor_id",
            F.col("range.name").alias("range_name"),
            F.greatest(F.col("range.day_to") - F.col("range.day_from"), F.lit(0)).cast("long").alias("evaluated_days"),
            F.size("days").cast("long").alias("valid_ic_days"),
            "rank_ic",
            array_mean(F.transform("days", lambda x: x["ic"])).alias("ic_mean"),
            F.sqrt(array_mean(F.col("squares"))).alias("rank_ic_dev"),
            array_mean(F.transform("chosen", lambda x: x["top_forward"])).alias("top_forward"),
            array_mean(F.transform("chosen", lambda x: x["mean_forward"])).alias("bench_forward"),
        )
    )
    # values and a period's return are always there: members that ask for them read the same exchange as the daily figures
    valued = pairs.where(F.col("value").isNotNull())
    periods = selection_periods(valued, series, top_k, forward).where(F.col("period_return").isNotNull())
    turnover = mean_turnover(periods)
    joined = summary.join(turnover, ["range_name", "factor_id"], "left")
    yearly = DAYS_PER_YEAR / horizon
    days = F.col("evaluated_days")
    coverage = F.when(days > 0, F.col("valid_ic_days") / days).otherwise(0.0)
    enough = (coverage >= limits.min_coverage) & (F.col("valid_ic_days") > 0)
    icir = F.col("rank_ic") / F.when(F.col("rank_ic_dev") > FLAT, F.col("rank_ic_dev")).otherwise(ICIR_FALLBACK)
    scored = joined.select(
        "factor_id",
        "range_name",
        "evaluated_days",
        "valid_ic_days",
        coverage.alias("coverage"),
        enough.alias("enough"),
        F.when(enough, F.col("rank_ic")).otherwise(0.0).alias("rank_ic"),
        F.when(enough, F.col("ic_mean")).otherwise(0.0).alias("ic_mean"),
        F.when(enough, icir).otherwise(0.0).alias("icir"),
        F.when(enough, (F.col("top_forward") - TURNOVER_COST * F.col("turnover")) * yearly).alias("topk_return"),
        F.when(enough, F.col("bench_forward") * yearly).alias("benchmark_return"),
    ).withColumn("excess_return", F.col("topk_return") - F.col("benchmark_return"))
    fitness = 5 * F.col("rank_ic") + 0.5 * F.col("icir") + F.col("excess_return")
    passed = (
        F.col("enough")
        & (F.col("rank_ic") >= limits.min_rank_ic)
        & (F.col("icir") >= limits.min_icir)
        & (F.col("excess_return") > limits.min_excess)
    )
    # a missing fitness stands for minus infinity
    return scored.withColumns(
        {"fitness": F.when(F.col("enough"), fitness), "passed": F.coalesce(passed, F.lit(False))}
    ).drop("enough")


def in_batches(
    formulas: Mapping[str, Sequence[str]], cells: int, evaluate: Callable[[Mapping[str, Sequence[str]]], DataFrame]
) -> DataFrame:
    """``evaluate`` of all formulas, as many at a time as have ``BATCH_CELLS`` values together; one has about ``cells``.

    The rows of a batch are small and stored, and its exchanges leave the disks before the next one begins.
    """
    names, many = list(formulas), max(1, BATCH_CELLS // max(1, cells))
    if len(names) <= many:
        return evaluate(formulas)
    parts = [stored(evaluate({n: formulas[n] for n in names[i : i + many]})) for i in range(0, len(names), many)]
    combined = parts[0]
    for part in parts[1:]:
        combined = combined.unionByName(part)
    return combined


def oos_ranges(n_days: int, horizon: int, train: float = 0.6, validation: float = 0.2) -> list[DayRange]:
    """Train / validation / test ranges; ones too short to evaluate are left out."""
    train_end = max(1, int(n_days * train))
    validation_end = min(max(train_end + 1, int(n_days * (train + validation))), n_days)
    bounds = {"train": (0, train_end), "validation": (train_end, validation_end), "test": (validation_end, n_days)}
    return [
        DayRange(name, max(0, start - horizon), end, end)
        for name, (start, end) in bounds.items()
        if end - start > horizon + 2
    ]


def oos_verdict(evaluated: DataFrame) -> DataFrame:
    """Per factor: overall verdict and failed parts of a three-way evaluation."""
    names = ("train", "validation", "test")
    won = {n: F.coalesce(F.bool_or(F.when(F.col("range_name") == n, F.col("passed"))), F.lit(False)) for n in names}
    return evaluated.groupBy("factor_id").agg(
        (won["validation"] & won["test"]).alias("passed"),
        F.array_compact(F.array(*[F.when(~won[n], F.lit(f"{n}_failed")) for n in names])).alias("failure_reasons"),
    )
