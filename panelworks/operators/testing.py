"""Multiple testing, Sharpe statistics, overfitting probability."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.functions.scalar import erfc, normal_cdf
from panelworks.operators.bootstrap import moving_block_bootstrap, stationary_bootstrap  # noqa: F401
from panelworks.operators.ranking import ordinal_rank, running_extreme
from panelworks.session import ensure_checkpoint_dir

# Fixed values.
FLAT = 1e-12
VARIANCE_FLOOR = 1e-12
PERIODS_PER_YEAR = 250.0


# --- families of p-values ------------------------------------------------------------------


def correct_p_values(
    tests: DataFrame, family_rows: int, family: Sequence[str] = ("family",), alpha: float = 0.05
) -> DataFrame:
    """Bonferroni, Holm and Benjamini-Hochberg adjusted values for whole families.

    ``tests`` holds ``*family, test_id, p_value`` with every test of the family.
    Holm is a running maximum by rank, Benjamini-Hochberg a running minimum from
    the far end; both run block-wise so a family may exceed one task.
    """
    p, m, i = F.col("p_value"), F.col("tests"), F.col("position")
    checked = tests.withColumn(
        "p_value", F.when(p.between(0, 1), p).otherwise(F.raise_error(F.lit("p-values must lie in [0, 1]")))
    )
    sizes = checked.groupBy(*family).agg(F.count(F.lit(1)).alias("tests"))
    ranked = ordinal_rank(checked, family, ["p_value", "test_id"], "position", family_rows).join(sizes, list(family))
    stepped = ranked.withColumns(
        {
            "bonferroni": F.least(p * m, F.lit(1.0)),
            "_down": F.least(p * (m - i + 1), F.lit(1.0)),
            "_up": p * m / i,
            "_back": m - i + 1,
        }
    )
    stepped = running_extreme(stepped, family, "position", "_down", "holm", largest=True)
    stepped = running_extreme(stepped, family, "_back", "_up", "benjamini_hochberg", largest=False)
    stepped = stepped.withColumn("benjamini_hochberg", F.least("benjamini_hochberg", F.lit(1.0)))
    methods = ("bonferroni", "holm", "benjamini_hochberg")
    return stepped.select(
        *family, "test_id", "p_value", *methods, *[(F.col(c) <= alpha).alias(f"{c}_rejected") for c in methods]
    )


def family_report(corrected: DataFrame, family: Sequence[str] = ("family",), hypotheses: int = 0) -> DataFrame:
    """Per family: size, effective trials and whether each method rejects anything."""
    methods = ("bonferroni", "holm", "benjamini_hochberg")
    return corrected.groupBy(*family).agg(
        F.count(F.lit(1)).alias("p_value_count"),
        F.greatest(F.count(F.lit(1)), F.lit(hypotheses), F.lit(1)).alias("effective_trials"),
        *[F.bool_or(f"{c}_rejected").alias(f"{c}_pass") for c in methods],
    )


# --- Sharpe --------------------------------------------------------------------------------


def _sharpe_variance(sharpe: Column, skewness: Column, kurtosis: Column) -> Column:
    return F.greatest(F.lit(VARIANCE_FLOOR), 1 - skewness * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe)


def probabilistic_sharpe(
    sharpe: Column, benchmark: Column, n: Column, skewness: Column | None = None, kurtosis: Column | None = None
) -> Column:
    """Probability that the true Sharpe ratio exceeds ``benchmark``."""
    variance = _sharpe_variance(sharpe, F.lit(0.0) if skewness is None else skewness, F.lit(3.0) if kurtosis is None else kurtosis)
    return F.when(n > 1, normal_cdf((sharpe - benchmark) * F.sqrt(n - 1) / F.sqrt(variance))).otherwise(0.0)


def deflated_sharpe(
    sharpe: Column, n: Column, trials: Column, skewness: Column | None = None, kurtosis: Column | None = None
) -> Column:
    """Probabilistic Sharpe against the ratio expected from the best of ``trials``."""
    penalty = F.sqrt(2 * F.ln(F.greatest(trials, F.lit(1)))) / F.sqrt(F.greatest(n, F.lit(1)))
    return probabilistic_sharpe(sharpe, penalty, n, skewness, kurtosis)


def sharpe_report(returns: DataFrame, trials: int = 1, benchmark: float = 0.0) -> DataFrame:
    """Sharpe statistics per ``trial_id``.

    Skewness and kurtosis are means of powers over the sample deviation, so they
    need the mean first; it is joined back as one row per trial.
    """
    present = returns.where(F.col("value").isNotNull())
    first = present.groupBy("trial_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("dev")
    )
    z = F.when(F.col("dev") > FLAT, (F.col("value") - F.col("mean")) / F.col("dev"))
    powers = present.join(first, "trial_id").groupBy("trial_id").agg(
        F.coalesce(F.avg(z * z * z), F.lit(0.0)).alias("skewness"),
        F.coalesce(F.avg(z * z * z * z), F.lit(3.0)).alias("kurtosis"),
    )
    sharpe = F.when(F.col("dev") > FLAT, F.col("mean") / F.col("dev")).otherwise(0.0)
    scored = first.join(powers, "trial_id").withColumn("observed_sharpe", sharpe)
    s, n, skew, kurt = F.col("observed_sharpe"), F.col("n"), F.col("skewness"), F.col("kurtosis")
    return scored.select(
        "trial_id",
        "observed_sharpe",
        (s * math.sqrt(PERIODS_PER_YEAR)).alias("annualized_sharpe"),
        probabilistic_sharpe(s, F.lit(benchmark / math.sqrt(PERIODS_PER_YEAR)), n, skew, kurt).alias("psr"),
        deflated_sharpe(s, n, F.lit(max(1, trials)), skew, kurt).alias("dsr"),
        "skewness",
        "kurtosis",
        n.alias("sample_length"),
    )


# --- probability of backtest overfitting -----------------------------------------------------


def block_sums(matrix: DataFrame, blocks: int, by: Sequence[str] = ()) -> DataFrame:
    """Sum and count per trial and time block, with the period and block counts of each matrix.

    ``matrix`` is long: ``*by, trial_id, period, value``; the periods of one matrix are
    its calendar and are cut like a sequence split into ``min(blocks, periods)``
    parts, the first ones longer by one where the cut is uneven.
    """
    keys = list(by)
    calendar = matrix.select(*keys, "period").distinct()  # bounded by the calendar
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("period")) - 1
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    cut = calendar.select(*keys, "period", at.alias("_at"), size.cast("int").alias("periods"))
    cut = cut.withColumn("blocks", F.least(F.lit(blocks), F.col("periods")))
    short, longer = F.floor(F.col("periods") / F.col("blocks")), F.col("periods") % F.col("blocks")
    head = longer * (short + 1)
    block = F.when(F.col("_at") < head, F.floor(F.col("_at") / (short + 1))).otherwise(
        longer + F.floor((F.col("_at") - head) / short)
    )
    return (
        matrix.join(cut.withColumn("block", block.cast("int")), [*keys, "period"])
        .groupBy(*keys, "trial_id", "block")
        .agg(
            F.sum("value").alias("total"),
            F.count("value").alias("present"),
            F.first("periods").alias("periods"),
            F.first("blocks").alias("blocks"),
        )
    )


def overfitting_probability(matrix: DataFrame, partitions: int = 8, by: Sequence[str] = ()) -> DataFrame:
    """Share of in-sample block choices whose best trial ranks low out of sample, per matrix.

    Every subset of 1 .. B/2 blocks is an in-sample choice (162 for B = 8), with B at
    most the number of periods. Fewer than two trials or four periods count as
    certain overfitting. A trial is one row of block sums, so a subset's means are array folds
    and the winner of a subset is an aggregate maximum; trials are never gathered.
    """
    keys, most = list(by), max(2, partitions)
    sums = block_sums(matrix, most, keys)
    trials = sums.groupBy(*keys, "trial_id").agg(
        F.map_from_entries(F.collect_list(F.struct("block", F.struct("total", "present")))).alias("by_block"),
        F.first("periods").alias("periods"),
        F.first("blocks").alias("blocks"),
    )
    cells = F.array(*[F.try_element_at("by_block", F.lit(b)) for b in range(most)])
    ensure_checkpoint_dir(matrix.sparkSession)
    trials = trials.checkpoint()  # one small row per trial, read three times below
    choices = F.array(*[F.lit(c) for c in range(1, 2**most) if c.bit_count() <= most // 2])
    fitting = F.filter(
        choices,
        lambda c: (c < F.pow(F.lit(2), F.col("blocks"))) & (F.bit_count(c) <= F.floor(F.col("blocks") / 2)),
    )
    spread = trials.select(*keys, "trial_id", "blocks", cells.alias("cells"), F.explode(fitting).alias("choice"))
    own = F.slice("cells", F.lit(1), F.col("blocks"))
    picked = F.transform(own, lambda c, b: F.when(F.getbit(F.col("choice"), b) == 1, c))
    others = F.transform(own, lambda c, b: F.when(F.getbit(F.col("choice"), b) == 0, c))
    scored = spread.select(*keys, "trial_id", "choice", _mean_of(picked).alias("inside"), _mean_of(others).alias("outside"))
    # best in sample, first trial on ties; NULL means never win
    best = _best_by_choice(scored, keys)
    low = (
        scored.join(best, [*keys, "choice"])
        .groupBy(*keys, "choice")
        .agg(
            F.first("trials").alias("trials"),
            F.count_if(F.col("outside") <= F.col("best_outside")).alias("rank"),
        )
    )
    failed = (F.col("rank") <= F.col("trials") / 2).cast("double")
    rates = low.groupBy(*keys).agg(F.avg(failed).alias("rate"), F.count(F.lit(1)).alias("choices"))
    sizes = trials.groupBy(*keys).agg(F.count(F.lit(1)).alias("trials"), F.max("periods").alias("periods"))
    joined = sizes.join(rates, keys, "left") if keys else sizes.crossJoin(rates)  # one row each
    enough = (F.col("trials") >= 2) & (F.col("periods") >= 4)
    return joined.select(
        *keys, F.when(enough, F.coalesce("rate", F.lit(1.0))).otherwise(1.0).alias("pbo"), "trials", "choices"
    )


def _mean_of(cells: Column) -> Column:
    total = F.aggregate(cells, F.lit(0.0), lambda acc, c: acc + F.coalesce(c["total"], F.lit(0.0)))
    count = F.aggregate(cells, F.lit(0), lambda acc, c: acc + F.coalesce(c["present"], F.lit(0)).cast("int"))
    return F.when(count > 0, total / count)


def _best_by_choice(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Out-of-sample mean of each choice's in-sample winner (smallest id on ties)."""
    tops = scored.groupBy(*keys, "choice").agg(F.count(F.lit(1)).alias("trials"), F.max("inside").alias("top"))
    winners = scored.join(tops, [*keys, "choice"]).where(F.col("inside") == F.col("top"))
    return winners.groupBy(*keys, "choice").agg(
        F.first("trials").alias("trials"), F.min_by("outside", "trial_id").alias("best_outside")
    )


# --- a cohort of candidates --------------------------------------------------------------------


def cohort_statistics(
    series: DataFrame, cohort_rows: int, alpha: float = 0.05, min_dsr: float = 0.5, max_pbo: float = 0.35
) -> DataFrame:
    """Joint verdict for every candidate of one experiment.

    ``series`` holds ``candidate_id, position, value`` (each candidate's ICs in
    time order). Series are aligned at their end to the shortest one. A cohort
    of fewer than two candidates can never pass.
    """
    ensure_checkpoint_dir(series.sparkSession)
    series = series.checkpoint()  # candidates x calendar rows, cheap to keep and costly to rebuild
    lengths = series.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("length"), F.max("position").alias("last"))
    shortest = lengths.agg(F.min("length").alias("n"))
    back = F.col("last") - F.col("position")
    aligned = (
        series.join(F.broadcast(lengths), "candidate_id")
        .crossJoin(F.broadcast(shortest))  # one row
        .where(back < F.col("n"))
        .select("candidate_id", "n", (F.col("n") - 1 - back).alias("period"), "value")
    )
    dev = F.greatest(F.stddev_samp("value"), F.lit(FLAT))
    count = F.count("value")
    scored = aligned.groupBy("candidate_id", "n").agg(
        F.when(count < 2, 1.0)
        .otherwise(erfc(F.abs(F.avg("value")) * F.sqrt(count) / dev / math.sqrt(2)))
        .alias("p_value"),
        F.when(count < 2, 0.0).otherwise(F.avg("value") / dev).alias("sharpe"),
    )
    tests = scored.select(F.lit("cohort").alias("family"), F.col("candidate_id").alias("test_id"), "p_value")
    fdr = correct_p_values(tests, cohort_rows, alpha=alpha).select(
        F.col("test_id").alias("candidate_id"),
        F.col("benjamini_hochberg").alias("q_value"),
        F.col("benjamini_hochberg_rejected").alias("passed_multiple_testing"),
    )
    pbo = overfitting_probability(aligned.withColumnRenamed("candidate_id", "trial_id"))
    joined = scored.join(fdr, "candidate_id").crossJoin(F.broadcast(pbo))  # one row
    dsr = deflated_sharpe(F.col("sharpe"), F.col("n"), F.col("trials"))
    reasons = F.array_compact(
        F.array(
            F.when(~F.col("passed_multiple_testing"), "FDR_FAILED"),
            F.when(F.col("deflated_sharpe") < min_dsr, "DEFLATED_SHARPE_FAILED"),
            F.when(F.col("trials") < 2, "PBO_REQUIRES_COHORT").when(F.col("pbo") > max_pbo, "PBO_FAILED"),
        )
    )
    return (
        joined.withColumn("deflated_sharpe", dsr)
        .withColumn("reject_reasons", reasons)
        .select(
            "candidate_id",
            F.col("p_value").alias("raw_p_value"),
            "q_value",
            "deflated_sharpe",
            "pbo",
            F.col("trials").alias("effective_trials"),
            F.col("n").alias("observations"),
            "passed_multiple_testing",
            ((F.col("trials") >= 2) & (F.col("pbo") <= max_pbo)).alias("passed_pbo"),
            (F.size("reject_reasons") == 0).alias("passed"),
            "reject_reasons",
        )
    )
