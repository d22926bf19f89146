"""Prediction metrics over long tables of scored rows.

Input rows hold ``*keys, row_id, target, prediction``; each function returns one
row per key. Rows with a missing side are left out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.functions.moments import pearson
from panelworks.functions.scalar import clip
from panelworks.operators.ranking import average_ranks_by_value, ordinal_rank

# Fixed values of the metric contract.
ECE_BINS = 10
TOP_SHARES = {"precision_at_top1pct": 0.01, "precision_at_top5pct": 0.05}
POSITIVE = 0.5
WEIGHT_CAP = 20.0


def complete(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("target").isNotNull() & F.col("prediction").isNotNull())


def regression_metrics(rows: DataFrame, keys: Sequence[str], group_rows: int) -> DataFrame:
    """MAE, RMSE, Pearson, average-rank Spearman and sign accuracy."""
    kept = complete(rows)
    ranked = average_ranks_by_value(kept, keys, "target", "_rt", group_rows)
    ranked = average_ranks_by_value(ranked, keys, "prediction", "_rp", group_rows)
    gap = F.col("prediction") - F.col("target")
    zero = F.lit(0.0)
    return ranked.groupBy(*keys).agg(
        F.avg(F.abs(gap)).alias("mae"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        F.coalesce(pearson(F.col("prediction"), F.col("target")), zero).alias("pearson"),
        F.coalesce(pearson(F.col("_rp"), F.col("_rt")), zero).alias("spearman"),
        F.avg((F.signum("prediction") == F.signum("target")).cast("double")).alias("sign_accuracy"),
        F.count(F.lit(1)).alias("valid_count"),
    )


def expected_calibration_error(rows: DataFrame, keys: Sequence[str], bins: int = ECE_BINS) -> DataFrame:
    """Weighted gap between mean target and mean probability per equal-width bin."""
    p = F.col("prediction")
    # edges are multiples of the step, so each one keeps its own rounding
    passed = [(p >= i * (1.0 / bins)).cast("int") for i in range(1, bins)]
    cells = (
        complete(rows)
        .withColumn("_bin", F.when(p.between(0, 1), sum(passed, F.lit(0))))
        .groupBy(*keys, "_bin")
        .agg(F.count(F.lit(1)).alias("_n"), F.avg("target").alias("_t"), F.avg("prediction").alias("_p"))
    )
    gap = F.when(F.col("_bin").isNotNull(), F.col("_n") * F.abs(F.col("_t") - F.col("_p"))).otherwise(0.0)
    return cells.groupBy(*keys).agg((F.sum(gap) / F.sum("_n")).alias("ece"))


def event_metrics(rows: DataFrame, keys: Sequence[str], group_rows: int, threshold: float = 0.5) -> DataFrame:
    """Precision-recall area, prevalence, thresholded and top-share precision, ECE.

    The area needs, for each positive, its rank among all rows and among the
    positives; both are ordinal ranks, so no cumulative pass over a group is made.
    Equal scores keep the order of ``row_id``.
    """
    positive = F.col("target") > POSITIVE
    scored = complete(rows).withColumns({"_down": -F.col("prediction"), "_pos": positive.cast("int")})
    order = ["_down", "row_id"]
    ranked = ordinal_rank(scored, list(keys), order, "_rank", group_rows)
    ranked = ordinal_rank(ranked, [*keys, "_pos"], order, "_hit", group_rows)
    sizes = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ranked = ranked.join(sizes, list(keys))
    predicted = F.col("prediction") >= threshold
    pos = F.col("_pos") == 1
    tops = {
        name: F.avg(F.when(F.col("_rank") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * share)), F.col("_pos")))
        for name, share in TOP_SHARES.items()
    }
    sums = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("valid_count"),
        F.sum("_pos").alias("_positives"),
        F.coalesce(F.sum(F.when(pos, F.col("_hit") / F.col("_rank"))), F.lit(0.0)).alias("_area"),
        F.count_if(pos & predicted).cast("double").alias("_tp"),
        F.count_if(~pos & predicted).cast("double").alias("_fp"),
        F.count_if(pos & ~predicted).cast("double").alias("_fn"),
        *[value.alias(name) for name, value in tops.items()],
    )
    return event_figures(sums, [*keys, *tops], "valid_count").join(expected_calibration_error(rows, keys), list(keys))


def event_figures(sums: DataFrame, keep: Sequence[str], n: str) -> DataFrame:
    """The figures that follow from ``_positives, _area, _tp, _fp, _fn`` and the number ``n`` of rows."""
    one = F.lit(1.0)
    area = F.when(F.col("_positives") > 0, F.col("_area") / F.greatest("_positives", F.lit(1))).otherwise(0.0)
    prevalence = F.col("_positives") / F.col(n)
    precision = F.col("_tp") / F.greatest(F.col("_tp") + F.col("_fp"), one)
    recall = F.col("_tp") / F.greatest(F.col("_tp") + F.col("_fn"), one)
    return sums.select(
        *keep,
        area.alias("pr_auc"),
        prevalence.alias("prevalence"),
        (area / F.greatest(prevalence, F.lit(1e-12))).alias("pr_auc_multiple_of_prevalence"),
        (F.least(area / F.greatest(prevalence, F.lit(1e-4)), F.lit(10.0)) / 10.0).alias("relative_pr"),
        precision.alias("precision"),
        recall.alias("recall"),
        (2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))).alias("f1"),
        n,
    )


# --- soft class distributions ------------------------------------------------------------------------


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _softmax(values: Column) -> Column:
    top = F.array_max(values)
    shifted = F.transform(values, lambda v: F.exp(v - top))
    return F.transform(shifted, lambda v: v / F.greatest(_sum(shifted), F.lit(1e-12)))


def _divergence(a: Column, b: Column) -> Column:
    floor = F.lit(1e-12)
    return _sum(F.zip_with(a, b, lambda x, y: x * F.ln(F.greatest(x, floor) / F.greatest(y, floor))))


def soft_rows(rows: DataFrame) -> DataFrame:
    """Per row: softmax of ``scores``, normalised ``targets``, losses and classes."""
    made = rows.withColumns(
        {
            "p": _softmax(F.col("scores")),
            "y": F.transform("targets", lambda v: v / F.greatest(_sum(F.col("targets")), F.lit(1e-12))),
        }
    )
    made = made.withColumn("m", F.zip_with("y", "p", lambda a, b: 0.5 * (a + b)))
    y, p, m = F.col("y"), F.col("p"), F.col("m")
    return made.withColumns(
        {
            "ce": -_sum(F.zip_with(y, p, lambda a, b: a * F.ln(F.greatest(b, F.lit(1e-12))))),
            "kl": _divergence(y, p),
            "js": 0.5 * _divergence(y, m) + 0.5 * _divergence(p, m),
            "brier": _sum(F.zip_with(p, y, lambda a, b: (a - b) * (a - b))),
            "actual": (F.array_position(y, F.array_max(y)) - 1).cast("int"),
            "predicted": (F.array_position(p, F.array_max(p)) - 1).cast("int"),
            "confidence": F.array_max(p),
        }
    )


def confusion(made: DataFrame) -> DataFrame:
    return made.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def macro_f1(cells: DataFrame, classes: int) -> DataFrame:
    """Mean F1 over all classes from a confusion table (classes squared rows)."""
    rates = []
    for k in range(classes):
        tp = F.sum(F.when((F.col("actual") == k) & (F.col("predicted") == k), F.col("n")).otherwise(0))
        precision = tp / F.greatest(F.sum(F.when(F.col("predicted") == k, F.col("n")).otherwise(0)), F.lit(1))
        recall = tp / F.greatest(F.sum(F.when(F.col("actual") == k, F.col("n")).otherwise(0)), F.lit(1))
        rates.append(2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12)))
    return cells.agg((sum(rates, F.lit(0.0)) / classes).alias("macro_f1"))


def soft_phase_metrics(rows: DataFrame, classes: int) -> DataFrame:
    """One row of distribution metrics from ``row_id, targets, scores`` arrays."""
    made = soft_rows(rows)
    means = made.agg(
        F.avg("ce").alias("soft_ce"),
        F.avg("kl").alias("kl_divergence"),
        F.avg("js").alias("js_divergence"),
        F.avg("brier").alias("brier_score"),
    )
    hits = made.select(
        F.lit("phase").alias("key"),
        (F.col("actual") == F.col("predicted")).cast("double").alias("target"),
        F.col("confidence").alias("prediction"),
    )
    # three tables of one row, or of none for the calibration of no rows
    ece = expected_calibration_error(hits, ["key"]).select("ece")
    return means.join(F.broadcast(ece), F.lit(True), "left").crossJoin(F.broadcast(macro_f1(confusion(made), classes)))


# --- grouped contract, composites, comparisons --------------------------------------------------------

REGRESSION_FIELDS = ("mae", "rmse", "pearson", "spearman", "sign_accuracy")
EVENT_FIELDS = (
    "pr_auc",
    "relative_pr",
    "pr_auc_multiple_of_prevalence",
    "f1",
    "precision",
    "recall",
    "ece",
    "precision_at_top1pct",
    "precision_at_top5pct",
)


PHASE_FIELDS = ("soft_ce", "kl_divergence", "js_divergence", "brier_score", "ece", "macro_f1")


def grouped_metrics(rows: DataFrame, phases: DataFrame, group_rows: int, classes: int = 5) -> DataFrame:
    """Long metrics per target and per group for scored label rows.

    ``rows`` holds ``group, name, task, row_id, target, prediction``; an invalid
    label has a NULL target. Group rows carry the name ``aggregate``. The phase group is one
    distribution and has no targets of its own: ``phases`` holds ``targets, scores`` arrays of
    the rows whose phase labels are all valid, and gives the rows of ``phase / aggregate``.
    """
    keys = ["group", "name"]
    scored = rows.where(F.col("group") != "phase")
    binary = F.col("task") == "binary_event"
    plain = regression_metrics(scored.where(~binary), keys, group_rows)
    return long_metrics(plain, event_metrics(scored.where(binary), keys, group_rows), soft_phase_metrics(phases, classes))


def long_metrics(plain: DataFrame, event: DataFrame, phase: DataFrame) -> DataFrame:
    """Figures per target and the means of each group, long, from one row per target and one row of the phase group."""
    keys = ["group", "name"]
    plain = plain.unpivot(keys, list(REGRESSION_FIELDS), "metric", "value")
    targets = plain.unionByName(event.unpivot(keys, list(EVENT_FIELDS), "metric", "value"))
    groups = targets.groupBy("group", F.lit("aggregate").alias("name"), "metric").agg(F.avg("value").alias("value"))
    shape = phase.select(
        F.lit("phase").alias("group"),
        F.lit("aggregate").alias("name"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in PHASE_FIELDS],
    )
    return targets.unionByName(groups).unionByName(shape.unpivot(keys, list(PHASE_FIELDS), "metric", "value"))


# Summary figure, label group, labels, metric.
SUMMARY_PARTS = (
    ("ma_slope_mean_pearson", "ma", tuple(f"ma{n}_slope" for n in (5, 10, 20, 30, 60, 120)), "pearson"),
    ("ma_slope_mean_sign_accuracy", "ma", tuple(f"ma{n}_slope" for n in (5, 10, 20, 30, 60, 120)), "sign_accuracy"),
    ("ma_alignment_spearman", "ma", ("bull_alignment_score", "bear_alignment_score"), "spearman"),
    ("ma_compression_pearson", "ma", ("compression_score",), "pearson"),
    ("bollinger_percent_b_pearson", "bollinger", ("percent_b",), "pearson"),
    ("bollinger_boll_zscore_pearson", "bollinger", ("boll_zscore",), "pearson"),
    ("bollinger_bandwidth_pearson", "bollinger", ("bandwidth",), "pearson"),
    ("bollinger_squeeze_spearman", "bollinger", ("squeeze_score",), "spearman"),
    ("bollinger_expansion_spearman", "bollinger", ("boll_expansion_score",), "spearman"),
    (
        "wyckoff_primitive_mean_spearman",
        "wyckoff_primitives",
        (
            "trend_direction",
            "wyckoff_trend_strength",
            "trading_range_score",
            "support_distance",
            "resistance_distance",
            "breakout_strength",
            "breakdown_strength",
            "false_breakout_score",
            "effort_result_divergence",
        ),
        "spearman",
    ),
    ("phase_macro_f1", "phase", ("aggregate",), "macro_f1"),
    ("phase_js_divergence", "phase", ("aggregate",), "js_divergence"),
    ("phase_ece", "phase", ("aggregate",), "ece"),
    *[
        (f"event_{out}", "events", ("sc_score", "bc_score", "spring_score", "upthrust_score", "sos_score", "sow_score"), m)
        for out, m in (
            ("mean_relative_pr", "relative_pr"),
            ("mean_f1", "f1"),
            ("precision_at_top1pct", "precision_at_top1pct"),
            ("precision_at_top5pct", "precision_at_top5pct"),
        )
    ],
)
# Weights of the summary figures inside each component.
COMPONENTS = {
    "ma": {
        "ma_slope_mean_pearson": 0.40,
        "ma_slope_mean_sign_accuracy": 0.30,
        "ma_alignment_spearman": 0.15,
        "ma_compression_pearson": 0.15,
    },
    "boll": {
        "bollinger_percent_b_pearson": 0.30,
        "bollinger_boll_zscore_pearson": 0.25,
        "bollinger_bandwidth_pearson": 0.20,
        "bollinger_squeeze_spearman": 0.15,
        "bollinger_expansion_spearman": 0.10,
    },
    "primitive": {"wyckoff_primitive_mean_spearman": 1.0},
    "event": {
        "event_mean_relative_pr": 0.60,
        "event_mean_f1": 0.20,
        "event_precision_at_top1pct": 0.10,
        "event_precision_at_top5pct": 0.10,
    },
}
PHASE_WEIGHTS = (0.60, 0.20, 0.20)
# Weights of the components in the composite and in each stage score.
COMPOSITE = {"ma": 0.20, "boll": 0.20, "primitive": 0.25, "phase": 0.15, "event": 0.20}
STAGES = {
    "ma_bollinger": {"ma": 0.50, "boll": 0.50},
    "wyckoff_primitives": {"ma": 0.20, "boll": 0.20, "primitive": 0.60},
    "wyckoff_phase_events": {"ma": 0.10, "boll": 0.10, "primitive": 0.20, "phase": 0.25, "event": 0.35},
}


def metric_summary(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Summary figures in one row per ``by`` from long ``group, name, metric, value``; absent means 0."""
    figures = [
        F.coalesce(
            F.avg(F.when((F.col("group") == group) & F.col("name").isin(*names) & (F.col("metric") == metric), F.col("value"))),
            F.lit(0.0),
        ).alias(out)
        for out, group, names, metric in SUMMARY_PARTS
    ]
    return metrics.groupBy(*by).agg(*figures)


def composite_scores(summary: DataFrame) -> DataFrame:
    """Add component scores, the composite and one selection score per stage."""

    def weighted(weights: dict[str, float]) -> Column:
        return sum((w * F.col(name) for name, w in weights.items()), F.lit(0.0))

    f1, js, ece = PHASE_WEIGHTS
    phase = (
        f1 * F.col("phase_macro_f1")
        + js * (1 - clip(F.col("phase_js_divergence") / math.log(2.0), 0.0, 1.0))
        + ece * (1 - clip(F.col("phase_ece"), 0.0, 1.0))
    )
    scored = summary.withColumns({**{name: weighted(w) for name, w in COMPONENTS.items()}, "phase": phase})
    return scored.withColumns(
        {"composite": weighted(COMPOSITE), **{f"select_{stage}": weighted(w) for stage, w in STAGES.items()}}
    )


def split_degradation(scores: DataFrame, base: str = "valid") -> DataFrame:
    """Relative loss of each later split against ``base``: ``max(0, 1 - score/base)``."""
    tests = ("time_test", "instrument_test", "double_oos")
    wide = scores.groupBy().pivot("split", [base, *tests]).agg(F.first("score"))
    floor = F.greatest(F.abs(F.col(base)), F.lit(1e-12))
    return wide.select(
        base, *tests, *[F.greatest(F.lit(0.0), 1 - F.col(t) / floor).alias(f"{t}_degradation") for t in tests]
    )


def relative_gain(scores: DataFrame, model: str = "transformer", baseline: str = "gru", needed: float = 0.05) -> DataFrame:
    """Gain of one model's score over a baseline's."""

    def of(name: str) -> Column:
        return F.max(F.when(F.col("model") == name, F.col("score")))

    gain = of(model) / F.greatest(F.abs(of(baseline)), F.lit(1e-12)) - 1
    return scores.agg(
        of(model).alias("model_score"),
        of(baseline).alias("baseline_score"),
        gain.alias("relative_gain"),
        (gain >= needed).alias("passes_gain"),
    )


def event_weights(rows: DataFrame, keys: Sequence[str], cap: float = WEIGHT_CAP) -> DataFrame:
    """Negatives over positives per event, limited to [1, cap]."""
    positives = F.sum("target")
    ratio = (F.count("target") - positives) / F.greatest(positives, F.lit(1.0))
    return rows.where(F.col("target").isNotNull()).groupBy(*keys).agg(clip(ratio, 1.0, cap).alias("weight"))
