"""Leakage, causality, gold-set and out-of-sample audits."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.operators.dataset import evenly_spaced
from panelworks.operators.labels import EVENTS
from panelworks.operators.prepare import normal_draw
from panelworks.operators.ranking import fold_average_ranks, ordinal_rank
from panelworks.session import ensure_checkpoint_dir

# Fixed values of the audits.
SHORTCUT_LIMIT = 0.9999
FLAT_VARIANCE = 1e-15
MIN_KAPPA = 0.60
PERTURBED = ("open", "high", "low", "close", "volume", "amount", "turnover")


# --- shortcut leakage ------------------------------------------------------------------------


_MOMENTS = ("mx", "my", "sxx", "syy", "sxy")
_PAIR_SUMS = "feature string, target string, n long, equal double, " + ", ".join(f"{m} double, r{m} double" for m in _MOMENTS)


def _cross_sums(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Means, squares and cross products of every pair of columns of two matrices of the same rows."""
    mx, my = x.mean(axis=0), y.mean(axis=0)
    return [mx, my, ((x - mx) ** 2).sum(axis=0), ((y - my) ** 2).sum(axis=0), ((x - mx).T @ (y - my)).reshape(-1)]


def _pair_rows(sums: Sequence[np.ndarray], left: Sequence[str], right: Sequence[str]) -> dict[str, np.ndarray]:
    """The sums of ``_cross_sums`` with one number per pair."""
    mx, my, sxx, syy, sxy = sums
    wide = [np.repeat(mx, len(right)), np.tile(my, len(left)), np.repeat(sxx, len(right)), np.tile(syy, len(left)), sxy]
    return dict(zip(_MOMENTS, wide))


def _pair_sums(rows: DataFrame, left: Sequence[str], right: Sequence[str], n_rows: int, drawn: DataFrame | None) -> DataFrame:
    """Partial sums of every column pair, of the values and (``r`` names) of their average ranks less their mean."""
    both = list(dict.fromkeys([*left, *right]))
    xs, ys = [both.index(c) for c in left], [both.index(c) for c in right]
    sizes = [len(left), len(right), len(left), len(right), len(left) * len(right)]

    def own(values: np.ndarray) -> np.ndarray:
        x, y = values[:, xs], values[:, ys]
        return np.concatenate([*_cross_sums(x, y), *[(c[:, None] == y).sum(axis=0) for c in x.T]])

    def fold(sums: np.ndarray, ranks: np.ndarray) -> pd.DataFrame:
        *values, equal = np.split(sums, np.cumsum(sizes))
        of_ranks = _pair_rows(_cross_sums(ranks[:, xs], ranks[:, ys]), left, right)
        columns = {"feature": np.repeat(list(left), len(right)), "target": np.tile(list(right), len(left)), "n": len(ranks), "equal": equal}
        for name, value in _pair_rows(values, left, right).items():
            columns |= {name: value, f"r{name}": of_ranks[name]}
        return pd.DataFrame(columns)

    return fold_average_ranks(rows, both, own, fold, _PAIR_SUMS, n_rows, drawn)


def _pair_moments(parts: DataFrame) -> DataFrame:
    """Exact moments of every column pair: partial sums merged by the usual between-group correction."""
    n = F.sum("n")

    def merged(r: str) -> list[Column]:
        mx, my = F.sum(F.col("n") * F.col(f"{r}mx")) / n, F.sum(F.col("n") * F.col(f"{r}my")) / n
        inner = {"sxx": ("mx", "mx", mx, mx), "syy": ("my", "my", my, my), "sxy": ("mx", "my", mx, my)}
        return [
            mx.alias(f"{r}mx"),
            my.alias(f"{r}my"),
            *[
                (F.sum(f"{r}{s}") + F.sum(F.col("n") * F.col(f"{r}{a}") * F.col(f"{r}{b}")) - n * ma * mb).alias(f"{r}{s}")
                for s, (a, b, ma, mb) in inner.items()
            ],
        ]

    return parts.groupBy("feature", "target").agg(n.alias("n"), *merged(""), *merged("r"), F.sum("equal").alias("equal"))


def _correlation(r: str = "") -> Column:
    sxx, syy, sxy = (F.col(f"{r}{s}") for s in ("sxx", "syy", "sxy"))
    flat = (sxx <= FLAT_VARIANCE * F.col("n")) | (syy <= FLAT_VARIANCE * F.col("n"))
    return F.when(flat | (F.col("n") < 2), 0.0).otherwise(sxy / F.sqrt(sxx * syy))


def shortcut_leakage(
    rows: DataFrame,
    features: Sequence[str],
    targets: Sequence[str],
    n_rows: int,
    limit: float = SHORTCUT_LIMIT,
    drawn: DataFrame | None = None,
) -> DataFrame:
    """Every feature/target pair: correlations, equality rate, affine fit, violation flag.

    ``rows`` holds complete numeric columns, ``n_rows`` of them; all are audited, in one pass. ``drawn``, some rows of the same
    kind, balances the tasks of large tables.
    """
    both = [F.col(c).cast("double") for c in dict.fromkeys([*features, *targets])]
    some = None if drawn is None else drawn.select(*both)
    sums = _pair_moments(_pair_sums(rows.select(*both), features, targets, n_rows, some))
    sloped = (F.col("n") >= 3) & (F.col("sxx") / F.col("n") >= FLAT_VARIANCE)
    slope = F.when(sloped, F.col("sxy") / F.col("sxx")).otherwise(0.0)
    r2 = F.when(sloped & (F.col("syy") > FLAT_VARIANCE), F.col("sxy") * F.col("sxy") / (F.col("sxx") * F.col("syy")))
    pairs = sums.select(
        "feature",
        "target",
        _correlation().alias("pearson"),
        (F.col("equal") / F.col("n")).alias("exact_equality_rate"),
        F.coalesce(r2, F.lit(0.0)).alias("affine_fit_r2"),
        slope.alias("affine_slope"),
        (F.col("my") - slope * F.col("mx")).alias("affine_intercept"),
        _correlation("r").alias("spearman"),
    )
    violation = (F.abs("pearson") > limit) & (F.col("affine_fit_r2") > limit)
    return pairs.withColumn("violation", violation)


# --- causality ---------------------------------------------------------------------------------


def causality_cases(bars: DataFrame, total_rows: int, cases: int = 500, minimum: int = 1) -> DataFrame:
    """Evenly spaced (symbol, cutoff) cases with their perturbation mode.

    A cutoff leaves at least one later row to perturb.
    """
    ordered = Window.partitionBy("symbol").orderBy("trading_date")
    placed = bars.select("symbol", "trading_date").withColumns(
        {"cutoff": F.row_number().over(ordered) - 1, "_later": F.lead("trading_date").over(ordered)}
    )
    usable = placed.where(F.col("_later").isNotNull() & (F.col("cutoff") >= minimum - 1)).withColumn("_all", F.lit(0))
    ranked = ordinal_rank(usable, ["_all"], ["symbol", "trading_date"], "_k", total_rows)
    total = usable.agg(F.count(F.lit(1)).alias("_n"))
    chosen = ranked.crossJoin(F.broadcast(total)).where(evenly_spaced(F.col("_k") - 1, F.col("_n"), cases))
    case = F.col("_k") - 1
    return chosen.select(case.alias("case_id"), "symbol", "cutoff", (case % 5).cast("int").alias("mode"))


#: Rows before and after a cutoff that a case rebuilds: more than the longest window of features and labels.
CONE = (256, 64)


def cones(bars: DataFrame, cases: DataFrame, back: int = CONE[0], ahead: int = CONE[1]) -> DataFrame:
    """The rows around every case's cutoff: what a rolling window can carry a later change to, and the later rows.

    The case table is small (its size is a parameter) and a case takes at most ``back + ahead + 1`` rows,
    however long its symbol is.
    """
    ordered = Window.partitionBy("symbol").orderBy("trading_date")
    placed = bars.withColumn("position", F.row_number().over(ordered) - 1).alias("p")
    near = F.col("position").between(F.col("cutoff") - back, F.col("cutoff") + ahead)
    return placed.join(F.broadcast(cases.alias("c")), (F.col("p.symbol") == F.col("c.symbol")) & near).drop(F.col("c.symbol"))


def perturbed_bars(copies: DataFrame, columns: Sequence[str] = PERTURBED) -> DataFrame:
    """Cases' rows with everything after the cutoff changed.

    Modes: scaled up, scaled down (turnover kept), reversed, noisy, shuffled.
    """
    names = [c for c in columns if c in copies.columns]
    future = F.col("position") > F.col("cutoff")
    place = F.when(F.col("mode") == 2, -F.col("position")).when(F.col("mode") == 4, F.lit(0)).otherwise(F.col("position"))
    draw = F.when(F.col("mode") == 4, F.md5(F.concat_ws(":", F.col("case_id").cast("string"), F.col("position").cast("string"))))
    by_case = Window.partitionBy("case_id").orderBy(place, draw, "position")
    moved = copies.where(future).select(
        "case_id",
        (F.col("cutoff") + F.row_number().over(by_case)).alias("position"),
        *[F.col(c).alias(f"_{c}") for c in names],
    )
    joined = copies.join(moved, ["case_id", "position"], "left")
    place = F.concat_ws("|", F.col("case_id").cast("string"), F.col("position").cast("string"))
    noise = {c: 1 + 2 * normal_draw(place, c, 0) for c in names}
    changed = {
        c: F.when(~future, F.col(c))
        .when(F.col("mode") == 0, F.col(f"_{c}") * 1000)
        .when((F.col("mode") == 1) & F.lit(c != "turnover"), F.col(f"_{c}") * 0.01)
        .when(F.col("mode") == 3, F.col(f"_{c}") * noise[c])
        .otherwise(F.col(f"_{c}"))
        for c in names
    }
    return joined.withColumns(changed).drop(*[f"_{c}" for c in names])


def causality_audit(
    bars: DataFrame,
    cases: DataFrame,
    builders: dict[str, Callable[..., DataFrame]],
    rtol: float = 1e-5,
    atol: float = 1e-8,
    back: int = CONE[0],
    ahead: int = CONE[1],
) -> DataFrame:
    """Per case and builder: rows up to the cutoff whose values or gaps changed.

    Both sides are built from the same rows around the cutoff, so a difference comes from the later rows alone.
    """
    ensure_checkpoint_dir(bars.sparkSession)
    copies = cones(bars, cases, back, ahead).checkpoint()  # cases x cone rows, built twice by every builder
    cutoffs = copies.where(F.col("position") == F.col("cutoff")).select("case_id", "mode", F.col("trading_date").alias("_cut"))
    reports = []
    for name, build in builders.items():
        before, after = build(copies, by=("case_id",)), build(perturbed_bars(copies), by=("case_id",))
        columns = [c for c in before.columns if c not in ("case_id", "trading_date")]
        joined = after.alias("a").join(before.alias("b"), ["case_id", "trading_date"]).join(F.broadcast(cutoffs), "case_id")
        gap, moved = F.lit(False), F.lit(False)
        for c in columns:
            a, b = F.col(f"a.{c}"), F.col(f"b.{c}")
            gap = gap | (a.isNull() != b.isNull())
            moved = moved | F.coalesce(F.abs(a - b) > atol + rtol * F.abs(b), F.lit(False))
        reports.append(
            joined.where(F.col("trading_date") <= F.col("_cut"))
            .groupBy("case_id", "mode")
            .agg(
                F.lit(name).alias("builder"),
                F.count(F.lit(1)).alias("rows_checked"),
                F.count_if(moved).alias("value_violations"),
                F.count_if(gap).alias("validity_violations"),
            )
        )
    combined = reports[0]
    for report in reports[1:]:
        combined = combined.unionByName(report)
    return combined


def causality_summary(report: DataFrame, by: Sequence[str] = ("builder",)) -> DataFrame:
    """Violating cases per builder; an audit without cases does not pass."""
    bad = (F.col("value_violations") > 0) | (F.col("validity_violations") > 0)
    return report.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cases"),
        F.sum("rows_checked").alias("rows_checked"),
        F.count_if(F.col("value_violations") > 0).alias("value_violations"),
        F.count_if(F.col("validity_violations") > 0).alias("validity_violations"),
        (F.count_if(bad) == 0).alias("passed"),
    )


def feature_cosine(pairs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cosine per symbol over all cells of two feature tables that stand side by side (``a_`` and ``b_`` names)."""

    def dot(left: str, right: str) -> Column:
        terms = [F.coalesce(F.col(f"{left}_{c}") * F.col(f"{right}_{c}"), F.lit(0.0)) for c in columns]
        return F.sum(sum(terms, F.lit(0.0)))

    sums = pairs.groupBy("symbol").agg(dot("a", "b").alias("ab"), dot("a", "a").alias("aa"), dot("b", "b").alias("bb"))
    norm = F.sqrt("aa") * F.sqrt("bb")
    return sums.select("symbol", F.when(norm > 1e-12, F.col("ab") / norm).otherwise(0.0).alias("cosine"))


# --- gold set ------------------------------------------------------------------------------------


def cohens_kappa(pairs: DataFrame, min_kappa: float = MIN_KAPPA) -> DataFrame:
    """Agreement per label from ``label, a, b`` rows (two annotators' classes)."""
    cells = pairs.groupBy("label", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    totals = cells.groupBy("label").agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("agreed")
    )
    side_a = cells.groupBy("label", F.col("a").alias("class")).agg(F.sum("n").alias("na"))
    side_b = cells.groupBy("label", F.col("b").alias("class")).agg(F.sum("n").alias("nb"))
    expected = (
        side_a.join(side_b, ["label", "class"]).groupBy("label").agg(F.sum(F.col("na") * F.col("nb")).alias("products"))
    )
    joined = totals.join(expected, "label", "left")
    observed = F.col("agreed") / F.col("total")
    chance = F.coalesce("products", F.lit(0)) / (F.col("total") * F.col("total"))
    kappa = (observed - chance) / F.greatest(1 - chance, F.lit(1e-12))
    return joined.select("label", F.col("total").alias("pairs"), kappa.alias("kappa"), (kappa >= min_kappa).alias("passed"))


def annotator_pairs(gold: DataFrame) -> DataFrame:
    """``label, a, b`` rows where both annotators judged a label of the record."""
    keys = F.explode(F.map_keys("labels")).alias("label")
    named = gold.select("sample_id", "annotator_a_labels", "annotator_b_labels", keys)
    sides = named.select(
        "label",
        F.try_element_at("annotator_a_labels", F.col("label")).cast("int").alias("a"),
        F.try_element_at("annotator_b_labels", F.col("label")).cast("int").alias("b"),
    )
    return sides.where(F.col("a").isNotNull() & F.col("b").isNotNull())


# Short names of events in gold records.
EVENT_SHORT = {"ut": "upthrust_score"}


def event_name(name: Column) -> Column:
    """The event label that a gold record means, NULL for none: any case, outer blanks, with or without ``_score``."""
    plain = F.lower(F.trim(name))
    names = {e.removesuffix("_score"): e for e in EVENTS} | {e: e for e in EVENTS} | EVENT_SHORT
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.try_element_at(table, plain)


def gold_lookup(gold: DataFrame, samples: DataFrame, allowed: Sequence[str] = ("double_oos",)) -> DataFrame:
    """Where each gold record's sample sits: matched, leak, split mismatch or missing."""
    joined = gold.join(samples.select("symbol", "as_of", F.col("split").alias("actual")), ["symbol", "as_of"], "left")
    expected, actual = F.col("expected_split"), F.col("actual")
    training = F.coalesce(actual.isin("train", "valid"), F.lit(False))
    found = F.coalesce(actual.isin(*allowed), F.lit(False))
    outcome = (
        F.when(expected.isNotNull() & ~expected.isin(*allowed), F.when(training, "in_sample").otherwise("split_mismatch"))
        .when(
            ~found,
            F.when(training, "in_sample")
            .when(actual.isNotNull() & expected.isNotNull() & (actual != expected), "split_mismatch")
            .otherwise("missing"),
        )
        .when(expected.isNotNull() & (actual != expected), "split_mismatch")
        .otherwise("matched")
    )
    return joined.withColumn("outcome", outcome)


def event_coverage(values: DataFrame, min_positive: int = 100, min_negative: int = 200) -> DataFrame:
    """Positives and negatives per event from ``event, value`` rows."""
    counted = values.groupBy("event").agg(
        F.count_if(F.col("value") > 0.5).alias("positive"), F.count_if(F.col("value") <= 0.5).alias("negative")
    )
    enough = (F.col("positive") >= min_positive) & (F.col("negative") >= min_negative)
    return counted.withColumn("passed", enough)


# --- out-of-sample process -------------------------------------------------------------------------


def oos_audit(experiments: DataFrame) -> DataFrame:
    """Process check per experiment: split, window order, snapshot; metrics only warn."""
    c = F.col
    missing = c("discovery_end").isNull() & c("final_oos_start").isNull() & c("final_oos_end").isNull()
    rules = [
        (missing, "RESEARCH_SPLIT_MISSING"),
        (
            ~missing
            & (
                c("final_oos_start").isNull()
                | c("final_oos_end").isNull()
                | F.coalesce(c("final_oos_start") >= c("final_oos_end"), F.lit(False))
            ),
            "FINAL_OOS_WINDOW_INVALID",
        ),
        (c("final_oos_start") < c("discovery_end"), "FINAL_OOS_OVERLAPS_DISCOVERY"),
        (F.coalesce(c("data_snapshot_id"), F.lit("")) == "", "DATA_SNAPSHOT_MISSING"),
    ]
    violations = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for rule, name in rules]))
    warnings = F.when(
        F.coalesce(c("oos_passed"), F.lit(False)), F.array().cast("array<string>")
    ).otherwise(F.array(F.lit("FINAL_OOS_METRICS_NOT_PASSED")))
    return experiments.withColumns({"violations": violations, "warnings": warnings}).withColumn(
        "audit_status", F.when(F.size("violations") == 0, "PASSED").otherwise("FAILED")
    )


def identity_hash(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])), 256)


def identity_separation(experiments: DataFrame) -> DataFrame:
    """Experiments whose discovery and final data identities coincide are not separated."""
    c = F.col
    discovery = identity_hash(c("data_snapshot_id"), c("discovery_start"), c("discovery_end"))
    final = identity_hash(c("data_snapshot_id"), c("final_oos_start"), c("final_oos_end"))
    return experiments.withColumns(
        {"discovery_identity": discovery, "final_identity": final, "separated": ~discovery.eqNullSafe(final)}
    )
