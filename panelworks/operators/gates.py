"""Decision rules over evidence tables (one row per candidate, one column per figure)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.operators.formulas import candidate_hash


@dataclass(frozen=True)
class GateLimits:
    min_window_pass_ratio: float = 0.60
    min_capacity: float = 1.0
    max_liquidity_exposure: float = 0.80
    min_sign_consistency: float = 0.55
    min_break_even_bps: float = 5.0
    min_retained_ratio: float = 0.30


def _no(name: str) -> Column:
    """TRUE when a flag is false or missing."""
    return ~F.coalesce(F.col(name), F.lit(False))


def _below(name: str, limit: float) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0)) < limit


def _reasons(rules: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for rule, name in rules]))


def _discovery_rules(limits: GateLimits) -> dict[str, Column]:
    exposed = F.coalesce(F.abs("liquidity_exposure") > limits.max_liquidity_exposure, F.lit(False))
    return {
        "WALKFORWARD_FAILED": _no("walkforward_passed"),
        "WALKFORWARD_COVERAGE_FAILED": _below("window_pass_ratio", limits.min_window_pass_ratio),
        "STATISTICAL_VALIDATION_FAILED": _no("statistics_passed"),
        "DIAGNOSTICS_MISSING": _no("has_diagnostics"),
        "EXPOSURE_MISSING": _no("has_exposure"),
        "LIQUIDITY_EXPOSURE_FAILED": F.coalesce("has_exposure", F.lit(False)) & exposed,
        "CAPACITY_MISSING": _no("has_capacity"),
        "CAPACITY_FAILED": F.coalesce("has_capacity", F.lit(False)) & _below("capacity", limits.min_capacity),
        "RECENT_ALPHA_FAILED": _no("recent_passed"),
    }


def discovery_gate(evidence: DataFrame, limits: GateLimits | None = None) -> DataFrame:
    """Admission to the finalists; out-of-sample evidence is not an input by design."""
    rules = [(rule, name) for name, rule in _discovery_rules(limits or GateLimits()).items()]
    gated = evidence.withColumn("reject_reasons", _reasons(rules))
    return gated.withColumn("passed", F.size("reject_reasons") == 0)


def assessment_id(body: Column) -> Column:
    """Id of a tradability assessment from its canonical text."""
    return F.concat(F.lit("tradability-"), F.substring(F.sha2(body, 256), 1, 32))


def promotion_gate(evidence: DataFrame, limits: GateLimits | None = None) -> DataFrame:
    """Discovery rules plus out-of-sample, audit, decay and (formal) tradability rules.

    A tradability assessment is ``tradability_body``, its canonical text without its id, and ``tradability_id``, the id
    it claims, which derives from the text; one that is otherwise sound must match (a missing one does not).
    """
    first = _discovery_rules(limits or GateLimits())
    decayed = (
        F.coalesce("has_diagnostics", F.lit(False))
        & F.coalesce(F.abs("ic_decay_1") > 1e-8, F.lit(False))
        & F.coalesce(F.abs("ic_decay_5") <= 1e-8, F.lit(False))
    )
    formal = F.coalesce("formal", F.lit(False))
    traded = F.coalesce("has_tradability", F.lit(False))
    sound = F.coalesce("tradability_eligible", F.lit(False)) & F.coalesce("tradability_passed", F.lit(False))
    intact = assessment_id(F.col("tradability_body")) == F.col("tradability_id")
    named = {
        **{k: first[k] for k in ("WALKFORWARD_FAILED", "WALKFORWARD_COVERAGE_FAILED", "STATISTICAL_VALIDATION_FAILED")},
        "FINAL_OOS_FAILED": _no("final_oos_passed"),
        "OOS_AUDIT_FAILED": ~F.col("oos_audit_status").eqNullSafe("PASSED"),
        "DIAGNOSTICS_MISSING": first["DIAGNOSTICS_MISSING"],
        "IC_DECAY_FAILED": decayed,
        **{
            k: first[k]
            for k in (
                "EXPOSURE_MISSING",
                "LIQUIDITY_EXPOSURE_FAILED",
                "CAPACITY_MISSING",
                "CAPACITY_FAILED",
                "RECENT_ALPHA_FAILED",
            )
        },
        "TRADABILITY_ASSESSMENT_MISSING": formal & ~traded,
        "TRADABILITY_CAPACITY_FAILED": formal & traded & ~sound,
        "TRADABILITY_ARTIFACT_INTEGRITY_FAILED": formal & traded & sound & ~F.coalesce(intact, F.lit(False)),
    }
    gated = evidence.withColumn("reject_reasons", _reasons([(rule, name) for name, rule in named.items()]))
    return gated.withColumn("passed", F.size("reject_reasons") == 0)


def staged_promotion_gate(evidence: DataFrame, limits: GateLimits | None = None) -> DataFrame:
    """Every failed stage of the staged gate as (gate, reason) pairs.

    ``critical_flags`` is an array of flag names; ``final_oos_reason`` replaces the plain
    reason where it is known; governance is three parts: evidence, experiment and freeze.
    """
    m = limits or GateLimits()
    c = F.col
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    quality, stable = F.coalesce("has_quality", F.lit(False)), F.coalesce("has_stability", F.lit(False))
    cost, exposed = F.coalesce("has_cost", F.lit(False)), F.coalesce("has_exposure", F.lit(False))
    traded, formal = F.coalesce("has_tradability", F.lit(False)), F.coalesce("formal", F.lit(False))
    sound = F.coalesce("tradability_eligible", F.lit(False)) & F.coalesce("tradability_passed", F.lit(False))
    won, governed = F.coalesce("walkforward_passed", F.lit(False)), F.coalesce("has_governance", F.lit(False))
    consistency = F.coalesce("ic_sign_consistency", F.lit(0.0))
    # Gate names and reason texts, which callers match.
    rules = [
        ("DATA_QUALITY", ~quality, "data quality report missing"),
        (
            "DATA_QUALITY",
            quality & (F.coalesce(F.size("critical_flags"), F.lit(0)) > 0),
            text("critical quality flags: ", F.array_join("critical_flags", ", ")),
        ),
        ("DISCOVERY_IC", ~won, "walk-forward discovery gate failed"),
        (
            "DISCOVERY_IC",
            won & _below("window_pass_ratio", m.min_window_pass_ratio),
            f"window pass ratio < {m.min_window_pass_ratio}",
        ),
        ("STABILITY", ~stable, "stability report missing"),
        (
            "STABILITY",
            stable & (consistency < m.min_sign_consistency),
            text("ic sign consistency ", consistency.cast("string"), f" < {m.min_sign_consistency}"),
        ),
        (
            "STABILITY",
            stable & F.coalesce(c("worst_regime_ic") <= 0, F.lit(False)),
            text("worst regime ic <= 0 (", c("worst_regime_ic").cast("string"), ")"),
        ),
        ("MULTIPLE_TESTING", _no("statistics_passed"), "FDR adjusted p-value > threshold (or DSR/PBO failed)"),
        (
            "FINAL_OOS",
            _no("final_oos_passed"),
            F.coalesce(F.when(c("final_oos_reason") != "", c("final_oos_reason")), F.lit("final oos evaluation failed")),
        ),
        (
            "FINAL_OOS",
            F.coalesce(c("oos_audit_status") != "PASSED", F.lit(False)),
            text("oos audit status ", c("oos_audit_status")),
        ),
        ("COST_SENSITIVITY", ~cost, "cost sensitivity report missing"),
        ("COST_SENSITIVITY", cost & _below("break_even_bps", m.min_break_even_bps), f"break-even cost < {m.min_break_even_bps}bps"),
        ("EXPOSURE_NEUTRALIZATION", ~exposed, "exposure report missing"),
        (
            "EXPOSURE_NEUTRALIZATION",
            exposed & F.coalesce(F.abs("liquidity_exposure") > m.max_liquidity_exposure, F.lit(False)),
            text("liquidity exposure ", c("liquidity_exposure").cast("string"), " exceeds limit"),
        ),
        (
            "EXPOSURE_NEUTRALIZATION",
            exposed & F.coalesce(c("ic_retained_ratio") < m.min_retained_ratio, F.lit(False)),
            text("neutralized ic retained ratio ", c("ic_retained_ratio").cast("string"), f" < {m.min_retained_ratio}"),
        ),
        ("RESEARCH_GOVERNANCE", ~governed, "governance evidence missing (experiment lineage / freeze required)"),
        ("RESEARCH_GOVERNANCE", governed & _no("has_experiment"), "experiment_id missing"),
        ("RESEARCH_GOVERNANCE", governed & _no("has_freeze"), "candidate_freeze missing"),
        ("TRADABILITY_CAPACITY", formal & ~traded, "tradability assessment artifact missing"),
        ("TRADABILITY_CAPACITY", traded & ~sound, "tradability/capacity gate failed"),
    ]
    pairs = F.array_compact(
        F.array(*[F.when(rule, F.struct(F.lit(g).alias("gate"), (r if isinstance(r, Column) else F.lit(r)).alias("reason"))) for g, rule, r in rules])
    )
    gated = evidence.withColumn("failed_gates", pairs)
    return gated.withColumn("passed", F.size("failed_gates") == 0)


def threshold_gate(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Check long metrics against a table of limits.

    ``thresholds`` holds ``metric, operator (>= or <=), limit_value, hard``. A
    missing metric fails; a failed soft check only warns.
    """
    joined = thresholds.join(metrics.select("metric", "value"), "metric", "left")
    held = F.when(F.col("operator") == ">=", F.col("value") >= F.col("limit_value")).otherwise(
        F.col("value") <= F.col("limit_value")
    )
    passed = F.coalesce(held, F.lit(False))
    outcome = F.when(passed, "PASS").when(F.col("hard"), "FAIL").otherwise("WARN")
    return joined.withColumns({"passed": passed, "outcome": outcome})


# Limits of a model's reliability.
RELIABILITY_LIMITS = (
    ("data.shortcut_violations", "<=", 0.0),
    ("data.future_leakage_violations", "<=", 0.0),
    ("data.split_overlap", "<=", 0.0),
    ("ma.slope_sign_accuracy", ">=", 0.90),
    ("ma.slope_pearson", ">=", 0.88),
    ("ma.alignment_spearman", ">=", 0.92),
    ("boll.percent_b_pearson", ">=", 0.95),
    ("boll.bandwidth_pearson", ">=", 0.92),
    ("boll.squeeze_spearman", ">=", 0.90),
    ("boll.expansion_spearman", ">=", 0.82),
    ("wyckoff.primitive_spearman", ">=", 0.75),
    ("phase.macro_f1", ">=", 0.70),
    ("gold.kappa", ">=", 0.60),
)


def reliability_gate(metrics: DataFrame, limits: Sequence[tuple[str, str, float]] = RELIABILITY_LIMITS) -> DataFrame:
    """One row per ``model``: whether every limit holds, and the names of those that fail, in their order.

    ``metrics`` holds ``model, metric, value``. A figure that is absent, NULL or not a number fails; of repeated figures
    the worst counts.
    """
    rows = [F.struct(F.lit(i).alias("at"), *[F.lit(v).alias(n) for n, v in zip(("metric", "operator", "edge"), x)]) for i, x in enumerate(limits)]
    wanted = metrics.select("model").distinct().select("model", F.explode(F.array(*rows)).alias("limit")).select("model", "limit.*")
    value = F.when(~F.isnan("value"), F.col("value"))
    worst = metrics.groupBy("model", "metric").agg(
        F.min(value).alias("least"), F.max(value).alias("most"), (F.count(value) == F.count(F.lit(1))).alias("whole")
    )
    held = F.when(F.col("operator") == ">=", F.col("least") >= F.col("edge")).otherwise(F.col("most") <= F.col("edge"))
    checked = wanted.join(worst, ["model", "metric"], "left").withColumn("held", F.coalesce(held & F.col("whole"), F.lit(False)))
    failed = F.array_sort(F.collect_list(F.when(~F.col("held"), F.struct("at", "metric"))))  # at most the limits
    return checked.groupBy("model").agg(F.bool_and("held").alias("passed"), F.transform(failed, lambda x: x["metric"]).alias("failed"))


def candidate_status(evidence: DataFrame) -> DataFrame:
    """Research status from finalist, out-of-sample, promotion and discovery flags."""
    flag = {n: F.coalesce(n, F.lit(False)) for n in ("is_finalist", "oos_passed", "promotion_passed", "discovery_passed")}
    status = (
        F.when(flag["is_finalist"] & flag["oos_passed"] & flag["promotion_passed"], "OOS_PASSED")
        .when(flag["is_finalist"] & flag["oos_passed"], "DISCOVERY_PASSED")
        .when(flag["is_finalist"], "OOS_FAILED")
        .when(flag["discovery_passed"], "DISCOVERY_PASSED")
        .otherwise("DISCOVERY_CANDIDATE")
    )
    return evidence.withColumn("status", status)


# Allowed status changes per kind of object.
FACTOR_EDGES = {
    "DRAFT": ("DISCOVERY_CANDIDATE", "INVALIDATED"),
    "DISCOVERY_CANDIDATE": ("DISCOVERY_PASSED", "FINALIST", "RETIRED", "INVALIDATED"),
    "DISCOVERY_PASSED": ("FINALIST", "RETIRED", "INVALIDATED"),
    "FINALIST": ("OOS_PASSED", "OOS_FAILED", "INVALIDATED"),
    "OOS_PASSED": ("PROMOTED", "INVALIDATED"),
    "OOS_FAILED": ("RETIRED", "INVALIDATED"),
    "PROMOTED": ("ACTIVE", "DEGRADED", "INVALIDATED"),
    "ACTIVE": ("DEGRADED", "RETIRED"),
    "DEGRADED": ("ACTIVE", "RETIRED"),
}
EXPERIMENT_EDGES = {
    "CREATED": ("DISCOVERY_RUNNING",),
    "DISCOVERY_RUNNING": ("DISCOVERY_COMPLETED",),
    "DISCOVERY_COMPLETED": ("FINALIST_SELECTED",),
    "FINALIST_SELECTED": ("FROZEN", "COMPLETED"),
    "FROZEN": ("OOS_AUTHORIZED",),
    "OOS_AUTHORIZED": ("OOS_EVALUATED",),
    "OOS_EVALUATED": ("COMPLETED",),
}
CHECKPOINT_EDGES = {
    "TRAINING": ("CANDIDATE",),
    "CANDIDATE": ("VALIDATED", "REJECTED"),
    "VALIDATED": ("TESTED", "REJECTED"),
    "TESTED": ("RELIABILITY_PASSED", "REJECTED"),
    "RELIABILITY_PASSED": ("ACTIVE", "REJECTED"),
}
EXPERIMENT_EXITS = ("FAILED", "OOS_INVALIDATED")


def illegal_transitions(log: DataFrame, edges: dict[str, tuple[str, ...]], exits: tuple[str, ...] = ()) -> DataFrame:
    """Status changes of an event log (``object_id, seq, status``) that no edge allows.

    ``exits`` may follow any state that has an outgoing edge.
    """
    before = F.lag("status").over(Window.partitionBy("object_id").orderBy("seq"))
    steps = log.withColumn("previous", before).where(F.col("previous").isNotNull())
    pairs = [f"{a}>{b}" for a, targets in edges.items() for b in (*targets, *exits)]
    step = F.concat_ws(">", "previous", "status")
    return steps.where(~step.isin(*pairs)).select("object_id", "seq", "previous", "status")


def frozen_identity(candidates: DataFrame, snapshot_id: str, discovery: tuple[int, int], final: tuple[int, int]) -> DataFrame:
    """Hashes a frozen candidate is tied to: formula, and both data ranges."""

    def reference(label: str, span: tuple[int, int]) -> Column:
        material = F.lit(f"{snapshot_id}:{label}:{span[0]}:{span[1]}")
        return F.concat(F.lit(f"mds-{label}-"), F.substring(F.sha2(material, 256), 1, 16))

    return candidates.withColumns(
        {
            "candidate_hash": candidate_hash(F.col("rpn")),
            "discovery_snapshot_id": reference("discovery", discovery),
            "final_oos_snapshot_id": reference("final-oos", final),
        }
    )


def candidate_set_hash(candidates: DataFrame, scope: str, member: str) -> DataFrame:
    """Order-free hash of a candidate set; NULL, blank or repeated members are refused.

    A set is limited by the search budget, so its ids fit one row.
    """
    ids = F.sort_array(F.collect_list(F.col(member).cast("string")))
    bad = F.bool_or(F.coalesce(F.trim(F.col(member).cast("string")), F.lit("")) == "")
    repeated = F.count_distinct(member) != F.count(F.lit(1))
    body = F.to_json(F.struct(ids.alias("candidate_ids")))
    return candidates.groupBy(scope).agg(
        F.when(bad | repeated, F.raise_error(F.lit("invalid candidate set"))).otherwise(F.sha2(body, 256)).alias("set_hash")
    )


def frozen_values(values: DataFrame, freezes: DataFrame, most: int = 3) -> DataFrame:
    """Factor values of frozen, still valid finalists only; more than ``most`` of them are refused."""
    allowed = freezes.where(F.col("frozen") & ~F.coalesce(F.col("invalidated"), F.lit(False)))
    size = allowed.agg(F.count(F.lit(1)).alias("_n"))  # one row
    fits = F.when(F.col("_n") <= most, True).otherwise(F.raise_error(F.lit(f"more than {most} frozen finalists")))
    best = allowed.crossJoin(F.broadcast(size)).where(fits).select("factor_id")
    return values.join(F.broadcast(best), "factor_id", "left_semi")
