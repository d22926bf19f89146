"""Tradability, capacity, gates, selection and alpha scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.operators import evaluate as ev
from panelworks.operators import formulas as fm
from panelworks.operators import gates, selection, tradability
from panelworks.plans import inputs
from panelworks.plans.factors import EVALUATED_COLUMNS, compared_evaluation, evaluation_sql
from panelworks.plans.formula_sql import formula_ctes
from panelworks.plans.inputs import HORIZON, with_bars
from panelworks.plans.registry import query, rounded
from panelworks.plans.research import _BATCH_SQL, _SMALL_BATCH, batch_values

# --- tradability -----------------------------------------------------------------------------------


def tradable_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense cells of one formula with trading flags."""
    panel = inputs.panel(spark, sf_dir, None)
    formula = "ret ts_mean_5 neg cs_rank"
    terms = fm.reduce_formula(formula.split(), panel.columns)
    wide, name = fm.formula_columns(panel, terms, inputs.universe(sf_dir)[0])
    return wide.select(
        F.lit("ret_mean_reversal_5d").alias("factor_id"),
        "symbol",
        "d",
        (F.col(name[formula]) - 0.5).alias("value"),
        "close",
        "amount",
        F.col("volume").isNotNull().cast("double").alias("tradable"),
        F.col("volume").isNull().cast("double").alias("halted"),
        (F.abs("ret") > 2).cast("double").alias("limit_hit"),
    )


CELLS_SQL = """, m5 AS (SELECT *, CASE WHEN d >= 4 THEN -avg(ret) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS raw FROM panel),
cell AS (SELECT symbol, d, close, amount, CASE WHEN raw IS NOT NULL THEN row_number() OVER (PARTITION BY d ORDER BY raw NULLS LAST, symbol) / CAST(count(raw) OVER (PARTITION BY d) AS DOUBLE) - 0.5 END AS value,
  volume IS NOT NULL AS tr, abs(ret) > 2 AS lim FROM m5),
st AS (SELECT *, coalesce(value IS NOT NULL AND close > 0 AND tr, FALSE) AS ok, coalesce(sign(value), 0) AS dir, lead(close) OVER s / close - 1 AS f1, lead(close, 5) OVER s / close - 1 AS f5, lead(close, 10) OVER s / close - 1 AS f10
  FROM cell WINDOW s AS (PARTITION BY symbol ORDER BY d)),
dy AS (SELECT d, avg(dir * f1) FILTER (WHERE ok AND f1 IS NOT NULL) AS gross, count(*) FILTER (WHERE ok AND f1 IS NOT NULL) AS fw, count(*) FILTER (WHERE ok AND f1 IS NOT NULL AND lim) AS li, count(*) FILTER (WHERE ok) AS nok,
  sum(CASE WHEN ok THEN abs(value) ELSE 0 END) AS sc, sum(CASE WHEN ok THEN abs(value) ELSE 0 END * coalesce(amount, 0)) AS td, sum(amount) FILTER (WHERE ok) AS av, avg(amount) FILTER (WHERE tr AND amount > 0) AS am FROM st GROUP BY 1),
rt AS (SELECT coalesce(avg(gross), 0) AS g, sum(li) / sum(fw)::DOUBLE AS lh, avg(CASE WHEN sc > 0 AND av > 0 THEN td / sc / av ELSE 0 END) AS ws, avg(am) AS aa FROM dy),
h1 AS (SELECT symbol, d, CASE WHEN ok THEN value ELSE 0 END AS h, coalesce(value, 0) AS h2 FROM st),
h2 AS (SELECT symbol, d, h - avg(h) OVER (PARTITION BY d) AS c, h2 - avg(h2) OVER (PARTITION BY d) AS c2 FROM h1),
h3 AS (SELECT symbol, d, coalesce(c / nullif(sum(abs(c)) OVER (PARTITION BY d), 0), 0) AS w, coalesce(c2 / nullif(sum(abs(c2)) OVER (PARTITION BY d), 0), 0) AS w2 FROM h2),
mv AS (SELECT d, sum(a) AS a, sum(a2) AS a2 FROM (SELECT d, abs(w - lag(w) OVER s) AS a, abs(w2 - lag(w2) OVER s) AS a2 FROM h3 WINDOW s AS (PARTITION BY symbol ORDER BY d)) GROUP BY 1),
tn AS (SELECT avg(a) / 2 AS t, avg(a2) / 2 AS t2 FROM mv)
"""


@query(
    "tradability_assessment",
    with_bars(
        CELLS_SQL
        + """, x AS (SELECT *, least(g, g - t * 15 / 10000) AS net, ws * t AS pr FROM rt, tn),
y AS (SELECT *, list_filter([CASE WHEN lh > 0.05 THEN 'LIMIT_FILLABILITY_FAILED' END, CASE WHEN t > 0.8 THEN 'HIGH_TURNOVER_FAILED' END, CASE WHEN pr > 0.25 THEN 'PARTICIPATION_RATE_FAILED' END,
  CASE WHEN aa < 1000000 THEN 'CAPACITY_FAILED' END, CASE WHEN net * 250 < 0 THEN 'NET_RETURN_BELOW_POLICY_MINIMUM' END], lambda v: v IS NOT NULL) AS reasons FROM x)
SELECT 'ret_mean_reversal_5d' AS factor_id, round(g, 6) + 0.0 AS gross_return, round(net, 6) + 0.0 AS net_return, round(net * 250, 4) + 0.0 AS net_annualized_return, round(t, 6) AS turnover, round(t * 15, 6) AS cost_drag_bps,
 round(lh, 6) AS limit_hit_rate, 0.0::DOUBLE AS halt_exposure, round(pr, 8) AS participation_rate, round(aa, 2) AS average_amount, reasons, len(reasons) = 0 AS passed FROM y"""
    ),
)
def tradability_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = tradability.assess(tradable_cells(spark, sf_dir))
    return rounded(result, 6, net_annualized_return=4, participation_rate=8, average_amount=2)


@query(
    "holding_sensitivity",
    with_bars(
        CELLS_SQL
        + """SELECT 'ret_mean_reversal_5d' AS factor_id, h AS horizon, round(m, 6) + 0.0 AS mean_return FROM (SELECT 1 AS h, avg(dir * f1) FILTER (WHERE ok) AS m FROM st
 UNION ALL SELECT 5, avg(dir * f5) FILTER (WHERE ok) FROM st UNION ALL SELECT 10, avg(dir * f10) FILTER (WHERE ok) FROM st)"""
    ),
)
def holding_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tradability.holding_sensitivity(tradable_cells(spark, sf_dir)))


@query(
    "capacity_curve",
    with_bars(
        CELLS_SQL
        + """, c AS (SELECT r, 15 * greatest(1, sqrt(r / 0.01)) AS cost FROM (SELECT unnest([0.01, 0.025, 0.05, 0.10, 0.20]::DOUBLE[]) AS r))
SELECT 'ret_mean_reversal_5d' AS factor_id, r AS participation_rate, round(aa * r / greatest(t2, 1e-12), 2) AS max_capital, round(cost, 6) AS estimated_cost_bps,
 round(least(g, g - t2 * cost / 10000) * 250, 4) + 0.0 AS net_annualized_return FROM rt, tn, c"""
    ),
)
def capacity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = tradable_cells(spark, sf_dir)
    gross = tradability.assess(cells).select("factor_id", "gross_return")
    curve = tradability.capacity_curve(cells, gross)
    return rounded(curve, 6, max_capital=2, net_annualized_return=4)


# --- selection -----------------------------------------------------------------------------------


@query(
    "candidate_correlations",
    with_bars(
        _BATCH_SQL
        + """, p AS (SELECT a.factor_id AS "left", b.factor_id AS "right", count(*) AS cells, corr(a.value, b.value) AS r FROM fv a JOIN fv b ON a.symbol = b.symbol AND a.d = b.d AND a.factor_id < b.factor_id GROUP BY 1, 2)
SELECT "left", "right", cells, round(r, 6) + 0.0 AS correlation FROM p"""
    ),
)
def candidate_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = batch_values(spark, sf_dir, keep=())
    return rounded(selection.candidate_correlations(values, list(_SMALL_BATCH)))


_TWINS = {
    **_SMALL_BATCH,
    "reversal_mean_10d": "ret ts_mean_10 neg cs_rank".split(),
    "momentum_sum_10d": "ret ts_sum_10 cs_rank".split(),
    "vwap_ratio": "vwap close div cs_rank".split(),
}


@query(
    "correlation_dedupe",
    with_bars(
        formula_ctes(_TWINS, keep="")
        + """, c AS (SELECT a.factor_id AS l, b.factor_id AS r FROM fv a JOIN fv b ON a.symbol = b.symbol AND a.d = b.d AND a.factor_id <> b.factor_id GROUP BY 1, 2 HAVING count(*) >= 10 AND abs(corr(a.value, b.value)) >= 0.95),
o AS (SELECT factor_id, CAST(row_number() OVER (ORDER BY n DESC, factor_id) AS INTEGER) AS place FROM (SELECT factor_id, count(*) AS n FROM fv GROUP BY 1)),
nr AS (SELECT o.place, coalesce(list(y.place) FILTER (WHERE y.place < o.place), CAST([] AS INTEGER[])) AS near FROM o LEFT JOIN c ON c.l = o.factor_id LEFT JOIN o y ON y.factor_id = c.r GROUP BY 1),
g(step, kept) AS (SELECT 0, CAST([] AS INTEGER[]) UNION ALL SELECT step + 1, CASE WHEN len(list_intersect(kept, near)) > 0 THEN kept ELSE list_append(kept, step + 1) END FROM g JOIN nr ON nr.place = step + 1),
f AS (SELECT kept FROM g ORDER BY step DESC LIMIT 1),
t AS (SELECT place, list_min(list_intersect(near, kept)) AS twin FROM nr, f)
SELECT o.factor_id, o.place, twin IS NULL AS retained, r.factor_id AS representative FROM t JOIN o USING (place) LEFT JOIN o r ON r.place = t.twin"""
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def correlation_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = inputs.panel(spark, sf_dir, None)
    values = fm.factor_values(panel, _TWINS, inputs.universe(sf_dir)[0])
    cells = selection.candidate_cells(values, list(_TWINS))
    pairs = selection.cell_correlations(cells, list(_TWINS))
    rated = selection.cell_counts(cells, list(_TWINS))
    rated = rated.select("factor_id", F.col("cells").cast("double").alias("fitness"), F.col("factor_id").alias("seq"))
    return selection.correlation_dedupe(rated, pairs, threshold=0.95)


@query(
    "alpha_scores",
    with_bars(
        _BATCH_SQL
        + """, l AS (SELECT *, row_number() OVER (PARTITION BY factor_id ORDER BY value, symbol) / CAST(count(*) OVER (PARTITION BY factor_id) AS DOUBLE) AS share FROM fv WHERE d = n_days - 1),
s AS (SELECT symbol, avg(share) AS score, count(*) AS v, list(factor_id ORDER BY factor_id) AS factors FROM l GROUP BY 1),
n AS (SELECT count(DISTINCT factor_id) AS f FROM l)
SELECT symbol, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, symbol) AS rank, round(v / f::DOUBLE, 6) AS coverage, round(v / f::DOUBLE * (1 - 1.0 / count(*) OVER ()), 6) AS confidence, factors FROM s, n"""
    ),
)
def alpha_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols, n_days = inputs.universe(sf_dir)
    scored = selection.alpha_scores(batch_values(spark, sf_dir, keep=()), n_days - 1, symbols)
    factors = F.transform("contributions", lambda c: c["factor_id"]).alias("factors")
    return rounded(scored.select("symbol", "score", "rank", "coverage", "confidence", factors))


# --- evidence tables derived from the orders -----------------------------------------------------------


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")

    def flag(n: int) -> Column:
        return k % n != 0

    body = F.to_json(F.struct(k.alias("candidate_id"), (k % 5).alias("days")))
    claimed = F.when(k % 5 == 4, gates.assessment_id(F.concat(body, F.lit(" ")))).when(k % 7 != 3, gates.assessment_id(body))
    return inputs.table(spark, sf_dir, "orders").select(
        k.alias("candidate_id"),
        body.alias("tradability_body"),
        claimed.alias("tradability_id"),
        flag(2).alias("walkforward_passed"),
        ((k % 10) / 10).alias("window_pass_ratio"),
        flag(3).alias("statistics_passed"),
        flag(11).alias("has_diagnostics"),
        flag(13).alias("has_exposure"),
        F.when(k % 4 != 0, (k % 100) / 100).alias("liquidity_exposure"),
        flag(17).alias("has_capacity"),
        (F.col("o_totalprice") / 100000).alias("capacity"),
        flag(5).alias("recent_passed"),
        flag(7).alias("final_oos_passed"),
        F.when(k % 9 != 0, "PASSED").when(k % 2 == 0, "FAILED").alias("oos_audit_status"),
        F.lit(0.02).alias("ic_decay_1"),
        ((k % 6) / 100).alias("ic_decay_5"),
        (k % 3 == 1).alias("formal"),
        flag(19).alias("has_tradability"),
        flag(8).alias("tradability_eligible"),
        flag(6).alias("tradability_passed"),
        flag(23).alias("has_quality"),
        F.slice(F.array(*map(F.lit, ("STALE", "GAP", "SPIKE"))), F.lit(1), (k % 4).cast("int")).alias("critical_flags"),
        flag(29).alias("has_stability"),
        ((k % 20) / 20).alias("ic_sign_consistency"),
        ((k % 9) / 100 - 0.02).alias("worst_regime_ic"),
        flag(31).alias("has_cost"),
        (k % 12).cast("double").alias("break_even_bps"),
        ((k % 7) / 10).alias("ic_retained_ratio"),
        flag(37).alias("has_governance"),
        flag(41).alias("has_experiment"),
        flag(43).alias("has_freeze"),
        F.when(k % 14 == 0, "OOS_IC_BELOW_MINIMUM").alias("final_oos_reason"),
    )


_E = """WITH e AS (SELECT k, cap, 'tradability-' || sha256(body)[:32] AS own, 'tradability-' || CASE WHEN k % 5 = 4 THEN sha256(body || ' ')[:32] WHEN k % 7 <> 3 THEN sha256(body)[:32] END AS claimed
  FROM (SELECT o_orderkey AS k, o_totalprice / 100000 AS cap, concat('{"candidate_id":', o_orderkey, ',"days":', o_orderkey % 5, '}') AS body FROM orders))
"""
_DISCOVERY = [
    ("k % 2 = 0", "WALKFORWARD_FAILED"),
    ("(k % 10) / 10.0::DOUBLE < 0.6", "WALKFORWARD_COVERAGE_FAILED"),
    ("k % 3 = 0", "STATISTICAL_VALIDATION_FAILED"),
    ("k % 11 = 0", "DIAGNOSTICS_MISSING"),
    ("k % 13 = 0", "EXPOSURE_MISSING"),
    ("k % 13 <> 0 AND k % 4 <> 0 AND (k % 100) / 100.0::DOUBLE > 0.8", "LIQUIDITY_EXPOSURE_FAILED"),
    ("k % 17 = 0", "CAPACITY_MISSING"),
    ("k % 17 <> 0 AND cap < 1", "CAPACITY_FAILED"),
    ("k % 5 = 0", "RECENT_ALPHA_FAILED"),
]


def _listed(rules: list[tuple[str, str]]) -> str:
    cases = ", ".join(f"CASE WHEN {rule} THEN '{name}' END" for rule, name in rules)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


@query("discovery_gate", _E + f"SELECT k AS candidate_id, {_listed(_DISCOVERY)} AS reject_reasons, len({_listed(_DISCOVERY)}) = 0 AS passed FROM e")
def discovery_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.discovery_gate(evidence(spark, sf_dir)).select("candidate_id", "reject_reasons", "passed")


_PROMOTION = [
    *_DISCOVERY[:3],
    ("k % 7 = 0", "FINAL_OOS_FAILED"),
    ("k % 9 = 0", "OOS_AUDIT_FAILED"),
    _DISCOVERY[3],
    ("k % 11 <> 0 AND k % 6 = 0", "IC_DECAY_FAILED"),
    *_DISCOVERY[4:],
    ("k % 3 = 1 AND k % 19 = 0", "TRADABILITY_ASSESSMENT_MISSING"),
    ("k % 3 = 1 AND k % 19 <> 0 AND (k % 8 = 0 OR k % 6 = 0)", "TRADABILITY_CAPACITY_FAILED"),
    ("k % 3 = 1 AND k % 19 <> 0 AND k % 8 <> 0 AND k % 6 <> 0 AND own IS DISTINCT FROM claimed", "TRADABILITY_ARTIFACT_INTEGRITY_FAILED"),
]


@query("promotion_gate", _E + f"SELECT k AS candidate_id, {_listed(_PROMOTION)} AS reject_reasons, len({_listed(_PROMOTION)}) = 0 AS passed FROM e")
def promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.promotion_gate(evidence(spark, sf_dir)).select("candidate_id", "reject_reasons", "passed")


_STAGED = [
    ("k % 23 = 0", "'data quality report missing'", "DATA_QUALITY"),
    ("k % 23 <> 0 AND k % 4 > 0", "'critical quality flags: ' || array_to_string(['STALE', 'GAP', 'SPIKE'][1:k % 4], ', ')", "DATA_QUALITY"),
    ("k % 2 = 0", "'walk-forward discovery gate failed'", "DISCOVERY_IC"),
    ("k % 2 <> 0 AND (k % 10) / 10.0::DOUBLE < 0.6", "'window pass ratio < 0.6'", "DISCOVERY_IC"),
    ("k % 29 = 0", "'stability report missing'", "STABILITY"),
    ("k % 29 <> 0 AND (k % 20) / 20.0::DOUBLE < 0.55", "'ic sign consistency ' || CAST((k % 20) / 20.0::DOUBLE AS VARCHAR) || ' < 0.55'", "STABILITY"),
    ("k % 29 <> 0 AND (k % 9) / 100.0::DOUBLE - 0.02::DOUBLE <= 0", "'worst regime ic <= 0 (' || CAST((k % 9) / 100.0::DOUBLE - 0.02::DOUBLE AS VARCHAR) || ')'", "STABILITY"),
    ("k % 3 = 0", "'FDR adjusted p-value > threshold (or DSR/PBO failed)'", "MULTIPLE_TESTING"),
    ("k % 7 = 0", "CASE WHEN k % 14 = 0 THEN 'OOS_IC_BELOW_MINIMUM' ELSE 'final oos evaluation failed' END", "FINAL_OOS"),
    ("k % 9 = 0 AND k % 2 = 0", "'oos audit status FAILED'", "FINAL_OOS"),
    ("k % 31 = 0", "'cost sensitivity report missing'", "COST_SENSITIVITY"),
    ("k % 31 <> 0 AND k % 12 < 5", "'break-even cost < 5.0bps'", "COST_SENSITIVITY"),
    ("k % 13 = 0", "'exposure report missing'", "EXPOSURE_NEUTRALIZATION"),
    ("k % 13 <> 0 AND k % 4 <> 0 AND (k % 100) / 100.0::DOUBLE > 0.8", "'liquidity exposure ' || CAST((k % 100) / 100.0::DOUBLE AS VARCHAR) || ' exceeds limit'", "EXPOSURE_NEUTRALIZATION"),
    ("k % 13 <> 0 AND (k % 7) / 10.0::DOUBLE < 0.3::DOUBLE", "'neutralized ic retained ratio ' || CAST((k % 7) / 10.0::DOUBLE AS VARCHAR) || ' < 0.3'", "EXPOSURE_NEUTRALIZATION"),
    ("k % 37 = 0", "'governance evidence missing (experiment lineage / freeze required)'", "RESEARCH_GOVERNANCE"),
    ("k % 37 <> 0 AND k % 41 = 0", "'experiment_id missing'", "RESEARCH_GOVERNANCE"),
    ("k % 37 <> 0 AND k % 43 = 0", "'candidate_freeze missing'", "RESEARCH_GOVERNANCE"),
    ("k % 3 = 1 AND k % 19 = 0", "'tradability assessment artifact missing'", "TRADABILITY_CAPACITY"),
    ("k % 19 <> 0 AND (k % 8 = 0 OR k % 6 = 0)", "'tradability/capacity gate failed'", "TRADABILITY_CAPACITY"),
]
_STAGED_SQL = ", ".join(f"CASE WHEN {rule} THEN '{gate}: ' || {reason} END" for rule, reason, gate in _STAGED)


@query("staged_promotion_gate", _E + f"SELECT k AS candidate_id, list_filter([{_STAGED_SQL}], lambda x: x IS NOT NULL) AS failed FROM e")
def staged_promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = gates.staged_promotion_gate(evidence(spark, sf_dir))
    failed = F.transform("failed_gates", lambda g: F.concat_ws(": ", g["gate"], g["reason"])).alias("failed")
    return gated.select("candidate_id", failed)


@query(
    "candidate_status",
    _E
    + """SELECT k AS candidate_id, CASE WHEN k % 5 = 0 AND k % 7 <> 0 AND k % 4 <> 0 THEN 'OOS_PASSED' WHEN k % 5 = 0 AND k % 7 <> 0 THEN 'DISCOVERY_PASSED' WHEN k % 5 = 0 THEN 'OOS_FAILED'
 WHEN k % 3 <> 0 THEN 'DISCOVERY_PASSED' ELSE 'DISCOVERY_CANDIDATE' END AS status FROM e""",
)
def candidate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("candidate_id")
    flags = evidence(spark, sf_dir).select(
        "candidate_id",
        (k % 5 == 0).alias("is_finalist"),
        (k % 7 != 0).alias("oos_passed"),
        (k % 4 != 0).alias("promotion_passed"),
        (k % 3 != 0).alias("discovery_passed"),
    )
    return gates.candidate_status(flags).select("candidate_id", "status")


@query(
    "finalists",
    """WITH c AS (SELECT o_orderkey, o_orderkey % 3 <> 0 AS g, floor(o_totalprice / 50000)::DOUBLE AS f, (o_orderkey % 10) / 10.0::DOUBLE AS w, sha256(CAST(o_orderkey AS VARCHAR)) AS h FROM orders)
SELECT o_orderkey AS candidate_id, h AS candidate_hash, CAST(row_number() OVER (ORDER BY g DESC, f DESC, w DESC, h DESC) AS INTEGER) AS selection_rank FROM c ORDER BY 3 LIMIT 3""",
)
def finalists(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rated = inputs.table(spark, sf_dir, "orders").select(
        k.alias("candidate_id"),
        (k % 3 != 0).alias("gate_passed"),
        F.floor(F.col("o_totalprice") / 50000).cast("double").alias("fitness"),
        ((k % 10) / 10).alias("window_pass_ratio"),
        F.sha2(k.cast("string"), 256).alias("candidate_hash"),
    )
    return selection.select_finalists(rated, 3).select("candidate_id", "candidate_hash", "selection_rank")


_LIMITS = "('F', '>=', 140000.0, TRUE), ('O', '<=', 141000.0, TRUE), ('P', '>=', 900000.0, FALSE), ('X', '>=', 0.0, TRUE)"


@query(
    "threshold_gate",
    f"""WITH t AS (SELECT * FROM (VALUES {_LIMITS}) v(metric, operator, lim, hard)), m AS (SELECT o_orderstatus AS metric, avg(o_totalprice) AS value FROM orders GROUP BY 1)
SELECT metric, coalesce(CASE WHEN operator = '>=' THEN value >= lim ELSE value <= lim END, FALSE) AS passed,
 CASE WHEN coalesce(CASE WHEN operator = '>=' THEN value >= lim ELSE value <= lim END, FALSE) THEN 'PASS' WHEN hard THEN 'FAIL' ELSE 'WARN' END AS outcome FROM t LEFT JOIN m USING (metric)""",
)
def threshold_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = spark.sql(f"SELECT metric, operator, double(l) AS limit_value, hard FROM VALUES {_LIMITS} AS v(metric, operator, l, hard)")
    measured = inputs.table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("metric")).agg(F.avg("o_totalprice").alias("value"))
    return gates.threshold_gate(measured, limits).select("metric", "passed", "outcome")


_STATES = ("CREATED", "DISCOVERY_RUNNING", "DISCOVERY_COMPLETED", "FINALIST_SELECTED", "FROZEN", "OOS_AUTHORIZED", "OOS_EVALUATED", "COMPLETED", "FAILED")


@query(
    "illegal_transitions",
    "WITH s AS (SELECT o_custkey AS object_id, o_orderkey AS seq, ["
    + ", ".join(f"'{x}'" for x in _STATES)
    + """][o_orderkey % 9 + 1] AS status FROM orders), t AS (SELECT *, lag(status) OVER (PARTITION BY object_id ORDER BY seq) AS previous FROM s)
SELECT object_id, seq, previous, status FROM t WHERE previous IS NOT NULL AND NOT ((previous || '>' || status) IN ("""
    + ", ".join(f"'{a}>{b}'" for a, bs in gates.EXPERIMENT_EDGES.items() for b in (*bs, *gates.EXPERIMENT_EXITS))
    + "))",
)
def illegal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.array(*[F.lit(x) for x in _STATES])
    log = inputs.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("object_id"),
        F.col("o_orderkey").alias("seq"),
        F.element_at(states, (F.col("o_orderkey") % 9 + 1).cast("int")).alias("status"),
    )
    return gates.illegal_transitions(log, gates.EXPERIMENT_EDGES, gates.EXPERIMENT_EXITS)


@query(
    "active_factors",
    "SELECT p_partkey AS factor_id, p_retailprice AS updated_at FROM part WHERE p_size % 4 = 0 ORDER BY p_retailprice DESC, p_partkey LIMIT 20",
)
def active_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = inputs.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("factor_id"),
        F.when(F.col("p_size") % 4 == 0, "ACTIVE").otherwise("DRAFT").alias("status"),
        F.col("p_retailprice").alias("updated_at"),
    )
    return selection.active_factors(stored).select("factor_id", "updated_at")


@query(
    "upsert_factors",
    """WITH s AS (SELECT o_custkey AS h, o_orderkey AS factor_id, o_orderstatus AS status, o_totalprice AS metrics, o_orderkey AS u, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS n FROM orders)
SELECT h AS candidate_hash, arg_min(factor_id, row(n, u)) AS factor_id, arg_max(status, row(n, u)) AS status, arg_max(metrics, row(n, u)) AS metrics, arg_max(u, row(n, u)) AS updated_at FROM s GROUP BY 1""",
)
def upsert_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("candidate_hash"),
        F.col("o_orderkey").alias("factor_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("metrics"),
        F.col("o_orderkey").alias("updated_at"),
    )
    even = F.col("factor_id") % 2 == 0
    return selection.upsert_latest(rows.where(even), rows.where(~even))


@query(
    "supersede_sets",
    """SELECT o_orderkey AS factor_set_id, CASE WHEN lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) IS NULL THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS status FROM orders""",
)
def supersede_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = inputs.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("factor_set_id"), F.col("o_custkey").alias("scope"), F.col("o_orderdate").alias("created_at")
    )
    return selection.supersede_sets(sets).select("factor_set_id", "status")


@query(
    "equal_weight_sets",
    """WITH m AS (SELECT p_brand AS brand, list(p_partkey ORDER BY p_partkey) AS ids, list(p_size ORDER BY p_partkey) AS vs, count(*) AS n FROM part GROUP BY 1)
SELECT brand, ids AS factor_ids, round(1 / n::DOUBLE, 8) AS weight,
 'fs-' || substr(sha256('{"factor_ids":[' || array_to_string(ids, ',') || '],"factor_versions":[' || array_to_string(vs, ',') || '],"promotion_policy_version":"promotion_gate_v2"}'), 1, 16) AS members_id FROM m""",
)
def equal_weight_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    factors = inputs.table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("brand"), F.col("p_partkey").alias("factor_id"), F.col("p_size").alias("version")
    )
    sets = selection.equal_weight_set(factors, "brand")
    body = F.to_json(F.struct("factor_ids", "factor_versions", F.lit(selection.POLICY).alias("promotion_policy_version")))
    members = F.concat(F.lit("fs-"), F.substring(F.sha2(body, 256), 1, 16)).alias("members_id")
    return sets.select("brand", "factor_ids", F.col("weights")[0].alias("weight"), members)


@query(
    "candidate_set_hashes",
    """SELECT p_brand AS brand, sha256('{"candidate_ids":["' || string_agg(CAST(p_partkey AS VARCHAR), '","' ORDER BY CAST(p_partkey AS VARCHAR)) || '"]}') AS set_hash FROM part GROUP BY 1""",
)
def candidate_set_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = inputs.table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), "p_partkey")
    return gates.candidate_set_hash(parts, "brand", "p_partkey")


@query(
    "frozen_identity",
    """SELECT p_partkey AS seq, sha256(p_name) AS candidate_hash, 'mds-discovery-' || substr(sha256('snap-1:discovery:2:252'), 1, 16) AS discovery_snapshot_id,
 'mds-final-oos-' || substr(sha256('snap-1:final-oos:252:352'), 1, 16) AS final_oos_snapshot_id FROM part""",
)
def frozen_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = inputs.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.split("p_name", " ").alias("rpn"))
    return gates.frozen_identity(named, "snap-1", (2, 252), (252, 352)).drop("rpn")


_FINAL_RANGE = f"SELECT 'final' AS range_name, n_days - {HORIZON} - 100 AS day_from, n_days - {HORIZON} AS day_to, n_days - {2 * HORIZON} AS fwd_to FROM calendar LIMIT 1"


@query(
    "final_oos_evaluation",
    with_bars(
        formula_ctes({k: _SMALL_BATCH[k] for k in ("reversal_10d", "vwap_deviation")})
        + evaluation_sql(_FINAL_RANGE)
        + f"SELECT {EVALUATED_COLUMNS} FROM evaluated"
    ),
)
def final_oos_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only frozen, still valid candidates are evaluated on the withheld range."""
    symbols, n_days = inputs.universe(sf_dir)
    rows = "('reversal_10d', 1, TRUE, FALSE), ('vwap_deviation', 2, TRUE, FALSE), ('volume_surge_5_20', 3, TRUE, TRUE), ('close_breakout_20d', 4, FALSE, FALSE)"
    freezes = spark.sql(f"SELECT * FROM VALUES {rows} AS v(factor_id, selection_rank, frozen, invalidated)")
    values = gates.frozen_values(batch_values(spark, sf_dir), freezes)
    end = n_days - HORIZON
    final = ev.DayRange("final", end - 100, end, n_days)
    return compared_evaluation(ev.evaluate_ranges(values, [final], HORIZON, ev.default_top_k(symbols), symbols))


_FACTOR_STATES = tuple(gates.FACTOR_EDGES) + ("RETIRED", "INVALIDATED")
_CHECKPOINT_STATES = tuple(gates.CHECKPOINT_EDGES) + ("ACTIVE", "REJECTED")


def _transition_sql(states: tuple[str, ...], edges: dict[str, tuple[str, ...]]) -> str:
    names = ", ".join(f"'{x}'" for x in states)
    allowed = ", ".join(f"'{a}>{b}'" for a, targets in edges.items() for b in targets)
    return f"""WITH s AS (SELECT l_suppkey AS object_id, l_orderkey * 10 + l_linenumber AS seq, [{names}][(l_orderkey + l_linenumber) % {len(states)} + 1] AS status FROM lineitem),
t AS (SELECT *, lag(status) OVER (PARTITION BY object_id ORDER BY seq) AS previous FROM s)
SELECT object_id, seq, previous, status FROM t WHERE previous IS NOT NULL AND (previous || '>' || status) NOT IN ({allowed})"""


def _status_log(spark: SparkSession, sf_dir: str, states: tuple[str, ...]) -> DataFrame:
    at = (F.col("l_orderkey") + F.col("l_linenumber")) % len(states) + 1
    return inputs.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("object_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.element_at(F.array(*[F.lit(x) for x in states]), at.cast("int")).alias("status"),
    )


@query("illegal_factor_transitions", _transition_sql(_FACTOR_STATES, gates.FACTOR_EDGES))
def illegal_factor_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.illegal_transitions(_status_log(spark, sf_dir, _FACTOR_STATES), gates.FACTOR_EDGES)


@query("illegal_checkpoint_transitions", _transition_sql(_CHECKPOINT_STATES, gates.CHECKPOINT_EDGES))
def illegal_checkpoint_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.illegal_transitions(_status_log(spark, sf_dir, _CHECKPOINT_STATES), gates.CHECKPOINT_EDGES)


_LIMIT_NAMES = [name for name, _, _ in gates.RELIABILITY_LIMITS]


@query(
    "reliability_gate",
    "WITH m AS (SELECT o_custkey AS model, ["
    + ", ".join(f"'{x}'" for x in _LIMIT_NAMES)
    + f"""][o_orderkey % {len(_LIMIT_NAMES)} + 1] AS metric, CASE WHEN o_orderkey % 17 <> 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 0.0::DOUBLE ELSE 0.7::DOUBLE + (o_orderkey % 30) / 100.0::DOUBLE END END AS value FROM orders),
l AS (SELECT * FROM (VALUES """
    + ", ".join(f"({i}, '{n}', '{o}', {v}::DOUBLE)" for i, (n, o, v) in enumerate(gates.RELIABILITY_LIMITS))
    + """) v(place, metric, operator, edge)),
c AS (SELECT d.model, l.place, l.metric, coalesce((SELECT bool_and(coalesce(CASE WHEN l.operator = '>=' THEN m.value >= l.edge ELSE m.value <= l.edge END, FALSE)) FROM m WHERE m.model = d.model AND m.metric = l.metric), FALSE) AS held
  FROM (SELECT DISTINCT model FROM m) d, l)
SELECT model, bool_and(held) AS passed, coalesce(list(metric ORDER BY place) FILTER (WHERE NOT held), CAST([] AS VARCHAR[])) AS failed FROM c GROUP BY 1""",
)
def reliability_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    value = F.when(k % 5 == 0, 0.0).otherwise(F.lit(0.7) + (k % 30) / 100)
    metrics = inputs.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("model"),
        F.element_at(F.array(*[F.lit(x) for x in _LIMIT_NAMES]), (k % len(_LIMIT_NAMES) + 1).cast("int")).alias("metric"),
        F.when(k % 17 != 0, value).alias("value"),
    )
    return gates.reliability_gate(metrics)


@query(
    "tradability_verdict",
    """WITH e AS (SELECT o_orderkey AS k, o_orderkey % 3 <> 0 AS formal, CASE WHEN o_orderkey % 7 <> 0 THEN 'c' || (o_orderkey % 2) END AS cal, CASE WHEN o_orderkey % 11 <> 0 THEN 'c' || (o_orderkey % 4) END AS want,
  o_orderkey % 13 <> 0 AS flags, o_orderkey % 17 <> 0 AS amounts, CASE WHEN o_orderkey % 5 <> 0 THEN CASE WHEN o_orderkey % 19 = 0 THEN 'other' ELSE o_orderpriority END END AS rid,
  CASE WHEN o_orderkey % 5 <> 0 THEN CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE 'h' END END AS rh, o_orderpriority AS snap, o_totalprice < 100000 AS low, o_orderkey % 29 = 0 AS odd, o_orderstatus = 'O' AS capped FROM orders),
m AS (SELECT *, list_filter([CASE WHEN cal IS NULL THEN 'EXECUTION_COST_CALIBRATION_MISSING' END, CASE WHEN formal AND want IS NULL THEN 'EXPECTED_EXECUTION_COST_CALIBRATION_MISSING' END,
  CASE WHEN want IS NOT NULL AND cal IS DISTINCT FROM want THEN 'EXECUTION_COST_CALIBRATION_MISMATCH' END, CASE WHEN NOT flags THEN 'TRADABILITY_FLAGS_MISSING' END, CASE WHEN NOT amounts THEN 'VOLUME_OR_AMOUNT_MISSING' END,
  CASE WHEN formal AND rid IS NULL THEN 'MARKET_SNAPSHOT_REF_MISSING' END, CASE WHEN formal AND rid IS NOT NULL AND (rid <> snap OR rh = '') THEN 'MARKET_SNAPSHOT_MISMATCH' END], lambda x: x IS NOT NULL) AS missing,
  list_filter([CASE WHEN capped THEN 'CAPACITY_FAILED' END, CASE WHEN odd THEN 'NONFINITE_METRIC' END, CASE WHEN low THEN 'NET_RETURN_BELOW_POLICY_MINIMUM' END], lambda x: x IS NOT NULL) AS other FROM e)
SELECT k AS factor_id, list_concat(missing, other) AS reasons, formal AND len(missing) = 0 AS formal_eligible, formal AND len(missing) = 0 AND len(other) = 0 AS passed,
 CASE WHEN formal THEN 'FORMAL_RESEARCH' ELSE 'EXPLORATORY_REPORT' END AS metric_scope, NOT formal AS report_only FROM m""",
)
def tradability_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, k = inputs.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    limits = [(F.col("o_orderstatus") == "O", "CAPACITY_FAILED"), (F.col("o_totalprice") < 100000, "NET_RETURN_BELOW_POLICY_MINIMUM")]
    assessed = orders.select(
        k.alias("factor_id"),
        F.when(k % 29 != 0, 0.001).alias("gross_return"),
        F.lit(0.001).alias("net_return"),
        F.array_compact(F.array(*[F.when(rule, F.lit(name)) for rule, name in limits])).alias("reasons"),
    )
    evidence = orders.select(
        k.alias("factor_id"),
        (k % 3 != 0).alias("formal"),
        F.when(k % 7 != 0, F.concat(F.lit("c"), (k % 2).cast("string"))).alias("calibration"),
        F.when(k % 11 != 0, F.concat(F.lit("c"), (k % 4).cast("string"))).alias("expected_calibration"),
        (k % 13 != 0).alias("has_tradable"),
        (k % 17 != 0).alias("has_amount"),
        F.col("o_orderpriority").alias("market_snapshot_id"),
        F.when(k % 5 != 0, F.when(k % 19 == 0, "other").otherwise(F.col("o_orderpriority"))).alias("ref_snapshot_id"),
        F.when(k % 5 != 0, F.when(k % 23 == 0, "").otherwise("h")).alias("ref_hash"),
        F.when(k % 5 != 0, tradability.SNAPSHOT_CONTRACT).alias("contract"),
    )
    return tradability.verdict(assessed, evidence)
