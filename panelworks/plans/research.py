"""Seed evaluation, walk-forward, diagnostics, neutralisation, stability, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelworks.operators import costs, diagnostics, neutralize, splits, stability, testing
from panelworks.operators import evaluate as ev
from panelworks.operators import formulas as fm
from panelworks.operators import grid
from panelworks.operators.seeds import seed_formulas
from panelworks.plans import inputs
from panelworks.plans.factors import (
    EVALUATED_COLUMNS,
    FLAGSHIP_SQL,
    FULL_RANGE,
    PAIRS_SQL,
    compared_evaluation,
    evaluation_sql,
    flagship_values,
)
from panelworks.plans.formula_sql import erfc_sql, formula_ctes
from panelworks.plans.inputs import HORIZON, with_bars
from panelworks.plans.registry import query, rounded
from panelworks.session import stored

# --- all seeds in one pass -------------------------------------------------------------------


def seed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = inputs.panel(spark, sf_dir, turnover=True)
    return fm.factor_values(panel, seed_formulas(), inputs.universe(sf_dir)[0], keep=("fwd",))


@query(
    "seed_evaluation",
    with_bars(
        formula_ctes(seed_formulas())
        + evaluation_sql(FULL_RANGE)
        + "SELECT factor_id, evaluated_days, valid_ic_days, round(rank_ic, 4) + 0.0 AS rank_ic, round(icir, 3) + 0.0 AS icir,"
        " round(topk_return, 3) + 0.0 AS topk_return, passed FROM evaluated"
    ),
)
def seed_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols, n_days = inputs.universe(sf_dir)
    ranges = [ev.full_range(n_days, HORIZON)]
    bars = stored(inputs.bars_with_turnover(spark, sf_dir))
    panel = grid.market_panel(bars).withColumn("fwd", grid.forward_return(HORIZON))

    def evaluated(formulas) -> DataFrame:
        values = fm.factor_values(panel, formulas, symbols, keep=("fwd",))
        return ev.evaluate_ranges(values, ranges, HORIZON, ev.default_top_k(symbols), symbols)

    result = ev.in_batches(seed_formulas(), symbols * n_days, evaluated)
    columns = ["factor_id", "evaluated_days", "valid_ic_days", "rank_ic", "icir", "topk_return", "passed"]
    return rounded(result.select(*columns), 3, rank_ic=4)


@query(
    "seed_factor_panel",
    with_bars(
        formula_ctes(seed_formulas())
        + "SELECT factor_id, d, count(*) AS n, round(avg(raw), 4) + 0.0 AS raw_mean FROM fv"
        " WHERE factor_id NOT LIKE '%amount_delta%' AND factor_id NOT LIKE 'price_volume_cov%' GROUP BY 1, 2"
    ),
)
def seed_factor_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {k: v for k, v in seed_formulas().items() if k not in ("amount_delta_5d", "price_volume_cov_10d")}
    panel = inputs.panel(spark, sf_dir, None, turnover=True)
    values = fm.factor_values(panel, wanted, inputs.universe(sf_dir)[0], by_day=False)
    daily = values.groupBy("factor_id", "d").agg(F.count(F.lit(1)).alias("n"), F.avg("sort_value").alias("raw_mean"))
    return rounded(daily, 4)


# --- ranges ------------------------------------------------------------------------------------

_SPLIT = splits.ResearchDays()


@query(
    "research_split",
    with_bars(
        f"""SELECT n_days, e AS final_oos_end, e - 100 AS final_oos_start, e - 100 AS discovery_end, e - 350 AS discovery_start,
 greatest(e - 480, 0) AS warmup_start, 250 AS discovery_days, 100 AS final_oos_days,
 least(n_days, e + {HORIZON}) AS future_return_end, greatest(e, 0) AS latest_evaluable_day
 FROM (SELECT CAST(count(*) AS INTEGER) AS n_days, CAST(count(*) AS INTEGER) - {HORIZON} AS e FROM calendar)
 WHERE e > 0 AND e - 350 > greatest(e - 480, 0)"""
    ),
)
def research_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.research_split(grid.calendar(inputs.bars(spark, sf_dir)), HORIZON, _SPLIT)


@query(
    "purged_windows",
    with_bars(
        f"""SELECT s AS train_start, s + step AS train_end, s + step + {HORIZON} AS validation_start, s + step + {2 * HORIZON} AS validation_end,
 s + step + {3 * HORIZON} AS test_start, least(s + step + {4 * HORIZON}, n - {HORIZON}) AS test_end
 FROM (SELECT n, step, CAST(unnest(range(0, n - {4 * HORIZON + 2} + 1, step)) AS INTEGER) AS s FROM
  (SELECT n, greatest(1, (n - {4 * HORIZON + 2}) // 3) AS step FROM (SELECT CAST(count(*) AS INTEGER) AS n FROM calendar)))
 WHERE least(s + step + {4 * HORIZON}, n - {HORIZON}) - (s + step + {3 * HORIZON}) >= {HORIZON} ORDER BY s LIMIT 3"""
    ),
)
def purged_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.purged_windows(grid.calendar(inputs.bars(spark, sf_dir)), HORIZON)


@query(
    "history_check",
    with_bars("SELECT symbol, count(*) AS n_rows, 500 AS required_days, count(*) >= 500 AS sufficient FROM bars GROUP BY symbol"),
)
def history_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.history_check(inputs.bars(spark, sf_dir), HORIZON)


_WINDOW_RANGES = f"""
 SELECT 'w' || i AS range_name, start AS day_from, stop AS day_to, stop - {HORIZON} AS fwd_to FROM (
  SELECT i, i * (u // 3 + {5}) + least(i, u % 3) AS start, i * (u // 3 + 5) + least(i, u % 3) + u // 3 + CASE WHEN i < u % 3 THEN 1 ELSE 0 END AS stop
  FROM (SELECT any_value(n_days) - {HORIZON} - 10 AS u FROM calendar), (SELECT unnest(range(3)) AS i))"""


def walkforward(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    symbols, n_days = inputs.universe(sf_dir)
    return splits.walkforward(
        flagship_values(spark, sf_dir), n_days, HORIZON, ev.default_top_k(symbols), symbols
    )


@query("walkforward_windows", with_bars(FLAGSHIP_SQL + evaluation_sql(_WINDOW_RANGES) + f"SELECT {EVALUATED_COLUMNS} FROM evaluated"))
def walkforward_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared_evaluation(walkforward(spark, sf_dir)[0])


@query(
    "walkforward_verdict",
    with_bars(
        FLAGSHIP_SQL
        + evaluation_sql(_WINDOW_RANGES)
        + """, v AS (SELECT factor_id, avg(rank_ic) AS mean_rank_ic, min(rank_ic) AS min_rank_ic, avg(CAST(passed AS DOUBLE)) AS window_pass_ratio,
 avg(CASE WHEN rank_ic > 0 THEN 1.0 ELSE 0.0 END) AS positive_window_ratio, avg(coalesce(excess_return, 0)) AS oos_excess_return
 FROM evaluated GROUP BY 1)
SELECT factor_id, round(mean_rank_ic, 5) + 0.0 AS mean_rank_ic, round(min_rank_ic, 5) + 0.0 AS min_rank_ic,
 round(window_pass_ratio, 5) AS window_pass_ratio, round(positive_window_ratio, 5) AS positive_window_ratio,
 round(oos_excess_return, 5) + 0.0 AS oos_excess_return,
 window_pass_ratio >= 0.6 AND positive_window_ratio >= 0.6 AND oos_excess_return > 0 AND min_rank_ic > -0.02 AS passed FROM v"""
    ),
)
def walkforward_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(walkforward(spark, sf_dir)[1], 5)


# --- diagnostics -------------------------------------------------------------------------------

_SMALL_BATCH = {
    name: seed_formulas()[name] for name in ("reversal_10d", "vwap_deviation", "volume_surge_5_20", "close_breakout_20d")
}
_BATCH_SQL = formula_ctes(_SMALL_BATCH, keep="n_days, fwd, close, volume")


def batch_values(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ("fwd",), extra=None) -> DataFrame:
    panel = inputs.panel(spark, sf_dir).withColumns(extra or {})
    return fm.factor_values(panel, _SMALL_BATCH, inputs.universe(sf_dir)[0], keep=keep)


@query(
    "factor_autocorrelation",
    with_bars(
        _BATCH_SQL
        + """, j AS (SELECT a.factor_id, a.d, a.value AS v, b.value AS w FROM fv a JOIN fv b
  ON a.factor_id = b.factor_id AND a.symbol = b.symbol AND b.d = a.d - 1),
c AS (SELECT factor_id, d, count(*) AS n, stddev_pop(v) AS sv, stddev_pop(w) AS sw, covar_pop(v, w) AS c FROM j GROUP BY 1, 2)
SELECT factor_id, round(avg(c / (sv * sw)), 6) AS autocorrelation FROM c WHERE n >= 3 AND sv > 1e-12 AND sw > 1e-12 GROUP BY 1"""
    ),
)
def factor_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.autocorrelation(batch_values(spark, sf_dir, keep=())))


@query(
    "ic_decay",
    with_bars(
        _BATCH_SQL
        + """, h AS (SELECT unnest(range(1, 6)) AS horizon),
j AS (SELECT f.factor_id, f.d, h.horizon, f.value AS v, p.close / nullif(f.close, 0) - 1 AS r FROM fv f CROSS JOIN h
  JOIN panel p ON p.symbol = f.symbol AND p.d = f.d + h.horizon WHERE p.close IS NOT NULL AND f.close IS NOT NULL),
c AS (SELECT factor_id, horizon, d, count(*) AS n, stddev_pop(v) AS sv, stddev_pop(r) AS sr, covar_pop(v, r) AS c FROM j GROUP BY 1, 2, 3)
SELECT factor_id, CAST(horizon AS INTEGER) AS horizon, round(avg(c / (sv * sr)), 6) AS ic FROM c
WHERE n >= 3 AND sv > 1e-12 AND sr > 1e-12 GROUP BY 1, 2"""
    ),
)
def ic_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    ahead = diagnostics.forward_columns(5)
    values = batch_values(spark, sf_dir, keep=tuple(ahead), extra=ahead)
    return rounded(diagnostics.ic_decay(values, 5))


_TURNOVER_SQL = """, r AS (SELECT factor_id, symbol, d, row_number() OVER (PARTITION BY factor_id, d ORDER BY value DESC, symbol DESC) AS k FROM fv),
m AS (SELECT factor_id, symbol, d FROM r WHERE k <= 5),
dd AS (SELECT factor_id, d, lag(d) OVER (PARTITION BY factor_id ORDER BY d) AS p FROM (SELECT DISTINCT factor_id, d FROM m)),
s AS (SELECT m.factor_id, m.d, count(*) FILTER (WHERE q.symbol IS NULL) / CAST(count(*) AS DOUBLE) AS share
  FROM m JOIN dd ON dd.factor_id = m.factor_id AND dd.d = m.d AND dd.p IS NOT NULL
  LEFT JOIN m q ON q.factor_id = m.factor_id AND q.symbol = m.symbol AND q.d = dd.p GROUP BY 1, 2)
"""


@query(
    "topk_turnover",
    with_bars(_BATCH_SQL + _TURNOVER_SQL + "SELECT factor_id, round(avg(share), 6) AS turnover FROM s GROUP BY 1"),
)
def topk_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.topk_turnover(batch_values(spark, sf_dir, keep=()), 5, inputs.universe(sf_dir)[0]))


@query(
    "topk_per_day",
    with_bars(
        _BATCH_SQL
        + "SELECT factor_id, d, symbol, k FROM (SELECT factor_id, d, symbol, row_number() OVER (PARTITION BY factor_id, d"
        " ORDER BY value DESC, symbol DESC) AS k FROM fv) WHERE k <= 5"
    ),
)
def topk_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = batch_values(spark, sf_dir, keep=())
    best = Window.partitionBy("factor_id", "d").orderBy(F.desc("value"), F.desc("symbol"))
    top = values.withColumn("k", F.row_number().over(best).cast("long")).where(F.col("k") <= 5)
    return top.select("factor_id", "d", "symbol", "k")


@query(
    "capacity_proxy",
    with_bars(
        "SELECT round(sum(volume) FILTER (WHERE volume > 0) / (max(d) + 1) * 0.1, 4) AS daily_notional_capacity_proxy,"
        " CAST(0.1 AS DOUBLE) AS participation_rate,"
        " round(max(amount) FILTER (WHERE amount > 0) / sum(amount) FILTER (WHERE amount > 0), 9) AS max_weight_concentration FROM panel"
    ),
)
def capacity_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = diagnostics.capacity_proxy(inputs.panel(spark, sf_dir, None), weight="amount")
    return rounded(result, 4, max_weight_concentration=9)


def latest_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factor values of the last day with size, liquidity and industry."""
    last = inputs.universe(sf_dir)[1] - 1
    values = batch_values(spark, sf_dir, keep=("volume",)).where(F.col("d") == last)
    facts = inputs.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("symbol"),
        F.col("s_nationkey").alias("industry"),
        (F.col("s_acctbal") + 1001).alias("market_cap"),
    )
    return values.withColumnRenamed("volume", "liquidity").join(facts, "symbol", "left")


_LATEST_SQL = """, latest AS (SELECT f.factor_id, f.symbol, f.value, f.volume AS liquidity, s.s_nationkey AS industry, s.s_acctbal + 1001 AS market_cap
  FROM fv f LEFT JOIN supplier s ON s.s_suppkey = f.symbol WHERE f.d = f.n_days - 1)
"""


@query(
    "factor_exposures",
    with_bars(
        _BATCH_SQL
        + _LATEST_SQL
        + """, a AS (SELECT factor_id, count(*) FILTER (WHERE liquidity IS NOT NULL) AS nl,
  stddev_pop(value) FILTER (WHERE liquidity IS NOT NULL) AS sv, stddev_pop(liquidity) AS sl, covar_pop(value, liquidity) AS cl,
  count(*) AS n, stddev_pop(value) AS s2, stddev_pop(ln(market_cap)) AS sm, covar_pop(value, ln(market_cap)) AS cm FROM latest GROUP BY 1)
SELECT factor_id, round(CASE WHEN n >= 3 AND s2 > 1e-12 AND sm > 1e-12 THEN cm / (s2 * sm) END, 6) AS size_exposure,
 round(CASE WHEN nl >= 3 AND sv > 1e-12 AND sl > 1e-12 THEN cl / (sv * sl) END, 6) AS liquidity_exposure FROM a"""
    ),
)
def factor_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.exposures(latest_values(spark, sf_dir)))


@query(
    "industry_exposures",
    with_bars(
        _BATCH_SQL
        + _LATEST_SQL
        + """, names AS (SELECT DISTINCT s_nationkey AS name FROM supplier),
x AS (SELECT l.factor_id, names.name AS industry, l.value, CASE WHEN l.industry = names.name THEN 1.0 ELSE 0.0 END AS flag FROM latest l CROSS JOIN names),
a AS (SELECT factor_id, industry, count(*) AS n, stddev_pop(value) AS sv, stddev_pop(flag) AS sf, covar_pop(value, flag) AS c FROM x GROUP BY 1, 2)
SELECT factor_id, industry, round(CASE WHEN n >= 3 AND sv > 1e-12 AND sf > 1e-12 THEN c / (sv * sf) END, 6) + 0.0 AS exposure FROM a"""
    ),
)
def industry_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    industries = inputs.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("industry"))
    return rounded(diagnostics.industry_exposures(latest_values(spark, sf_dir), industries))


@query(
    "diagnostics_bundle",
    with_bars(
        _BATCH_SQL
        + _TURNOVER_SQL
        + """, ja AS (SELECT a.factor_id, a.d, a.value AS v, b.value AS w FROM fv a JOIN fv b ON a.factor_id = b.factor_id AND a.symbol = b.symbol AND b.d = a.d - 1),
ca AS (SELECT factor_id, d, count(*) AS n, stddev_pop(v) AS sv, stddev_pop(w) AS sw, covar_pop(v, w) AS c FROM ja GROUP BY 1, 2),
au AS (SELECT factor_id, avg(c / (sv * sw)) AS a FROM ca WHERE n >= 3 AND sv > 1e-12 AND sw > 1e-12 GROUP BY 1),
jh AS (SELECT f.factor_id, f.d, h.horizon, f.value AS v, p.close / nullif(f.close, 0) - 1 AS r FROM fv f CROSS JOIN (SELECT unnest([1, 5]) AS horizon) h
  JOIN panel p ON p.symbol = f.symbol AND p.d = f.d + h.horizon WHERE p.close IS NOT NULL AND f.close IS NOT NULL),
ch AS (SELECT factor_id, horizon, d, count(*) AS n, stddev_pop(v) AS sv, stddev_pop(r) AS sr, covar_pop(v, r) AS c FROM jh GROUP BY 1, 2, 3),
dc AS (SELECT factor_id, avg(c / (sv * sr)) FILTER (WHERE horizon = 1) AS d1, avg(c / (sv * sr)) FILTER (WHERE horizon = 5) AS d5 FROM ch WHERE n >= 3 AND sv > 1e-12 AND sr > 1e-12 GROUP BY 1),
tu AS (SELECT factor_id, avg(share) AS t FROM s GROUP BY 1)
SELECT factor_id, round(a, 6) + 0.0 AS autocorrelation, round(t, 6) AS turnover, round(d1, 6) + 0.0 AS ic_decay_1, round(d5, 6) + 0.0 AS ic_decay_5
FROM au JOIN tu USING (factor_id) JOIN dc USING (factor_id)"""
    ),
)
def diagnostics_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    ahead = diagnostics.forward_columns(5)
    values = batch_values(spark, sf_dir, keep=tuple(ahead), extra=ahead)
    bundle = diagnostics.diagnostics_bundle(values, 5, 5, inputs.universe(sf_dir)[0])
    return rounded(bundle.select("factor_id", "autocorrelation", "turnover", "ic_decay_1", "ic_decay_5"))


_RECENT = f"""SELECT 'recent' AS range_name, e - greatest(20, {4 * HORIZON}) AS day_from, e - {HORIZON} AS day_to, e - {2 * HORIZON} AS fwd_to
 FROM (SELECT any_value(n_days) - {HORIZON} - 100 AS e FROM calendar)"""


@query(
    "recent_alpha",
    with_bars(
        FLAGSHIP_SQL
        + evaluation_sql(_RECENT)
        + "SELECT factor_id, round(rank_ic, 5) + 0.0 AS recent_rank_ic, round(icir, 5) + 0.0 AS recent_icir,"
        " round(excess_return, 5) + 0.0 AS recent_topk_excess, round(coverage, 5) AS recent_coverage, passed AND rank_ic > 0 AS passed FROM evaluated"
    ),
)
def recent_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last days of the discovery range; nothing after it is read."""
    symbols, n_days = inputs.universe(sf_dir)
    end = n_days - HORIZON - _SPLIT.final_oos
    recent = ev.DayRange("recent", end - max(20, 4 * HORIZON), end - HORIZON, end)
    result = ev.evaluate_ranges(flagship_values(spark, sf_dir), [recent], HORIZON, ev.default_top_k(symbols), symbols)
    return rounded(
        result.select(
            "factor_id",
            F.col("rank_ic").alias("recent_rank_ic"),
            F.col("icir").alias("recent_icir"),
            F.col("excess_return").alias("recent_topk_excess"),
            F.col("coverage").alias("recent_coverage"),
            (F.col("passed") & (F.col("rank_ic") > 0)).alias("passed"),
        ),
        5,
    )


# --- neutralisation ----------------------------------------------------------------------------


def exposed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = inputs.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("symbol"),
        F.col("s_nationkey").alias("industry"),
        F.ln(F.col("s_acctbal") + 1001).alias("size"),
    )
    values = batch_values(spark, sf_dir, keep=("fwd", "volume"))
    return values.join(facts, "symbol", "left").withColumnRenamed("volume", "liquidity")


_EXPOSED_SQL = """, ex AS (SELECT f.factor_id, f.symbol, f.d, f.n_days, f.fwd, f.value, s.s_nationkey AS industry, ln(s.s_acctbal + 1001) AS size, f.volume AS liquidity
  FROM fv f LEFT JOIN supplier s ON s.s_suppkey = f.symbol),
ms AS (SELECT factor_id, d, count(*) AS n, avg(value) AS my, avg(size) AS mx, covar_pop(size, value) * count(*) AS sxy, var_pop(size) * count(*) AS sxx
  FROM ex WHERE size IS NOT NULL GROUP BY 1, 2),
one AS (SELECT ex.factor_id, ex.symbol, ex.d, ex.n_days, ex.fwd, CASE WHEN n < 3 THEN value ELSE value - sxy / (sxx + 1e-10) * (size - mx) END AS value
  FROM ex LEFT JOIN ms USING (factor_id, d))
"""


@query(
    "neutralize_size",
    with_bars(_BATCH_SQL + _EXPOSED_SQL + "SELECT factor_id, symbol, d, round(value, 6) + 0.0 AS value FROM one"),
)
def neutralize_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = neutralize.neutralize(exposed_values(spark, sf_dir), ["size"])
    return rounded(values.select("factor_id", "symbol", "d", "value"))


@query(
    "neutralize_two_exposures",
    with_bars(
        _BATCH_SQL
        + _EXPOSED_SQL
        + """, c AS (SELECT *, liquidity IS NOT NULL AND size IS NOT NULL AS ok FROM ex),
g AS (SELECT factor_id, d, count(*) AS n, avg(size) AS m1, avg(liquidity) AS m2,
  var_pop(size) * count(*) + 1e-10 AS s11, var_pop(liquidity) * count(*) + 1e-10 AS s22, covar_pop(size, liquidity) * count(*) AS s12,
  covar_pop(size, value) * count(*) AS s1y, covar_pop(liquidity, value) * count(*) AS s2y FROM c WHERE ok GROUP BY 1, 2),
b AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM g WHERE n >= 4)
SELECT c.factor_id, c.symbol, c.d, round(CASE WHEN b.n IS NULL THEN value WHEN ok THEN value - b1 * (size - m1) - b2 * (liquidity - m2) END, 6) + 0.0 AS value
FROM c LEFT JOIN b USING (factor_id, d)"""
    ),
)
def neutralize_two_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = neutralize.neutralize(exposed_values(spark, sf_dir), ["size", "liquidity"])
    return rounded(values.select("factor_id", "symbol", "d", "value"))


@query(
    "neutralize_industry",
    with_bars(
        _BATCH_SQL
        + _EXPOSED_SQL
        + "SELECT factor_id, symbol, d, round(value - avg(value) OVER (PARTITION BY factor_id, d, industry)"
        " + avg(value) OVER (PARTITION BY factor_id, d), 6) + 0.0 AS value"
        " FROM (SELECT f.factor_id, f.symbol, f.d, f.raw AS value, s.s_nationkey AS industry FROM fv f"
        " LEFT JOIN supplier s ON s.s_suppkey = f.symbol)"
    ),
)
def neutralize_industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = exposed_values(spark, sf_dir).withColumn("value", F.col("sort_value"))
    values = neutralize.neutralize_by_group(raw, "industry")
    return rounded(values.select("factor_id", "symbol", "d", "value"))


def _spearman_sql(source: str, out: str) -> str:
    return f"""{out} AS (SELECT factor_id, d, 1 - 6 * sum(CAST((a - b) * (a - b) AS DOUBLE)) / (count(*) * (CAST(count(*) AS DOUBLE) * count(*) - 1)) AS ic
  FROM (SELECT factor_id, d, value, fwd, row_number() OVER (PARTITION BY factor_id, d ORDER BY value, symbol) AS a,
               row_number() OVER (PARTITION BY factor_id, d ORDER BY fwd, symbol) AS b FROM {source} WHERE fwd IS NOT NULL AND value IS NOT NULL)
  GROUP BY 1, 2 HAVING count(*) >= 10 AND stddev_pop(value) >= 1e-12 AND stddev_pop(fwd) >= 1e-12)"""


@query(
    "neutralized_ic",
    with_bars(
        _BATCH_SQL
        + _EXPOSED_SQL
        + f", {_spearman_sql('fv', 'r')}, {_spearman_sql('one', 'k')}"
        + """, t AS (SELECT factor_id, avg(r.ic) AS raw_ic, avg(k.ic) AS neutralized_ic, count(*) AS evaluated_days FROM r JOIN k USING (factor_id, d) GROUP BY 1)
SELECT factor_id, round(raw_ic, 4) + 0.0 AS raw_ic, round(neutralized_ic, 4) + 0.0 AS neutralized_ic, evaluated_days FROM t"""
    ),
)
def neutralized_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = inputs.universe(sf_dir)[0]
    values = exposed_values(spark, sf_dir).drop("sort_value")
    report = neutralize.neutralized_ic_report(values, neutralize.neutralize(values, ["size"]), symbols)
    return rounded(report.drop("ic_retained_ratio"), 4)


# --- stability and costs -------------------------------------------------------------------------


def flagship_ics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = ev.ranked_pairs(flagship_values(spark, sf_dir), inputs.universe(sf_dir)[0])
    return ev.daily_ic(pairs).where(F.col("rank_ic").isNotNull()).select("factor_id", "d", "rank_ic")


def market_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal-weight mean return per day, scaled down to the size of index moves."""
    panel = inputs.panel(spark, sf_dir, None)
    daily = panel.groupBy("d").agg((F.avg("ret") / 50).alias("market_return"))
    return daily.where(F.col("market_return").isNotNull())


_REGIME_SQL = """, mk AS (SELECT d, avg(ret) / 50 AS r FROM panel GROUP BY d HAVING avg(ret) IS NOT NULL),
mw AS (SELECT d, avg(r) OVER w AS m, stddev_pop(r) OVER w AS s FROM mk WINDOW w AS (ORDER BY d ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
rg AS (SELECT d, CASE WHEN s > 0.03 THEN 'high_vol' WHEN s < 0.012 THEN 'low_vol' WHEN m > 0.0008 THEN 'bull' WHEN m < -0.0008 THEN 'bear' ELSE 'range' END AS regime FROM mw)
"""
_IC_SUMMARY = "round(avg(rank_ic), 6) + 0.0 AS ic_mean, round(CASE WHEN stddev_pop(rank_ic) > 1e-12 THEN avg(rank_ic) / stddev_pop(rank_ic) ELSE 0.0 END, 5) + 0.0 AS icir, count(*) AS days"


@query("market_regimes", with_bars(_REGIME_SQL + "SELECT d, regime FROM rg"))
def market_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stability.classify_regimes(market_returns(spark, sf_dir)).select("d", "regime")


@query(
    "stability_subperiods",
    with_bars(
        FLAGSHIP_SQL
        + PAIRS_SQL
        + f"SELECT factor_id, subperiod, {_IC_SUMMARY} FROM (SELECT *, CAST(ntile(4) OVER (PARTITION BY factor_id ORDER BY d) - 1 AS INTEGER) AS subperiod FROM ics) GROUP BY 1, 2"
    ),
)
def stability_subperiods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stability.subperiods(flagship_ics(spark, sf_dir)), 6, icir=5)


_BY_REGIME = """, pn AS (SELECT factor_id, rank_ic, row_number() OVER (PARTITION BY factor_id ORDER BY d) AS k FROM ics),
rn AS (SELECT regime, row_number() OVER (ORDER BY d) AS k FROM rg)
"""


@query(
    "stability_regimes",
    with_bars(
        FLAGSHIP_SQL
        + PAIRS_SQL
        + _REGIME_SQL
        + _BY_REGIME
        + f"SELECT factor_id, regime, {_IC_SUMMARY} FROM pn JOIN rn USING (k) GROUP BY 1, 2"
    ),
)
def stability_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    regimes = stability.classify_regimes(market_returns(spark, sf_dir))
    return rounded(stability.regime_summary(flagship_ics(spark, sf_dir), regimes), 6, icir=5)


@query(
    "stability_report",
    with_bars(
        FLAGSHIP_SQL
        + PAIRS_SQL
        + _REGIME_SQL
        + _BY_REGIME
        + """, w AS (SELECT factor_id, min(m) AS worst FROM (SELECT factor_id, regime, avg(rank_ic) AS m FROM pn JOIN rn USING (k) GROUP BY 1, 2) GROUP BY 1),
l AS (SELECT factor_id, rank_ic, lead(rank_ic) OVER (PARTITION BY factor_id ORDER BY d) AS nx, avg(rank_ic) OVER (PARTITION BY factor_id) AS m FROM ics)
SELECT l.factor_id, count(*) AS ic_days, round(avg(CASE WHEN sign(rank_ic) = sign(m) THEN 1.0 ELSE 0.0 END), 6) AS ic_sign_consistency,
 round(covar_pop(rank_ic, nx) / (stddev_pop(rank_ic) FILTER (WHERE nx IS NOT NULL) * stddev_pop(nx)), 6) + 0.0 AS rank_stability,
 round(any_value(worst), 6) + 0.0 AS worst_regime_ic FROM l JOIN w USING (factor_id) GROUP BY 1"""
    ),
)
def stability_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    regimes = stability.classify_regimes(market_returns(spark, sf_dir))
    return rounded(stability.stability_report(flagship_ics(spark, sf_dir), regimes))


@query(
    "cost_sensitivity",
    with_bars(
        FLAGSHIP_SQL
        + evaluation_sql(FULL_RANGE)
        + f""", b AS (SELECT range_name, factor_id, coalesce(avg(turnover) FILTER (WHERE period > 0), 1.0) AS t, avg(top_return) * 250 / {HORIZON} AS base
  FROM periods GROUP BY 1, 2)
SELECT range_name, factor_id, round(t, 6) AS turnover_proxy, round(base - 5 / 10000.0 * t * 250 / {HORIZON}, 5) AS return_after_5bps,
 round(base - 10 / 10000.0 * t * 250 / {HORIZON}, 5) AS return_after_10bps, round(base - 20 / 10000.0 * t * 250 / {HORIZON}, 5) AS return_after_20bps,
 round(base - 50 / 10000.0 * t * 250 / {HORIZON}, 5) AS return_after_50bps,
 round(CASE WHEN base <= 0 THEN 0.0 WHEN t = 0 THEN 500.0 ELSE least(500.0, base * {HORIZON} * 10000 / (250 * t)) END, 4) AS break_even_cost_bps FROM b"""
    ),
)
def cost_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols, n_days = inputs.universe(sf_dir)
    top_k = ev.default_top_k(symbols)
    pairs = ev.ranked_pairs(flagship_values(spark, sf_dir), symbols)
    series = ev.range_series(ev.daily_ic(pairs, top_k=top_k), [ev.full_range(n_days, HORIZON)], HORIZON)
    report = costs.cost_sensitivity(ev.selection_periods(pairs, series, top_k), HORIZON)
    return rounded(report, 5, turnover_proxy=6, break_even_cost_bps=4)


# --- statistics ------------------------------------------------------------------------------------


def excess_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol as one trial: its return over the day's mean, long."""
    panel = inputs.panel(spark, sf_dir, None)
    days = panel.groupBy("d").agg(F.avg("ret").alias("_mean"))
    joined = panel.join(F.broadcast(days), "d")  # one row per day
    return joined.select(
        F.col("symbol").alias("trial_id"), F.col("d").alias("period"), (F.col("ret") - F.col("_mean")).alias("value")
    )


_TRIALS_SQL = """, trials AS (SELECT symbol AS trial_id, d AS period, ret - avg(ret) OVER (PARTITION BY d) AS value FROM panel)
"""
_TESTS_SQL = (
    _TRIALS_SQL
    + f""", zs AS (SELECT trial_id, abs(avg(value)) * sqrt(count(value)) / greatest(stddev_samp(value), 1e-12) / sqrt(2) AS z FROM trials GROUP BY 1 HAVING count(value) >= 2),
tests AS (SELECT trial_id AS test_id, {erfc_sql('z')} AS p FROM zs),
rk AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, test_id) AS i FROM tests),
adj AS (SELECT test_id, p AS p_value, least(p * m, 1) AS bonferroni, max(least(p * (m - i + 1), 1)) OVER (ORDER BY i) AS holm,
  least(min(p * m / i) OVER (ORDER BY i DESC), 1) AS benjamini_hochberg FROM rk)
"""
)


def symbol_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelworks.functions.scalar import erfc

    dev = F.greatest(F.stddev_samp("value"), F.lit(1e-12))
    z = F.abs(F.avg("value")) * F.sqrt(F.count("value")) / dev / F.sqrt(F.lit(2.0))
    scored = excess_returns(spark, sf_dir).groupBy("trial_id").agg(F.count("value").alias("n"), z.alias("z"))
    return scored.where(F.col("n") >= 2).select(
        F.lit("all").alias("family"), F.col("trial_id").alias("test_id"), erfc(F.col("z")).alias("p_value")
    )


@query(
    "multiple_testing",
    with_bars(
        _TESTS_SQL
        + """SELECT 'all' AS family, test_id, round(p_value, 6) AS p_value, round(bonferroni, 6) AS bonferroni, round(holm, 6) AS holm,
 round(benjamini_hochberg, 6) AS benjamini_hochberg, bonferroni <= 0.05 AS bonferroni_rejected, holm <= 0.05 AS holm_rejected,
 benjamini_hochberg <= 0.05 AS benjamini_hochberg_rejected FROM adj"""
    ),
)
def multiple_testing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(testing.correct_p_values(symbol_tests(spark, sf_dir), inputs.universe(sf_dir)[0]))


@query(
    "testing_family",
    with_bars(
        _TESTS_SQL
        + """SELECT 'all' AS family, count(*) AS p_value_count, count(*) AS effective_trials, bool_or(bonferroni <= 0.05) AS bonferroni_pass,
 bool_or(holm <= 0.05) AS holm_pass, bool_or(benjamini_hochberg <= 0.05) AS benjamini_hochberg_pass FROM adj"""
    ),
)
def testing_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    corrected = testing.correct_p_values(symbol_tests(spark, sf_dir), inputs.universe(sf_dir)[0])
    return testing.family_report(corrected)


def _phi(z: str) -> str:
    return f"0.5 * ({erfc_sql(f'(-({z}) / sqrt(2))')})"


@query(
    "sharpe_report",
    with_bars(
        _TRIALS_SQL
        + f""", f AS (SELECT trial_id, count(value) AS n, avg(value) AS m, stddev_samp(value) AS s FROM trials GROUP BY 1),
g AS (SELECT trial_id, any_value(n) AS n, any_value(m / s) AS sh, avg(pow((value - m) / s, 3)) AS sk, avg(pow((value - m) / s, 4)) AS ku
  FROM trials JOIN f USING (trial_id) WHERE value IS NOT NULL GROUP BY 1),
v AS (SELECT *, sqrt(greatest(1e-12, 1 - sk * sh + (ku - 1) / 4 * sh * sh)) AS sd FROM g),
zz AS (SELECT *, sh * sqrt(n - 1) / sd AS z1, (sh - sqrt(2 * ln(44)) / sqrt(n)) * sqrt(n - 1) / sd AS z2 FROM v)
SELECT trial_id, round(sh, 6) + 0.0 AS observed_sharpe, round(sh * sqrt(250), 5) + 0.0 AS annualized_sharpe, round({_phi('z1')}, 6) AS psr, round({_phi('z2')}, 6) AS dsr,
 round(sk, 5) + 0.0 AS skewness, round(ku, 4) AS kurtosis, n AS sample_length FROM zz"""
    ),
)
def sharpe_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = testing.sharpe_report(excess_returns(spark, sf_dir), trials=44)
    return rounded(report, 6, annualized_sharpe=5, skewness=5, kurtosis=4)


@query(
    "overfitting_probability",
    with_bars(
        _TRIALS_SQL
        + """, cut AS (SELECT period, ntile(8) OVER (ORDER BY period) - 1 AS b FROM (SELECT DISTINCT period FROM trials)),
bs AS (SELECT trial_id, b, sum(value) AS s, count(value) AS n FROM trials JOIN cut USING (period) GROUP BY 1, 2),
ch AS (SELECT c FROM (SELECT unnest(range(1, 256)) AS c) WHERE bit_count(c) <= 4),
sc AS (SELECT trial_id, c, sum(s) FILTER (WHERE (c >> b) & 1 = 1) / sum(n) FILTER (WHERE (c >> b) & 1 = 1) AS i,
  sum(s) FILTER (WHERE (c >> b) & 1 = 0) / sum(n) FILTER (WHERE (c >> b) & 1 = 0) AS o FROM bs CROSS JOIN ch GROUP BY 1, 2),
best AS (SELECT c, arg_max(o, row(i, -trial_id)) AS o FROM sc GROUP BY 1),
rk AS (SELECT c, count(*) AS t, count(*) FILTER (WHERE sc.o <= best.o) AS r FROM sc JOIN best USING (c) GROUP BY 1)
SELECT round(avg(CASE WHEN r <= t / 2.0 THEN 1.0 ELSE 0.0 END), 8) AS pbo, max(t) AS trials, count(*) AS choices FROM rk"""
    ),
)
def overfitting_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(testing.overfitting_probability(excess_returns(spark, sf_dir)), 8)


@query(
    "overfitting_by_brand",
    """WITH m AS (SELECT p_brand AS brand, l_suppkey % 5 AS trial, date_trunc('year', l_shipdate) AS period, avg(l_extendedprice) / 1000 AS v
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand <> 'Brand#11' OR l_suppkey % 5 = 0 GROUP BY 1, 2, 3),
sz AS (SELECT brand, count(DISTINCT trial) AS trials, count(DISTINCT period) AS n FROM m GROUP BY 1),
p0 AS (SELECT brand, period, row_number() OVER (PARTITION BY brand ORDER BY period) - 1 AS i FROM (SELECT DISTINCT brand, period FROM m)),
p1 AS (SELECT p0.*, n, least(6, n) AS b FROM p0 JOIN sz USING (brand)),
p2 AS (SELECT brand, period, b, CASE WHEN i < (n % b) * (n // b + 1) THEN i // (n // b + 1) ELSE n % b + (i - (n % b) * (n // b + 1)) // (n // b) END AS k FROM p1),
bs AS (SELECT brand, trial, b, k, sum(v) AS s, count(v) AS c FROM m JOIN p2 USING (brand, period) GROUP BY 1, 2, 3, 4),
ch AS (SELECT unnest(range(1, 64)) AS ch),
sc AS (SELECT brand, trial, ch, sum(s) FILTER (WHERE (ch >> k) & 1 = 1) / sum(c) FILTER (WHERE (ch >> k) & 1 = 1) AS i, sum(s) FILTER (WHERE (ch >> k) & 1 = 0) / sum(c) FILTER (WHERE (ch >> k) & 1 = 0) AS o
  FROM bs JOIN ch ON ch < (1 << CAST(b AS INTEGER)) AND bit_count(ch) <= b // 2 GROUP BY 1, 2, 3),
best AS (SELECT brand, ch, arg_max(o, row(i, -trial)) AS bo FROM sc WHERE i IS NOT NULL GROUP BY 1, 2),
rk AS (SELECT brand, ch, count(*) AS t, count(*) FILTER (WHERE o <= bo) AS r FROM sc JOIN best USING (brand, ch) GROUP BY 1, 2),
f AS (SELECT brand, avg(CASE WHEN r <= t / 2.0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rate, count(*) AS choices FROM rk GROUP BY 1)
SELECT brand, CASE WHEN trials < 2 OR n < 4 THEN 1.0::DOUBLE ELSE round(rate, 8) END AS pbo, trials, choices FROM sz LEFT JOIN f USING (brand)""",
)
def overfitting_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One matrix per brand; one brand has a single trial, which counts as certain overfitting."""
    items = inputs.table(spark, sf_dir, "lineitem").join(
        inputs.table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand")), F.col("l_partkey") == F.col("p_partkey")
    )
    trial = F.col("l_suppkey") % 5
    matrix = (
        items.where((F.col("brand") != "Brand#11") | (trial == 0))
        .groupBy("brand", trial.alias("trial_id"), F.date_trunc("year", "l_shipdate").alias("period"))
        .agg((F.avg("l_extendedprice") / 1000).alias("value"))
    )
    return rounded(testing.overfitting_probability(matrix, partitions=6, by=["brand"]), 8)


_BOOTSTRAPPED = ("mean", "sharpe", "hit_rate", "correlation", "median")


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol's excess returns, with the day's mean return as companion."""
    panel = inputs.panel(spark, sf_dir, None)
    days = panel.groupBy("d").agg(F.avg("ret").alias("companion"))
    joined = panel.join(F.broadcast(days), "d")  # one row per day
    excess = (F.col("ret") - F.col("companion")).alias("value")
    return joined.select(F.col("symbol").alias("series_id"), F.col("d").alias("position"), excess, "companion")


# every resampled value is a row here, so the statistics come from plain aggregates
_VALUES_SQL = """, v AS (SELECT symbol AS id, row_number() OVER (PARTITION BY symbol ORDER BY d) - 1 AS k, ret - m AS x, m AS y
  FROM (SELECT *, avg(ret) OVER (PARTITION BY d) AS m FROM panel) WHERE ret IS NOT NULL),
sz AS (SELECT id, count(*) AS n FROM v GROUP BY 1),
its AS (SELECT unnest(range(0, 500)) AS it)"""


def _draw_sql(part: int) -> str:
    return f"CAST(CAST('0x' || substr(md5('0:' || id || ':' || it || ':' || j), {1 + 13 * part}, 13) AS BIGINT) AS DOUBLE) / 4503599627370496"


_SPREAD_SQL = """, st AS (SELECT id, it, avg(x) AS mean, CASE WHEN stddev_samp(x) > 1e-12 THEN avg(x) / stddev_samp(x) END AS sharpe,
  avg(CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS hit_rate, corr(x, y) AS correlation, median(x) AS median FROM sm GROUP BY 1, 2),
lg AS (UNPIVOT st ON mean, sharpe, hit_rate, correlation, median INTO NAME statistic VALUE e)
SELECT id AS series_id, statistic, round(max(CASE WHEN it < 0 THEN e END), 6) + 0.0 AS point_estimate,
  round(quantile_cont(CASE WHEN it >= 0 THEN e END, 0.025), 6) + 0.0 AS ci_lower, round(quantile_cont(CASE WHEN it >= 0 THEN e END, 0.975), 6) + 0.0 AS ci_upper,
  count(*) FILTER (WHERE it >= 0) AS iterations FROM lg GROUP BY 1, 2"""


@query(
    "moving_block_bootstrap",
    with_bars(
        _VALUES_SQL
        + f""", b AS (SELECT id, it, n, j, CAST(floor({_draw_sql(0)} * (n - 9)) AS BIGINT) AS s, least(10, n - j * 10) AS w
  FROM (SELECT id, it, n, unnest(range(0, CAST(ceil(n / 10.0) AS BIGINT))) AS j FROM sz, its WHERE n >= 10)),
e AS (SELECT id, it, s + unnest(range(0, w)) AS k FROM b),
sm AS (SELECT id, it, x, y FROM e JOIN v USING (id, k) UNION ALL SELECT id, -1, x, y FROM v)"""
        + _SPREAD_SQL
    ),
)
def moving_block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(testing.moving_block_bootstrap(_series(spark, sf_dir), statistics=_BOOTSTRAPPED))


@query(
    "stationary_bootstrap",
    with_bars(
        _VALUES_SQL
        + f""", b AS (SELECT id, it, n, j, CAST(floor({_draw_sql(0)} * n) AS BIGINT) AS s, CAST(floor(ln(1 - {_draw_sql(1)}) / ln(1 - 1 / 10.0::DOUBLE)) AS BIGINT) + 1 AS w
  FROM (SELECT id, it, n, unnest(range(0, n)) AS j FROM sz, its WHERE n >= 4)),
f AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY id, it ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM b),
e AS (SELECT id, it, (s + unnest(range(0, CAST(least(w, n - done) AS BIGINT)))) % n AS k FROM f WHERE done < n),
sm AS (SELECT id, it, x, y FROM e JOIN v USING (id, k) UNION ALL SELECT id, -1, x, y FROM v)"""
        + _SPREAD_SQL
    ),
)
def stationary_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(testing.stationary_bootstrap(_series(spark, sf_dir), statistics=_BOOTSTRAPPED))


@query(
    "cohort_statistics",
    with_bars(
        _BATCH_SQL
        + PAIRS_SQL
        + f""", cs AS (SELECT factor_id, rho AS v, row_number() OVER (PARTITION BY factor_id ORDER BY d DESC) AS back FROM daily WHERE n >= 10),
ln AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM cs GROUP BY factor_id)),
al AS (SELECT factor_id, n, n - back AS period, v FROM cs, ln WHERE back <= n),
sh AS (SELECT factor_id, any_value(n) AS n, avg(v) / greatest(stddev_samp(v), 1e-12) AS sharpe, abs(avg(v)) * sqrt(count(*)) / greatest(stddev_samp(v), 1e-12) / sqrt(2) AS z FROM al GROUP BY 1),
pv AS (SELECT *, {erfc_sql('z')} AS p FROM sh),
rk AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, factor_id) AS i FROM pv),
bh AS (SELECT *, least(min(p * m / i) OVER (ORDER BY i DESC), 1) AS q, (sharpe - sqrt(2 * ln(m)) / sqrt(n)) * sqrt(n - 1) / sqrt(1 + sharpe * sharpe / 2) AS zd FROM rk),
cut AS (SELECT period, ntile(8) OVER (ORDER BY period) - 1 AS b FROM (SELECT DISTINCT period FROM al)),
bs AS (SELECT factor_id, b, sum(v) AS s, count(v) AS n FROM al JOIN cut USING (period) GROUP BY 1, 2),
ch AS (SELECT c FROM (SELECT unnest(range(1, 256)) AS c) WHERE bit_count(c) <= 4),
sc AS (SELECT factor_id, c, sum(s) FILTER (WHERE (c >> b) & 1 = 1) / sum(n) FILTER (WHERE (c >> b) & 1 = 1) AS i,
  sum(s) FILTER (WHERE (c >> b) & 1 = 0) / sum(n) FILTER (WHERE (c >> b) & 1 = 0) AS o FROM bs CROSS JOIN ch GROUP BY 1, 2),
best AS (SELECT c, arg_max(o, i) AS o FROM sc GROUP BY 1),
pb AS (SELECT avg(CASE WHEN r <= t / 2.0 THEN 1.0 ELSE 0.0 END) AS pbo FROM (SELECT c, count(*) AS t, count(*) FILTER (WHERE sc.o <= best.o) AS r FROM sc JOIN best USING (c) GROUP BY 1)),
fin AS (SELECT *, {_phi('zd')} AS dsr FROM bh, pb)
SELECT factor_id AS candidate_id, round(p, 6) AS raw_p_value, round(q, 6) AS q_value, round(dsr, 6) AS deflated_sharpe, round(pbo, 6) AS pbo,
 m AS effective_trials, n AS observations, q <= 0.05 AS passed_multiple_testing, pbo <= 0.35 AS passed_pbo, q <= 0.05 AND dsr >= 0.5 AND pbo <= 0.35 AS passed,
 list_filter([CASE WHEN q > 0.05 THEN 'FDR_FAILED' END, CASE WHEN dsr < 0.5 THEN 'DEFLATED_SHARPE_FAILED' END, CASE WHEN pbo > 0.35 THEN 'PBO_FAILED' END], lambda x: x IS NOT NULL) AS reject_reasons
FROM fin"""
    ),
)
def cohort_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = ev.ranked_pairs(batch_values(spark, sf_dir), inputs.universe(sf_dir)[0])
    # one row per factor and day: bounded by the calendar
    position = F.row_number().over(Window.partitionBy("factor_id").orderBy("d")).cast("long")
    series = ev.rank_ic_series(pairs).select(
        F.col("factor_id").alias("candidate_id"), position.alias("position"), F.col("rank_ic").alias("value")
    )
    return rounded(testing.cohort_statistics(series, cohort_rows=len(_SMALL_BATCH)))
