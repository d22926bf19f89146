"""One query per formula operator, over the whole panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.operators.formulas import formula_columns, reduce_formula
from panelworks.plans import inputs
from panelworks.plans.registry import query, rounded


def formula_values(spark: SparkSession, sf_dir: str, formula: str, digits: int | None) -> DataFrame:
    panel = inputs.panel(spark, sf_dir, horizon=None)
    terms = reduce_formula(formula.split(), panel.columns)
    wide, name = formula_columns(panel, terms, group_rows=inputs.universe(sf_dir)[0])
    value = F.col(name[formula]).cast("double").alias("value")
    values = wide.select("symbol", "d", value)
    return values if digits is None else rounded(values, digits)


def _register(key: str, formula: str, expression: str, digits: int | None = 6) -> None:
    """``digits`` is None where both engines must agree to the last bit."""
    shown = f"CAST({expression} AS DOUBLE)" if digits is None else f"round(CAST({expression} AS DOUBLE), {digits}) + 0.0"
    sql = inputs.with_bars(f"SELECT symbol, d, {shown} AS value FROM panel")

    @query(key, sql)
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return formula_values(spark, sf_dir, formula, digits)


# name, formula, the same value as an SQL expression, digits compared
CELL_OPERATORS = [
    ("elem_neg", "ret neg", "-ret", 6),
    ("elem_abs", "ret abs", "abs(ret)", 6),
    ("elem_log", "ret log", "CASE WHEN ret > 0 THEN ln(ret) END", 6),
    ("elem_sqrt", "ret sqrt", "CASE WHEN ret >= 0 THEN sqrt(ret) END", 6),
    ("elem_sign", "ret sign", "sign(ret)", 6),
    ("elem_signedpower", "ret signedpower", "sign(ret) * ret * ret", 6),
    ("elem_add", "open close add", "open + close", None),
    ("elem_sub", "high low sub", "high - low", None),
    ("elem_mul", "close volume mul", "close * volume", None),
    ("elem_div", "open high low sub div", "CASE WHEN abs(high - low) >= 1e-12 THEN open / (high - low) END", None),
    ("elem_gt", "ret volume gt", "CASE WHEN ret > volume THEN 1.0 ELSE 0.0 END", 6),
    ("elem_lt", "ret volume lt", "CASE WHEN ret < volume THEN 1.0 ELSE 0.0 END", 6),
    ("elem_max", "ret open max", "CASE WHEN ret IS NOT NULL AND open IS NOT NULL THEN greatest(ret, open) END", None),
    ("elem_min", "ret open min", "CASE WHEN ret IS NOT NULL AND open IS NOT NULL THEN least(ret, open) END", None),
    ("elem_where", "ret high low where", "CASE WHEN ret > 0 THEN high ELSE low END", None),
]
for _key, _formula, _sql, _digits in CELL_OPERATORS:
    _register(_key, _formula, _sql, _digits)


def over(expression: str, w: int) -> str:
    return f"{expression} OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def full(w: int, expression: str) -> str:
    return f"CASE WHEN d >= {w - 1} THEN {expression} END"


_DAY = "CAST(d AS DOUBLE)"
_DECAY = (
    f"({over(f'sum(ret * {_DAY})', 10)} - ({_DAY} - 10) * {over('sum(ret)', 10)})"
    f" / nullif({over(f'sum(CASE WHEN ret IS NOT NULL THEN {_DAY} END)', 10)}"
    f" - ({_DAY} - 10) * {over('count(ret)', 10)}, 0)"
)
_PAIR_X, _PAIR_Y = "(CASE WHEN volume IS NOT NULL THEN ret END)", "(CASE WHEN ret IS NOT NULL THEN volume END)"
_SPREAD = f"{over(f'stddev_pop({_PAIR_X})', 10)} * {over(f'stddev_pop({_PAIR_Y})', 10)}"
WINDOW_OPERATORS = [
    ("ts_mean", "ret ts_mean_5", full(5, over("avg(ret)", 5)), 6),
    ("ts_std", "ret ts_std_20", full(20, over("stddev_pop(ret)", 20)), 6),
    ("ts_max", "high ts_max_20", full(20, over("max(high)", 20)), None),
    ("ts_min", "low ts_min_20", full(20, over("min(low)", 20)), None),
    ("ts_delay", "close ts_delay_5", "lag(close, 5) OVER (PARTITION BY symbol ORDER BY d)", None),
    ("ts_delta", "close ts_delta_5", "close - lag(close, 5) OVER (PARTITION BY symbol ORDER BY d)", None),
    (
        "ts_rank",
        "ret ts_rank_10",
        full(
            10,
            f"CASE WHEN ret IS NOT NULL THEN len(list_filter({over('list(ret)', 10)}, lambda v: v <= ret))"
            f" / CAST({over('count(ret)', 10)} AS DOUBLE) END",
        ),
        6,
    ),
    ("ts_sum", "volume ts_sum_10", full(10, over("sum(volume)", 10)), 4),
    ("decay_linear", "ret decay_linear_10", full(10, _DECAY), 6),
    (
        "ts_argmax",
        "high ts_argmax_20",
        full(20, f"d - {over('arg_max(d, row(high, -d)) FILTER (WHERE high IS NOT NULL)', 20)}"),
        6,
    ),
    (
        "ts_argmin",
        "low ts_argmin_20",
        full(20, f"d - {over('arg_min(d, row(low, d)) FILTER (WHERE low IS NOT NULL)', 20)}"),
        6,
    ),
    (
        "ts_count",
        "ret count_10",
        full(10, f"CASE WHEN {over('count(ret)', 10)} > 0 THEN {over('count(*) FILTER (WHERE ret > 0)', 10)} END"),
        6,
    ),
    (
        "ts_corr",
        "ret volume ts_corr_10",
        full(
            10,
            f"CASE WHEN {over(f'count({_PAIR_X})', 10)} >= 2 AND {_SPREAD} > 1e-12"
            f" THEN {over(f'covar_pop({_PAIR_X}, {_PAIR_Y})', 10)} / ({_SPREAD}) END",
        ),
        6,
    ),
    (
        "ts_cov",
        "ret volume ts_cov_10",
        full(10, f"CASE WHEN {over(f'count({_PAIR_X})', 10)} >= 2 THEN {over(f'covar_pop({_PAIR_X}, {_PAIR_Y})', 10)} END"),
        5,
    ),
    (
        "cs_rank",
        "volume cs_rank",
        "CASE WHEN volume IS NOT NULL THEN row_number() OVER (PARTITION BY d ORDER BY volume NULLS LAST, symbol)"
        " / CAST(count(volume) OVER (PARTITION BY d) AS DOUBLE) END",
        6,
    ),
    (
        "cs_zscore",
        "ret cs_zscore",
        "CASE WHEN stddev_pop(ret) OVER (PARTITION BY d) >= 1e-12"
        " THEN (ret - avg(ret) OVER (PARTITION BY d)) / stddev_pop(ret) OVER (PARTITION BY d) END",
        6,
    ),
    ("cs_demean", "ret cs_demean", "ret - avg(ret) OVER (PARTITION BY d)", 6),
]
for _key, _formula, _sql, _digits in WINDOW_OPERATORS:
    _register(_key, _formula, _sql, _digits)
