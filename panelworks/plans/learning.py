"""Features, labels, scaling, splits, samples and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.operators import features as ft
from panelworks.operators import labels as lb
from panelworks.plans import inputs
from panelworks.plans.inputs import with_bars
from panelworks.plans.registry import query
from panelworks.plans.signals import PREPARED_SQL, prepared_bars


def sealed(df: DataFrame) -> DataFrame:
    """Doubles at the single precision in which series are stored."""
    doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.withColumns(
        {c: F.when(F.abs(c) < 1e-11, 0.0).otherwise(F.col(c)).cast("float").cast("double") for c in doubles}
    )


def _seal(expression: str, name: str) -> str:
    return f"CAST(CAST(CASE WHEN abs({expression}) < 1e-11 THEN 0 ELSE {expression} END AS FLOAT) AS DOUBLE) AS {name}"


def _roll(agg: str, x: str, n: int, least: int | None = None, back: int = 0) -> str:
    frame = f"OVER (PARTITION BY symbol ORDER BY trading_date ROWS BETWEEN {n - 1 + back} PRECEDING AND {back} PRECEDING)"
    return f"CASE WHEN count({x}) {frame} >= {n if least is None else least} THEN {agg}({x}) {frame} END"


def _lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY symbol ORDER BY trading_date)"


def _change(x: str, k: int) -> str:
    return f"{x} / nullif({_lag(x, k)}, 0) - 1"


def _z(x: str, n: int) -> str:
    return f"({x} - {_roll('avg', x, n)}) / (nullif({_roll('stddev_pop', x, n)}, 0) + 1e-8)"


_F1 = f"""f1 AS (SELECT *, {_lag('close')} AS pc, ln(1 + greatest(volume, 0)) AS lv, greatest(high - low, 0) AS rg,
 {_change('close', 1)} AS ret_1, {_change('close', 3)} AS ret_3, {_change('close', 5)} AS ret_5, {_change('close', 10)} AS ret_10 FROM prep),
f2 AS (SELECT *, greatest(abs(high - low), abs(high - pc), abs(low - pc)) AS tr FROM f1),
f3 AS (SELECT *, {_roll('avg', 'tr', 14)} AS atr FROM f2)"""
_FEATURE_SQL = {
    **{f"ret_{k}": f"ret_{k}" for k in (1, 3, 5, 10)},
    **{f"{x}_prev_close": f"{x} / nullif(pc, 0) - 1" for x in ("open", "high", "low", "close")},
    "intraday_range_prev_close": "rg / nullif(pc, 0)",
    "intraday_body_prev_close": "(close - open) / nullif(pc, 0)",
    "body_ratio": "abs(close - open) / (rg + 1e-8)",
    "upper_shadow_ratio": "(high - greatest(open, close)) / (rg + 1e-8)",
    "lower_shadow_ratio": "(least(open, close) - low) / (rg + 1e-8)",
    "range_position": "(close - low) / (rg + 1e-8)",
    "gap_ratio": "(open - pc) / nullif(pc, 0)",
    "log1p_volume": "lv",
    **{f"volume_ratio_{n}": f"volume / nullif({_roll('avg', 'volume', n)}, 0)" for n in (5, 10, 20, 60)},
    **{f"volume_zscore_{n}": _z("lv", n) for n in (20, 60)},
    **{f"volume_change_{k}": _change("volume", k) for k in (1, 5)},
    **{f"amount_ratio_{n}": f"amount / nullif({_roll('avg', 'amount', n)}, 0)" for n in (5, 20)},
    "turnover": "turnover",
    **{f"turnover_ratio_{n}": f"turnover / nullif({_roll('avg', 'turnover', n)}, 0)" for n in (5, 20)},
    "turnover_zscore_20": _z("turnover", 20),
    "true_range_close": "tr / nullif(close, 0)",
    "atr14_close": "atr / nullif(close, 0)",
    **{f"realized_vol_{n}": _roll("stddev_pop", "ret_1", n) for n in (5, 20, 60)},
    "range_atr14": "rg / nullif(atr, 0)",
    "is_suspended": "is_suspended",
    "is_st": "is_st",
    **{name: "0.0::DOUBLE" for name in ("is_star_st", "is_delisting", "is_limit_up", "is_limit_down")},
    "st_observed": "1.0::DOUBLE",
    "suspension_observed": "1.0::DOUBLE",
    "limit_observed": "0.0::DOUBLE",
    "delisting_observed": "0.0::DOUBLE",
    "turnover_observed": "turnover_observed",
    "price_observed": "1.0::DOUBLE",
    "volume_observed": "1.0::DOUBLE",
    "listing_days_norm": "least(listing_days / 252.0::DOUBLE, 20)",
    "quality_mask": "1.0::DOUBLE",
}
FEATURES_SQL = (
    PREPARED_SQL
    + f", {_F1}, feats AS (SELECT symbol, trading_date, "
    + ", ".join(f"{expression} AS {name}" for name, expression in _FEATURE_SQL.items())
    + " FROM f3)\n"
)


@query(
    "features",
    with_bars(FEATURES_SQL + "SELECT symbol, trading_date, " + ", ".join(_seal(n, n) for n in ft.FEATURES) + " FROM feats"),
)
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sealed(ft.build_features(prepared_bars(spark, sf_dir)))


def _clip01(x: str) -> str:
    return f"CASE WHEN ({x}) < 0 THEN 0 WHEN ({x}) > 1 THEN 1 ELSE ({x}) END"


_MA = ", ".join(f"{_roll('avg', 'close', n)} AS ma{n}" for n in lb.SPANS)
_SINCE = ", ".join(
    f"CASE WHEN {k}_cross_{a}_{b} IS NOT NULL THEN least(coalesce(listing_days - max(CASE WHEN {k}_cross_{a}_{b} > 0 THEN listing_days END)"
    f" OVER (PARTITION BY symbol ORDER BY trading_date ROWS UNBOUNDED PRECEDING), 120), 120) / 120.0::DOUBLE END AS days_since_{k}_cross_{a}_{b}"
    for k in ("bull", "bear")
    for a, b in ((5, 20), (20, 60))
)
_CROSS = ", ".join(
    f"CASE WHEN c{a}_{b} IS NOT NULL AND p{a}_{b} IS NOT NULL THEN CAST(c{a}_{b} {x} 0 AND p{a}_{b} {y} 0 AS INTEGER)::DOUBLE END AS {k}_cross_{a}_{b}"
    for a, b in lb.CROSSES
    for k, x, y in (("bull", ">", "<="), ("bear", "<", ">="))
)
_T = "CAST(coalesce({}, FALSE) AS INTEGER)"
_ALIGN = [
    " + ".join(_T.format(f"ma{a} {op} ma{b}") for a, b in ((5, 10), (10, 20), (20, 60))) for op in (">", "<")
]
LABELS_SQL = (
    PREPARED_SQL
    + f""", l1 AS (SELECT *, {_lag('close')} AS pc, coalesce({_change('close', 1)}, 0) AS ret, CASE WHEN turnover_observed > 0 THEN turnover END AS tl,
 {_change('close', 20)} AS t20, {_MA}, {_roll('stddev_pop', 'close', 20)} AS sd, {_roll('max', 'high', 40, 20, 1)} AS rh, {_roll('min', 'low', 40, 20, 1)} AS rl,
 volume / ({_roll('avg', 'volume', 20, 5)} + 1e-8) AS v20 FROM prep),
l2 AS (SELECT *, greatest(abs(high - low), abs(high - pc), abs(low - pc)) AS tr, abs(ret) AS aret, 4 * sd / (abs(ma20) + 1e-8) AS bandwidth,
 {', '.join(f'ma{a} - ma{b} AS c{a}_{b}' for a, b in lb.CROSSES)} FROM l1),
l3 AS (SELECT *, nullif({_roll('avg', 'tr', 14, 1)}, 0) + 1e-8 AS a, {_roll('stddev_pop', 'ret', 20, 1)} AS sr1, {_roll('stddev_pop', 'ret', 20, 5)} AS sr5,
 {_roll('sum', 'aret', 20, 5)} AS path, {_roll('avg', 'tl', 20, 5)} AS tm, {', '.join(f'{_lag(f"c{a}_{b}")} AS p{a}_{b}' for a, b in lb.CROSSES)},
 {', '.join(f'{_change(f"ma{n}", 5)} AS ma{n}_slope' for n in lb.SPANS)}, bandwidth - {_lag('bandwidth', 5)} AS bandwidth_delta_5, bandwidth - {_lag('bandwidth', 20)} AS bandwidth_delta_20,
 list(bandwidth) OVER (PARTITION BY symbol ORDER BY trading_date ROWS BETWEEN 119 PRECEDING AND CURRENT ROW) AS bws FROM l2),
l4 AS (SELECT *, {_CROSS}, list_filter([ma5 / close, ma10 / close, ma20 / close, ma60 / close], lambda x: x IS NOT NULL) AS mr,
 CASE WHEN len(list_filter(bws, lambda x: x IS NOT NULL)) = 120 THEN (len(list_filter(bws, lambda x: x < bandwidth)) + (len(list_filter(bws, lambda x: x = bandwidth)) + 1) / 2.0::DOUBLE) / 120 END AS bandwidth_percentile FROM l3),
l5 AS (SELECT *, {_SINCE}, CASE WHEN len(mr) > 0 THEN list_stddev_pop(mr) END AS comp, ma20 + 2 * sd AS up, ma20 - 2 * sd AS lo,
 {_T.format('high > rh AND close < rh')} AS fu, {_T.format('low < rl AND close > rl')} AS fd, (v20 + tl / (tm + 1e-8)) / 2 AS effort, aret + tr / (close + 1e-8) AS res,
 (close - low) / (high - low + 1e-8) AS pos, {', '.join(f'close / (ma{n} + 1e-8) - 1 AS close_ma{n}_distance' for n in (5, 20, 60, 120))},
 ({_ALIGN[0]}) / 3.0::DOUBLE AS bull_alignment_score, ({_ALIGN[1]}) / 3.0::DOUBLE AS bear_alignment_score,
 {_clip01('abs(t20) / (sr1 * sqrt(20) + 1e-8)')} AS ma_trend_strength, {_clip01('abs(t20) / (sr5 * sqrt(20) + 1e-8)')} AS wyckoff_trend_strength,
 {_clip01('1 - abs(t20) / (path + 1e-8)')} AS trading_range_score, tanh(t20 * 8) AS trend_direction, {_clip01('(v20 - 1) / 2')} AS volume_expansion, {_clip01('(1 - v20) / 0.8')} AS volume_contraction,
 {_clip01('(close - rh) / a')} AS breakout_strength, {_clip01('(rl - close) / a')} AS breakdown_strength FROM l4),
l6 AS (SELECT *, {_clip01('1 - comp / 0.08')} AS compression_score, {_clip01('comp / 0.08')} AS ma_expansion_score, (close - lo) / (up - lo + 1e-8) AS percent_b, (close - ma20) / (sd + 1e-8) AS boll_zscore,
 1 - bandwidth_percentile AS squeeze_score, {_clip01('bandwidth_delta_5 / 0.05')} AS boll_expansion_score, {_clip01('(close - up) / a')} AS upper_break_strength, {_clip01('(lo - close) / a')} AS lower_break_strength,
 {_clip01('(close - rl) / (rh - rl + 1e-8)')} AS range_position, {_clip01('(close - rl) / a / 5')} AS support_distance, {_clip01('(rh - close) / a / 5')} AS resistance_distance, {_clip01('fu + fd')}::DOUBLE AS false_breakout_score,
 CASE WHEN turnover_observed > 0 THEN {_clip01('effort / (res + 0.02)')} END AS effort_result_score, CASE WHEN turnover_observed > 0 THEN tanh(effort - 1 - res * 10) END AS effort_result_divergence,
 {_clip01('0.5 + 0.25 * tanh(ret * 10) + 0.2 * (pos - 0.5) + 0.1 * volume_expansion')} AS demand_pressure_proxy, {_clip01('0.5 - 0.25 * tanh(ret * 10) + 0.2 * (0.5 - pos) + 0.1 * volume_expansion')} AS supply_pressure_proxy FROM l5),
l7 AS (SELECT *, 1.2 * trading_range_score + 0.8 * demand_pressure_proxy + 0.3 * (1 - wyckoff_trend_strength) AS s1,
 1.2 * {_clip01('trend_direction')} + 0.8 * bull_alignment_score + 0.3 * demand_pressure_proxy AS s2, 1.2 * trading_range_score + 0.8 * supply_pressure_proxy + 0.3 * (1 - wyckoff_trend_strength) AS s3,
 1.2 * {_clip01('-trend_direction')} + 0.8 * bear_alignment_score + 0.3 * supply_pressure_proxy AS s4, 1 - trading_range_score * 0.5 - wyckoff_trend_strength * 0.5 AS s5 FROM l6),
l8 AS (SELECT *, CASE WHEN s1 + s2 + s3 + s4 + s5 IS NOT NULL THEN greatest(s1, s2, s3, s4, s5) END AS mx FROM l7),
labs AS (SELECT * , {', '.join(f'exp(s{i} - mx) / (exp(s1 - mx) + exp(s2 - mx) + exp(s3 - mx) + exp(s4 - mx) + exp(s5 - mx) + 1e-8) AS {name}' for i, name in enumerate(lb.PHASES, 1))},
 {_clip01('(breakdown_strength * 0.4 + volume_expansion * 0.3 + supply_pressure_proxy * 0.3) * (1 - wyckoff_trend_strength * 0.25)')} AS sc_score,
 {_clip01('(breakout_strength * 0.4 + volume_expansion * 0.3 + demand_pressure_proxy * 0.3) * (1 - wyckoff_trend_strength * 0.25)')} AS bc_score,
 fd * {_T.format('trading_range_score > 0.25')} * (0.5 + 0.5 * demand_pressure_proxy) AS spring_score, fu * {_T.format('trading_range_score > 0.25')} * (0.5 + 0.5 * supply_pressure_proxy) AS upthrust_score,
 {_clip01('breakout_strength * 0.45 + demand_pressure_proxy * 0.35 + volume_expansion * 0.2')} AS sos_score, {_clip01('breakdown_strength * 0.45 + supply_pressure_proxy * 0.35 + volume_expansion * 0.2')} AS sow_score FROM l8)
"""
)


@query(
    "labels",
    with_bars(LABELS_SQL + "SELECT symbol, trading_date, " + ", ".join(_seal(f"{n}::DOUBLE", n) for n in lb.LABELS) + " FROM labs"),
)
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sealed(lb.build_labels(prepared_bars(spark, sf_dir)))


@query(
    "label_validity",
    with_bars(LABELS_SQL + "SELECT symbol, trading_date, " + ", ".join(f"{n} IS NOT NULL AS valid_{n}" for n in lb.LABELS) + " FROM labs"),
)
def label_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lb.with_validity(lb.build_labels(prepared_bars(spark, sf_dir)))
    return made.select("symbol", "trading_date", *[f"valid_{n}" for n in lb.LABELS])


# --- scaler, splits, samples ----------------------------------------------------------------------

from datetime import date  # noqa: E402

from panelworks.operators import audits, dataset, prepare  # noqa: E402
from panelworks.plans.registry import rounded  # noqa: E402
from panelworks.session import stored  # noqa: E402

SPLIT = dataset.TimeSplit(
    (date(1995, 1, 1), date(1998, 6, 30)),
    (date(1998, 9, 1), date(2000, 3, 31)),
    (date(2000, 6, 1), date(2001, 12, 31)),
)
_SCALED = ft.CONTINUOUS
# the columns of bars that continuous features are made of
_PRICED = (*prepare.PRICES, "volume", "amount", "turnover")


def _spread_sql(c: str) -> str:
    spread = f"(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) / 1.349"
    return f"CASE WHEN {spread} > 1e-6 THEN {spread} ELSE 1 END"


@query(
    "scaler_fit",
    with_bars(
        FEATURES_SQL
        + "SELECT "
        + ", ".join(
            f"round(coalesce(quantile_cont({c}, 0.5), 0), 6) + 0.0 AS {c}_median, round({_spread_sql(c)}, 6) AS {c}_scale"
            for c in _SCALED
        )
        + " FROM feats WHERE trading_date BETWEEN DATE '1995-01-01' AND DATE '1998-06-30'"
    ),
)
def scaler_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = ft.build_features(prepared_bars(spark, sf_dir)).where(
        dataset.split_of(F.col("trading_date"), SPLIT) == "train"
    )
    return rounded(ft.fit_scaler(train, _SCALED))


@query(
    "scaler_apply",
    with_bars(
        FEATURES_SQL
        + ", s AS (SELECT "
        + ", ".join(
            f"coalesce(quantile_cont({c}, 0.5), 0) AS {c}_m, {_spread_sql(c)} AS {c}_s" for c in _SCALED
        )
        + " FROM feats WHERE trading_date BETWEEN DATE '1995-01-01' AND DATE '1998-06-30') SELECT symbol, trading_date, "
        + ", ".join(_seal(f"greatest(-8, least(8, coalesce(({c} - {c}_m) / {c}_s, 0)))", c) for c in _SCALED)
        + " FROM feats, s"
    ),
)
def scaler_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the exchanges behind the bars are gone before those of the features begin
    bars = stored(prepared_bars(spark, sf_dir).select("symbol", "trading_date", *_PRICED))
    made = stored(ft.build_features(bars).select("symbol", "trading_date", *_SCALED))
    train = made.where(dataset.split_of(F.col("trading_date"), SPLIT) == "train")
    return sealed(ft.apply_scaler(made, ft.fit_scaler(train, _SCALED, kept=True), _SCALED))


@query(
    "symbol_holdout",
    """WITH s AS (SELECT s_suppkey AS symbol, '(''' || s_nationkey || ''', ''' || (CASE WHEN s_acctbal > 5000 THEN 'large' ELSE 'small' END) || ''')' AS stratum FROM supplier),
r AS (SELECT *, count(*) OVER (PARTITION BY stratum) AS n, row_number() OVER (PARTITION BY stratum ORDER BY sha256('42:' || stratum || ':' || symbol)) AS k FROM s)
SELECT symbol, stratum, k <= least(CASE WHEN n >= 5 THEN greatest(1, CAST(round_even(n * 0.2, 0) AS INTEGER)) ELSE CAST(round_even(n * 0.2, 0) AS INTEGER) END, n - 1) AS is_holdout FROM r""",
)
def symbol_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = inputs.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("symbol"),
        F.col("s_nationkey").alias("industry"),
        F.when(F.col("s_acctbal") > 5000, "large").otherwise("small").alias("size"),
    )
    return dataset.symbol_holdout(suppliers, ["industry", "size"], inputs.universe(sf_dir)[0])


@query(
    "hashed_symbols",
    "SELECT l_suppkey AS symbol FROM (SELECT DISTINCT l_suppkey FROM lineitem) ORDER BY sha256('42:' || l_suppkey) LIMIT 20",
)
def hashed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.hashed_symbols(inputs.bars(spark, sf_dir), 20)


@query(
    "symbol_list_hash",
    """WITH d AS (SELECT sha256(s) AS h FROM (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS s FROM lineitem)),
p AS (SELECT count(*) AS n, sum(CAST('0x' || substr(h, 1, 15) AS HUGEINT)) AS a, sum(CAST('0x' || substr(h, 16, 15) AS HUGEINT)) AS b, sum(CAST('0x' || substr(h, 31, 15) AS HUGEINT)) AS c FROM d)
SELECT n, sha256(concat_ws(':', CAST(n AS VARCHAR), CAST(a AS VARCHAR), CAST(b AS VARCHAR), CAST(c AS VARCHAR))) AS symbols_hash FROM p""",
)
def symbol_list_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.symbol_list_hash(inputs.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("symbol")))


def quality_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = prepared_bars(spark, sf_dir)
    made = ft.seal_quality(ft.build_features(bars)).select("symbol", "trading_date", "quality_mask")
    return made.withColumn("listing_days", F.row_number().over(_by_symbol()))


def _by_symbol():
    from panelworks.functions.rolling import Rolling

    return Rolling().ordered


_REQUIRED = [c for c in ft.CONTINUOUS if c not in ft.OPTIONAL]
_SAMPLE_SHAPE = {"window": 20, "stride": 5, "min_listing": 40, "min_quality": 0.5}
SAMPLES_SQL = (
    FEATURES_SQL
    + f""", q AS (SELECT symbol, trading_date, CAST(row_number() OVER (PARTITION BY symbol ORDER BY trading_date) - 1 AS INTEGER) AS pos,
  CASE WHEN {' AND '.join(f'{c} IS NOT NULL' for c in _REQUIRED)} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS qm,
  CASE WHEN trading_date BETWEEN DATE '1995-01-01' AND DATE '1998-06-30' THEN 'train' WHEN trading_date BETWEEN DATE '1998-09-01' AND DATE '2000-03-31' THEN 'valid'
       WHEN trading_date BETWEEN DATE '2000-06-01' AND DATE '2001-12-31' THEN 'test' END AS split FROM feats),
w AS (SELECT *, avg(qm) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS qr, min(pos) OVER (PARTITION BY symbol, split) AS p0 FROM q),
ok AS (SELECT * FROM w WHERE split IS NOT NULL AND pos - p0 >= 19 AND pos + 1 >= 40 AND qm > 0 AND qr >= 0.5),
g AS (SELECT symbol, split, list_reduce(list(pos ORDER BY pos), lambda acc, x: CASE WHEN len(acc) = 0 OR x - acc[len(acc)] >= 5 THEN list_append(acc, x) ELSE acc END, CAST([] AS INTEGER[])) AS ks FROM ok GROUP BY 1, 2),
smp AS (SELECT ok.symbol, pos - 19 AS start_index, pos AS end_index, trading_date AS as_of, ok.split, qr AS quality_ratio FROM ok JOIN g ON g.symbol = ok.symbol AND g.split = ok.split WHERE list_contains(ks, pos))
"""
)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.eligible_samples(quality_rows(spark, sf_dir), SPLIT, **_SAMPLE_SHAPE)


@query(
    "eligible_samples",
    with_bars(SAMPLES_SQL + "SELECT symbol, start_index, end_index, as_of, split, round(quality_ratio, 6) AS quality_ratio FROM smp"),
)
def eligible_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(samples(spark, sf_dir))


_ROLES_SQL = """, ho AS (SELECT symbol, row_number() OVER (ORDER BY sha256('42:():' || symbol)) <= (SELECT CAST(round_even(count(DISTINCT symbol) * 0.2, 0) AS INTEGER) FROM bars) AS h
  FROM (SELECT DISTINCT symbol FROM bars)),
roles AS (SELECT s.* REPLACE (CASE WHEN NOT h AND split = 'test' THEN 'time_test' WHEN NOT h THEN split WHEN split = 'valid' THEN 'instrument_test' WHEN split = 'test' THEN 'double_oos' END AS split) FROM smp s JOIN ho USING (symbol))
"""


def role_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = inputs.bars(spark, sf_dir).select("symbol")
    holdout = dataset.symbol_holdout(symbols, [], inputs.universe(sf_dir)[0])
    return dataset.assign_roles(samples(spark, sf_dir), holdout)


@query(
    "sample_roles",
    with_bars(SAMPLES_SQL + _ROLES_SQL + "SELECT split, count(*) AS samples, count(DISTINCT symbol) AS symbols FROM roles WHERE split IS NOT NULL GROUP BY 1"),
)
def sample_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_samples(spark, sf_dir).groupBy("split").agg(
        F.count(F.lit(1)).alias("samples"), F.count_distinct("symbol").alias("symbols")
    )


@query(
    "split_conflicts",
    with_bars(
        SAMPLES_SQL
        + """, two AS (SELECT symbol, as_of, split FROM smp UNION ALL SELECT symbol, as_of, 'time_test' FROM smp WHERE end_index % 2 = 0)
SELECT symbol, as_of, list(DISTINCT s ORDER BY s) AS splits FROM (SELECT symbol, as_of, CASE WHEN split = 'test' THEN 'time_test' ELSE split END AS s FROM two) GROUP BY 1, 2 HAVING count(DISTINCT s) > 1"""
    ),
)
def split_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check on an index that was spoiled on purpose."""
    index = samples(spark, sf_dir).select("symbol", "as_of", "split", "end_index")
    spoiled = index.unionByName(index.where(F.col("end_index") % 2 == 0).withColumn("split", F.lit("time_test")))
    return dataset.split_conflicts(spoiled)


@query(
    "window_arrays",
    with_bars(
        SAMPLES_SQL
        + """, ser AS (SELECT symbol, list(CAST(CAST(log1p_volume AS FLOAT) AS DOUBLE) ORDER BY trading_date) AS v FROM feats GROUP BY 1)
SELECT symbol, end_index, len(v[start_index + 1:end_index + 1]) AS n_rows, round(list_sum(v[start_index + 1:end_index + 1]), 3) AS total FROM smp JOIN ser USING (symbol)"""
    ),
)
def window_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ft.build_features(prepared_bars(spark, sf_dir))
    windows = dataset.window_arrays(rows, samples(spark, sf_dir), ["log1p_volume", "turnover"])
    total = F.aggregate("window", F.lit(0.0), lambda s, r: s + r[0].cast("double"))
    return windows.select(
        "symbol", "end_index", F.size("window").cast("long").alias("n_rows"), F.round(total, 3).alias("total")
    )


@query(
    "spaced_rows",
    with_bars(
        """, r AS (SELECT symbol, trading_date, row_number() OVER (PARTITION BY symbol ORDER BY trading_date) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
k AS (SELECT symbol, n, unnest(list_distinct(list_append(list_transform(range(0, 63), lambda i: CAST(floor(i * ((n - 1) / 63.0::DOUBLE)) AS BIGINT)), n - 1))) AS i FROM (SELECT DISTINCT symbol, n FROM r))
SELECT r.symbol, r.trading_date FROM r JOIN k ON k.symbol = r.symbol AND k.i = r.i"""
    ),
)
def spaced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    whole = Window.partitionBy("symbol")
    rows = inputs.bars(spark, sf_dir).withColumns(
        {"i": F.row_number().over(whole.orderBy("trading_date")) - 1, "n": F.count(F.lit(1)).over(whole)}
    )
    return rows.where(dataset.evenly_spaced(F.col("i"), F.col("n"), 64)).select("symbol", "trading_date")


# --- audits ----------------------------------------------------------------------------------------

_AUDITED = ((*ft.CONTINUOUS, *ft.STATES), tuple(lb.LABELS))


def audited_rows(bars: DataFrame) -> DataFrame:
    """Features and labels side by side, built on the same ordered rows: they are never joined."""
    given = [c for c in bars.columns if c not in ("symbol", "trading_date")]
    kept = bars.withColumns({f"b_{c}": F.col(c) for c in given})
    y = lb.build_labels(kept, keep=[*[f"b_{c}" for c in given], "_row"])
    y = y.select(
        "symbol", "trading_date", "_row", *[F.col(f"b_{c}").alias(c) for c in given], *[F.col(c).alias(f"l_{c}") for c in _AUDITED[1]]
    )
    both = ft.build_features(y, keep=[f"l_{c}" for c in _AUDITED[1]])
    both = both.withColumnsRenamed({c: f"f_{c}" for c in _AUDITED[0]})
    planted = both.withColumn("l_planted", 3 * F.col("f_ret_1") + 2)
    names = [*[f"f_{c}" for c in _AUDITED[0]], *[f"l_{c}" for c in _AUDITED[1]], "l_planted"]
    filled = planted.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names})
    return filled.withColumn("row_id", F.concat_ws("|", "symbol", "trading_date"))


def drawn_symbols(bars: DataFrame) -> DataFrame:
    """The bars of few symbols, to see how values spread: what is computed from them only balances tasks."""
    return bars.where(F.pmod(F.xxhash64("symbol"), F.lit(64)) == 0)


_X, _Y = [f"f_{c}" for c in _AUDITED[0]], [f"l_{c}" for c in _AUDITED[1]] + ["l_planted"]


@query(
    "shortcut_leakage",
    with_bars(
        FEATURES_SQL
        + LABELS_SQL[len(PREPARED_SQL):]
        + ", j AS (SELECT row_number() OVER (ORDER BY symbol, trading_date) - 1 AS i, count(*) OVER () AS n, "
        + ", ".join(f"coalesce(feats.{c}, 0)::DOUBLE AS f_{c}" for c in _AUDITED[0])
        + ", "
        + ", ".join(f"coalesce(labs.{c}, 0)::DOUBLE AS l_{c}" for c in _AUDITED[1])
        + ", coalesce(3 * feats.ret_1 + 2, 0) AS l_planted FROM feats JOIN labs USING (symbol, trading_date))"
        + ", a AS (SELECT * FROM j), lx AS (SELECT i, feature, x FROM (UNPIVOT (SELECT i, "
        + ", ".join(_X)
        + " FROM a) ON "
        + ", ".join(_X)
        + " INTO NAME feature VALUE x)), ly AS (SELECT i, target, y FROM (UNPIVOT (SELECT i, "
        + ", ".join(_Y)
        + " FROM a) ON "
        + ", ".join(_Y)
        + """ INTO NAME target VALUE y)),
rx AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0::DOUBLE AS r FROM lx),
ry AS (SELECT *, rank() OVER (PARTITION BY target ORDER BY y) + (count(*) OVER (PARTITION BY target, y) - 1) / 2.0::DOUBLE AS r FROM ly)
SELECT feature, target, round(p, 5) + 0.0 AS pearson, round(s, 5) + 0.0 AS spearman, round(e, 6) AS exact_equality_rate, abs(p) > 0.9999 AND p * p > 0.9999 AS violation
FROM (SELECT feature, target, CASE WHEN var_pop(x) <= 1e-15 OR var_pop(y) <= 1e-15 THEN 0 ELSE covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) END AS p,
  CASE WHEN var_pop(rx.r) <= 1e-15 OR var_pop(ry.r) <= 1e-15 THEN 0 ELSE covar_pop(rx.r, ry.r) / sqrt(var_pop(rx.r) * var_pop(ry.r)) END AS s,
  avg(CASE WHEN x = y THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS e FROM rx JOIN ry USING (i) GROUP BY 1, 2)"""
    ),
)
def shortcut_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = stored(prepared_bars(spark, sf_dir))
    drawn = audited_rows(drawn_symbols(bars))
    pairs = audits.shortcut_leakage(audited_rows(bars), _X, _Y, inputs.bar_rows(sf_dir), drawn=drawn)
    columns = ["feature", "target", "pearson", "spearman", "exact_equality_rate", "violation"]
    return rounded(pairs.select(*columns), 5, exact_equality_rate=6)


_CASES = 500


def next_close(rows: DataFrame, by=("symbol",)) -> DataFrame:
    """A builder that looks one row ahead, for the audit to find."""
    from pyspark.sql import Window

    ahead = F.lead("close").over(Window.partitionBy(*by).orderBy("trading_date"))
    return rows.select(*by, "trading_date", ahead.alias("next_close"))


# causal builders must not react; the planted one sees what the first later row became
_CASES_SQL = f""", r AS (SELECT symbol, trading_date, close, row_number() OVER (PARTITION BY symbol ORDER BY trading_date) - 1 AS p, count(*) OVER (PARTITION BY symbol) AS m FROM bars),
u AS (SELECT *, row_number() OVER (ORDER BY symbol, trading_date) - 1 AS k, count(*) OVER () AS n FROM r WHERE p < m - 1),
ks AS (SELECT DISTINCT k FROM (SELECT unnest(list_append(list_transform(range(0, {_CASES - 1}), lambda i: CAST(floor(i * ((n - 1) / {_CASES - 1}.0::DOUBLE)) AS BIGINT)), n - 1)) AS k FROM (SELECT DISTINCT n FROM u))),
c AS (SELECT symbol, p AS cutoff, m, k, k % 5 AS mode, least(p, {audits.CONE[0]}) + 1 AS rows FROM u WHERE n <= {_CASES} OR k IN (SELECT k FROM ks)),
f AS (SELECT c.*, r.p, r.close, CASE mode WHEN 2 THEN -r.p WHEN 4 THEN 0 ELSE r.p END AS o, CASE WHEN mode = 4 THEN md5(concat_ws(':', k, r.p)) END AS q
  FROM c JOIN r ON r.symbol = c.symbol AND r.p BETWEEN cutoff + 1 AND cutoff + {audits.CONE[1]}),
h AS (SELECT k, any_value(mode) AS mode, any_value(rows) AS rows, arg_min(close, p) AS b, first(close ORDER BY o, q, p) AS a FROM f GROUP BY 1),
l AS (SELECT mode, rows, abs(a * CASE mode WHEN 0 THEN 1000 WHEN 1 THEN 0.01 WHEN 3 THEN 3 ELSE 1 END - b) > 1e-8 + 1e-5 * abs(b) AS bad FROM h),
s AS (SELECT unnest(['features', 'labels']) AS builder, mode, rows, FALSE AS bad FROM l UNION ALL SELECT 'next_close', mode, rows, bad FROM l)
SELECT builder, count(*) AS cases, CAST(sum(rows) AS BIGINT) AS rows_checked, count(*) FILTER (WHERE bad) AS value_violations, 0::BIGINT AS validity_violations, count(*) FILTER (WHERE bad) = 0 AS passed FROM s"""


def _causality(spark: SparkSession, sf_dir: str, modes: tuple[int, ...]) -> DataFrame:
    bars = prepared_bars(spark, sf_dir)
    cases = audits.causality_cases(bars, inputs.bar_rows(sf_dir), cases=_CASES).where(F.col("mode").isin(*modes))
    builders = {"features": ft.build_features, "labels": lb.build_labels, "next_close": next_close}
    return audits.causality_summary(audits.causality_audit(bars, cases, builders))


@query("causality_audit", with_bars(_CASES_SQL + " GROUP BY 1"))
def causality_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and labels must not react to any change of later bars; a builder that looks ahead must."""
    return _causality(spark, sf_dir, (0, 1, 2, 3, 4))


@query("future_invariance", with_bars(_CASES_SQL + " WHERE mode = 0 GROUP BY 1"))
def future_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases whose later bars are a thousand times larger."""
    return _causality(spark, sf_dir, (0,))


def scaled_pairs(bars: DataFrame, factor: float) -> DataFrame:
    """Features of the bars (``a_`` names) beside those at scaled prices (``b_`` names), built on the same ordered rows."""
    given = [c for c in _PRICED if c in bars.columns]
    kept = prepare.scale_prices(bars.withColumns({f"a_{c}": F.col(c) for c in given}), factor)
    kept = kept.select("symbol", "trading_date", *[f"a_{c}" for c in given], *[F.col(c).alias(f"b_{c}") for c in given])
    return ft.paired_features(kept, ("a_", "b_"))


@query("price_scale_invariance")
def price_scale_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = stored(prepared_bars(spark, sf_dir).select("symbol", "trading_date", *_PRICED))
    pairs = scaled_pairs(bars, 10.0)
    return rounded(audits.feature_cosine(pairs, ft.CONTINUOUS))


@query(
    "annotator_agreement",
    """WITH p AS (SELECT 'quality' AS label, quality AS a, 1 - toxic AS b FROM labels),
t AS (SELECT label, count(*) AS n, avg(CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS o, avg(a::DOUBLE) AS pa, avg(b::DOUBLE) AS pb FROM p GROUP BY 1),
k AS (SELECT label, n AS pairs, (o - (pa * pb + (1 - pa) * (1 - pb))) / greatest(1 - (pa * pb + (1 - pa) * (1 - pb)), 1e-12) AS kappa FROM t)
SELECT label, pairs, round(kappa, 6) + 0.0 AS kappa, kappa >= 0.6 AS passed FROM k""",
)
def annotator_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = inputs.table(spark, sf_dir, "labels").select(
        F.lit("quality").alias("label"), F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b")
    )
    return rounded(audits.cohens_kappa(pairs))


@query(
    "event_coverage",
    """SELECT event, count(*) FILTER (WHERE v > 0.5) AS positive, count(*) FILTER (WHERE v <= 0.5) AS negative,
 count(*) FILTER (WHERE v > 0.5) >= 100 AND count(*) FILTER (WHERE v <= 0.5) >= 200 AS passed
FROM (SELECT 'quality' AS event, quality AS v FROM labels UNION ALL SELECT 'toxic', toxic FROM labels) GROUP BY 1""",
)
def event_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = inputs.table(spark, sf_dir, "labels").unpivot("doc_id", ["quality", "toxic"], "event", "value")
    return audits.event_coverage(marks.withColumn("value", F.col("value").cast("double")))


@query(
    "gold_lookup",
    with_bars(
        SAMPLES_SQL
        + _ROLES_SQL
        + """, gold AS (SELECT symbol, trading_date AS as_of, CASE symbol % 3 WHEN 0 THEN 'double_oos' WHEN 1 THEN NULL ELSE 'time_test' END AS e FROM bars),
m AS (SELECT gold.*, r.split AS a FROM gold LEFT JOIN (SELECT * FROM roles WHERE split IS NOT NULL) r ON r.symbol = gold.symbol AND r.as_of = gold.as_of)
SELECT outcome, count(*) AS records FROM (SELECT CASE WHEN e IS NOT NULL AND e <> 'double_oos' THEN CASE WHEN a IN ('train', 'valid') THEN 'in_sample' ELSE 'split_mismatch' END
  WHEN a IS NULL OR a <> 'double_oos' THEN CASE WHEN a IN ('train', 'valid') THEN 'in_sample' WHEN a IS NOT NULL AND e IS NOT NULL AND a <> e THEN 'split_mismatch' ELSE 'missing' END
  WHEN e IS NOT NULL AND a <> e THEN 'split_mismatch' ELSE 'matched' END AS outcome FROM m) GROUP BY 1"""
    ),
)
def gold_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("symbol") % 3
    gold = inputs.bars(spark, sf_dir).select(
        "symbol",
        F.col("trading_date").alias("as_of"),
        F.when(kind == 0, "double_oos").when(kind == 2, "time_test").alias("expected_split"),
    )
    found = audits.gold_lookup(gold, role_samples(spark, sf_dir))
    return found.groupBy("outcome").agg(F.count(F.lit(1)).alias("records"))


def _experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return inputs.table(spark, sf_dir, "orders").select(
        key.alias("experiment_id"),
        F.lit(0).alias("discovery_start"),
        F.when(key % 7 != 0, (key % 100).cast("int")).alias("discovery_end"),
        F.when(key % 7 != 0, (key % 90 + 20).cast("int")).alias("final_oos_start"),
        F.when(key % 7 != 0, (key % 60 + 60).cast("int")).alias("final_oos_end"),
        F.when(key % 5 != 0, F.col("o_orderpriority")).alias("data_snapshot_id"),
        (F.col("o_orderstatus") == "F").alias("oos_passed"),
    )


@query(
    "oos_audit",
    """WITH e AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 100 END AS de, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 90 + 20 END AS fs,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 60 + 60 END AS fe, o_orderkey % 5 = 0 AS nosnap, o_orderstatus = 'F' AS ok FROM orders),
v AS (SELECT *, list_filter([CASE WHEN fs IS NULL THEN 'RESEARCH_SPLIT_MISSING' END, CASE WHEN fs >= fe THEN 'FINAL_OOS_WINDOW_INVALID' END,
  CASE WHEN fs < de THEN 'FINAL_OOS_OVERLAPS_DISCOVERY' END, CASE WHEN nosnap THEN 'DATA_SNAPSHOT_MISSING' END], lambda x: x IS NOT NULL) AS violations FROM e)
SELECT k AS experiment_id, CASE WHEN len(violations) = 0 THEN 'PASSED' ELSE 'FAILED' END AS audit_status, violations, CASE WHEN ok THEN CAST([] AS VARCHAR[]) ELSE ['FINAL_OOS_METRICS_NOT_PASSED'] END AS warnings FROM v""",
)
def oos_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.oos_audit(_experiments(spark, sf_dir)).select("experiment_id", "audit_status", "violations", "warnings")


@query(
    "identity_separation",
    """SELECT o_orderkey AS experiment_id, o_orderkey % 7 = 0 OR NOT (o_orderkey % 90 + 20 = 0 AND o_orderkey % 60 + 60 = o_orderkey % 100) AS separated FROM orders""",
)
def identity_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.identity_separation(_experiments(spark, sf_dir)).select("experiment_id", "separated")


_EVENT_WRITINGS = ("spring", " UT ", "Upthrust", "SC_score", "bc", "SOS", "sow_SCORE ", "upthrust_score", "rally", "")


@query(
    "gold_event_names",
    "WITH w AS (SELECT ["
    + ", ".join(f"'{x}'" for x in _EVENT_WRITINGS)
    + f"""][doc_id % {len(_EVENT_WRITINGS)} + 1] AS written FROM labels), p AS (SELECT *, lower(trim(written)) AS n FROM w)
SELECT written, CASE WHEN n IN ('ut', 'upthrust', 'upthrust_score') THEN 'upthrust_score' WHEN n IN ('sc', 'bc', 'spring', 'sos', 'sow') THEN n || '_score' WHEN n IN ('sc_score', 'bc_score', 'spring_score', 'sos_score', 'sow_score') THEN n END AS event,
 count(*) AS records FROM p GROUP BY 1, 2""",
)
def gold_event_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    writings = F.array(*[F.lit(x) for x in _EVENT_WRITINGS])
    written = F.element_at(writings, (F.col("doc_id") % len(_EVENT_WRITINGS) + 1).cast("int"))
    named = inputs.table(spark, sf_dir, "labels").select(written.alias("written"), audits.event_name(written).alias("event"))
    return named.groupBy("written", "event").agg(F.count(F.lit(1)).alias("records"))
