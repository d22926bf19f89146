"""Panel, evaluation and formula-table queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.operators import evaluate as ev
from panelworks.operators import formulas as fm
from panelworks.operators import grid
from panelworks.plans import inputs
from panelworks.plans.inputs import HORIZON, with_bars
from panelworks.plans.registry import query, rounded

# --- bars and panel ---------------------------------------------------------------------


@query(
    "panel_grid",
    with_bars(
        "SELECT symbol, d, close, volume, round(amount, 2) AS amount, round(ret, 6) + 0.0 AS ret FROM panel"
    ),
)
def panel_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = inputs.panel(spark, sf_dir, None)
    amount, ret = F.round("amount", 2).alias("amount"), (F.round("ret", 6) + F.lit(0.0)).alias("ret")
    return panel.select("symbol", "d", "close", "volume", amount, ret)


@query("trading_calendar", with_bars("SELECT trading_date, d FROM calendar"))
def trading_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.calendar(inputs.bars(spark, sf_dir)).select("trading_date", "d")


@query(
    "instruments",
    with_bars(
        "SELECT symbol, min(trading_date) AS first_date, max(trading_date) AS last_date, count(*) AS n_rows"
        " FROM bars GROUP BY symbol"
    ),
)
def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        inputs.bars(spark, sf_dir)
        .groupBy("symbol")
        .agg(
            F.min("trading_date").alias("first_date"),
            F.max("trading_date").alias("last_date"),
            F.count(F.lit(1)).alias("n_rows"),
        )
    )


@query(
    "forward_return",
    with_bars("SELECT symbol, d, round(fwd, 6) + 0.0 AS fwd FROM panel"),
)
def forward_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inputs.panel(spark, sf_dir).select("symbol", "d", "fwd"))


# --- one formula end to end --------------------------------------------------------------

FLAGSHIP = {"ret_mean_reversal_5d": "ret ts_mean_5 neg cs_rank".split()}
FLAGSHIP_SQL = """
, raw AS (
  SELECT 'ret_mean_reversal_5d' AS factor_id, symbol, d, n_days, fwd, CASE WHEN d >= 4 THEN
    -avg(ret) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS raw
  FROM panel),
fv AS (
  SELECT *, row_number() OVER (PARTITION BY d ORDER BY raw, symbol) / CAST(count(*) OVER (PARTITION BY d) AS DOUBLE) AS value
  FROM raw WHERE raw IS NOT NULL)
"""
PAIRS_SQL = """
, pairs AS (
  SELECT *, row_number() OVER (PARTITION BY factor_id, d ORDER BY value, symbol) AS fr,
         row_number() OVER (PARTITION BY factor_id, d ORDER BY fwd, symbol) AS rr
  FROM fv WHERE fwd IS NOT NULL),
daily AS (
  SELECT factor_id, d, any_value(n_days) AS n_days, count(*) AS n, avg(fwd) AS mean_forward,
         stddev_pop(value) AS sx, stddev_pop(fwd) AS sy, covar_pop(value, fwd) AS c,
         1 - 6 * sum(CAST((fr - rr) * (fr - rr) AS DOUBLE)) / (count(*) * (CAST(count(*) AS DOUBLE) * count(*) - 1)) AS rho
  FROM pairs GROUP BY factor_id, d),
ics AS (
  SELECT factor_id, d, n_days, n, mean_forward, c / (sx * sy) AS ic, rho AS rank_ic
  FROM daily WHERE n >= 10 AND sx >= 1e-12 AND sy >= 1e-12)
"""


def flagship_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm.factor_values(inputs.panel(spark, sf_dir), FLAGSHIP, inputs.universe(sf_dir)[0], keep=("fwd",))


@query(
    "daily_ic",
    with_bars(FLAGSHIP_SQL + PAIRS_SQL + "SELECT factor_id, d, n, round(ic, 6) AS ic, round(rank_ic, 6) AS rank_ic FROM ics"),
)
def daily_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = ev.ranked_pairs(flagship_values(spark, sf_dir), inputs.universe(sf_dir)[0])
    daily = ev.daily_ic(pairs).where(F.col("rank_ic").isNotNull())
    return rounded(daily.select("factor_id", "d", "n", "ic", "rank_ic"))


@query(
    "rank_ic_series",
    with_bars(
        FLAGSHIP_SQL
        + PAIRS_SQL
        + "SELECT factor_id, row_number() OVER (ORDER BY d) - 1 AS position, d, round(rho, 6) AS rank_ic FROM daily WHERE n >= 10"
    ),
)
def rank_ic_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    pairs = ev.ranked_pairs(flagship_values(spark, sf_dir), inputs.universe(sf_dir)[0])
    # one row per day from here on: bounded by the calendar
    position = (F.row_number().over(Window.partitionBy("factor_id").orderBy("d")) - 1).cast("long")
    series = ev.rank_ic_series(pairs).withColumn("position", position)
    return rounded(series.select("factor_id", "position", "d", "rank_ic"))


def evaluation_sql(ranges: str, top_k: str = "greatest(5, CAST(floor((SELECT count(DISTINCT symbol) FROM bars) * 0.01) AS INTEGER))") -> str:
    """Evaluation of ``fv`` over the rows (range_name, day_from, day_to, fwd_to) of ``ranges``."""
    return (
        PAIRS_SQL
        + f"""
, ranges AS (SELECT range_name, CAST(day_from AS INTEGER) AS day_from, CAST(day_to AS INTEGER) AS day_to,
                    CAST(fwd_to AS INTEGER) AS fwd_to FROM ({ranges})),
ranged AS (SELECT r.range_name, r.day_from, i.* FROM ics i JOIN ranges r
           ON i.d >= r.day_from AND i.d < least(r.day_to, r.fwd_to)),
summary AS (SELECT range_name, factor_id, count(*) AS valid_ic_days, avg(rank_ic) AS rank_ic, avg(ic) AS ic_mean,
                   stddev_pop(rank_ic) AS dev FROM ranged GROUP BY 1, 2),
dlists AS (SELECT range_name, factor_id, min(day_from) AS day_from, list(d ORDER BY d) AS ds FROM ranged GROUP BY 1, 2),
kept AS (SELECT range_name, factor_id,
           list_reduce(ds, lambda acc, x: CASE WHEN len(acc) = 0 OR x - acc[len(acc)] >= {HORIZON} THEN list_append(acc, x) ELSE acc END,
                       CAST([] AS INTEGER[])) AS ks FROM dlists),
picks AS (SELECT range_name, factor_id, unnest(ks) AS d, generate_subscripts(ks, 1) - 1 AS period FROM kept),
members AS (
  SELECT k.range_name, p.factor_id, k.period, p.d, p.symbol, p.fwd, i.mean_forward FROM picks k
  JOIN ics i ON i.factor_id = k.factor_id AND i.d = k.d
  JOIN pairs p ON p.factor_id = k.factor_id AND p.d = k.d
  WHERE p.fr > i.n - least({top_k}, i.n)),
periods AS (
  SELECT m.range_name, m.factor_id, m.period, avg(m.fwd) AS top_return, any_value(m.mean_forward) AS bench,
         CASE WHEN m.period = 0 THEN 1.0 ELSE count(*) FILTER (WHERE q.symbol IS NULL) / CAST(count(*) AS DOUBLE) END AS turnover
  FROM members m LEFT JOIN members q ON q.range_name = m.range_name AND q.factor_id = m.factor_id
       AND q.symbol = m.symbol AND q.period = m.period - 1
  GROUP BY 1, 2, 3),
portfolio AS (
  SELECT range_name, factor_id, avg(top_return - 0.001 * turnover) * 250 / {HORIZON} AS topk, avg(bench) * 250 / {HORIZON} AS bench
  FROM periods GROUP BY 1, 2),
scored AS (
  SELECT f.factor_id, r.range_name, CAST(greatest(r.day_to - r.day_from, 0) AS BIGINT) AS evaluated_days,
         coalesce(s.valid_ic_days, 0) AS valid_ic_days,
         coalesce(s.valid_ic_days, 0) / CAST(r.day_to - r.day_from AS DOUBLE) AS coverage,
         s.rank_ic, s.ic_mean, s.rank_ic / CASE WHEN s.dev > 1e-12 THEN s.dev ELSE 0.01 END AS icir,
         p.topk, p.bench, coalesce(s.valid_ic_days, 0) > 0
           AND coalesce(s.valid_ic_days, 0) / CAST(r.day_to - r.day_from AS DOUBLE) >= 0.6 AS enough
  FROM (SELECT DISTINCT factor_id FROM daily) f CROSS JOIN ranges r
  LEFT JOIN summary s ON s.factor_id = f.factor_id AND s.range_name = r.range_name
  LEFT JOIN portfolio p ON p.factor_id = f.factor_id AND p.range_name = r.range_name),
evaluated AS (
  SELECT factor_id, range_name, evaluated_days, valid_ic_days, coverage,
         CASE WHEN enough THEN rank_ic ELSE 0.0 END AS rank_ic, CASE WHEN enough THEN ic_mean ELSE 0.0 END AS ic_mean,
         CASE WHEN enough THEN icir ELSE 0.0 END AS icir, CASE WHEN enough THEN topk END AS topk_return,
         CASE WHEN enough THEN bench END AS benchmark_return, CASE WHEN enough THEN topk - bench END AS excess_return,
         CASE WHEN enough THEN 5 * rank_ic + 0.5 * icir + topk - bench END AS fitness,
         coalesce(enough AND rank_ic >= 0.02 AND icir >= 0.3 AND topk - bench > 0, FALSE) AS passed
  FROM scored)
"""
    )


EVALUATED_COLUMNS = """factor_id, range_name, evaluated_days, valid_ic_days, round(coverage, 6) AS coverage,
 round(rank_ic, 5) + 0.0 AS rank_ic, round(ic_mean, 5) + 0.0 AS ic_mean, round(icir, 5) + 0.0 AS icir,
 round(topk_return, 5) AS topk_return, round(benchmark_return, 5) AS benchmark_return,
 round(excess_return, 5) AS excess_return, round(fitness, 5) AS fitness, passed"""
FULL_RANGE = f"SELECT 'full' AS range_name, 0 AS day_from, n_days - {HORIZON} AS day_to, n_days - {HORIZON} AS fwd_to FROM calendar LIMIT 1"


def evaluation(spark: SparkSession, sf_dir: str, ranges: list[ev.DayRange]) -> DataFrame:
    symbols, _ = inputs.universe(sf_dir)
    values = flagship_values(spark, sf_dir)
    return ev.evaluate_ranges(values, ranges, HORIZON, ev.default_top_k(symbols), symbols)


def compared_evaluation(evaluated: DataFrame) -> DataFrame:
    return rounded(evaluated, 5, coverage=6)


@query("evaluate_factor", with_bars(FLAGSHIP_SQL + evaluation_sql(FULL_RANGE) + f"SELECT {EVALUATED_COLUMNS} FROM evaluated"))
def evaluate_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_days = inputs.universe(sf_dir)[1]
    return compared_evaluation(evaluation(spark, sf_dir, [ev.full_range(n_days, HORIZON)]))


_EVAL_WINDOW = FULL_RANGE.replace("'full'", "'recent'").replace("0 AS day_from", f"greatest(0, n_days - {HORIZON} - 60) AS day_from")


@query("evaluate_recent_window", with_bars(FLAGSHIP_SQL + evaluation_sql(_EVAL_WINDOW) + f"SELECT {EVALUATED_COLUMNS} FROM evaluated"))
def evaluate_recent_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_days = inputs.universe(sf_dir)[1]
    return compared_evaluation(evaluation(spark, sf_dir, [ev.full_range(n_days, HORIZON, 60, "recent")]))


OOS_RANGES = f"""
 SELECT range_name, greatest(0, a - {HORIZON}) AS day_from, b - {HORIZON} AS day_to, b - {HORIZON} AS fwd_to FROM (
  SELECT 'train' AS range_name, 0 AS a, CAST(floor(n_days * 0.6) AS INTEGER) AS b FROM (SELECT any_value(n_days) AS n_days FROM calendar)
  UNION ALL SELECT 'validation', CAST(floor(n_days * 0.6) AS INTEGER), CAST(floor(n_days * 0.8) AS INTEGER) FROM (SELECT any_value(n_days) AS n_days FROM calendar)
  UNION ALL SELECT 'test', CAST(floor(n_days * 0.8) AS INTEGER), n_days FROM (SELECT any_value(n_days) AS n_days FROM calendar))"""


@query("oos_three_way", with_bars(FLAGSHIP_SQL + evaluation_sql(OOS_RANGES) + f"SELECT {EVALUATED_COLUMNS} FROM evaluated"))
def oos_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_days = inputs.universe(sf_dir)[1]
    return compared_evaluation(evaluation(spark, sf_dir, ev.oos_ranges(n_days, HORIZON)))


def _won(part: str) -> str:
    return f"coalesce(bool_or(passed) FILTER (WHERE range_name = '{part}'), FALSE)"


@query(
    "oos_verdict",
    with_bars(
        FLAGSHIP_SQL
        + evaluation_sql(OOS_RANGES)
        + f"SELECT factor_id, {_won('validation')} AND {_won('test')} AS passed, list_filter(["
        + ", ".join(f"CASE WHEN NOT {_won(n)} THEN '{n}_failed' END" for n in ("train", "validation", "test"))
        + "], lambda x: x IS NOT NULL) AS failure_reasons FROM evaluated GROUP BY factor_id"
    ),
)
def oos_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_days = inputs.universe(sf_dir)[1]
    return ev.oos_verdict(evaluation(spark, sf_dir, ev.oos_ranges(n_days, HORIZON)))


def brand_month_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query on brand x month bars (enough symbols at the smallest scale)."""
    symbols, n_days = inputs.universe(sf_dir, "p_brand", "month")
    panel = grid.market_panel(inputs.bars(spark, sf_dir, "p_brand", "month"))
    panel = panel.withColumn("fwd", grid.forward_return(HORIZON))
    values = fm.factor_values(panel, FLAGSHIP, symbols, keep=("fwd",))
    return ev.evaluate_ranges(values, [ev.full_range(n_days, HORIZON)], HORIZON, ev.default_top_k(symbols), symbols)
