"""Bars, panels and evidence tables derived from the given tables.

The given tables hold no market data: bars are weekly aggregates of line items
per supplier, share capital is a quarterly aggregate, and signals are events.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.operators import grid
from panelworks.operators.asof import attach_turnover

HORIZON = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, symbol: str = "l_suppkey", period: str = "week") -> DataFrame:
    """OHLCV bars: partial aggregation per (symbol, period) before the shuffle."""
    items = table(spark, sf_dir, "lineitem")
    if symbol == "p_brand":
        # parts are joined by key without a hint: the planner sizes the side
        items = items.join(
            table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")
        )
    # One number in the order (l_shipdate, l_orderkey, l_linenumber, l_partkey): a
    # fixed-width key keeps the aggregation hash-based, a struct would make it sort.
    day = F.datediff("l_shipdate", F.lit("1970-01-01")).cast("decimal(5,0)")
    part = F.col("l_linenumber").cast("decimal(3,0)") * F.lit(10**12).cast("decimal(13,0)") + F.col("l_partkey")
    moment = (day * F.lit(10**12).cast("decimal(13,0)") + F.col("l_orderkey")).cast("decimal(18,0)") * F.lit(
        10**15
    ).cast("decimal(16,0)") + part.cast("decimal(16,0)")
    return (
        items.withColumn("_price", F.col("l_extendedprice") / F.col("l_quantity"))
        .groupBy(F.col(symbol).alias("symbol"), F.date_trunc(period, "l_shipdate").cast("date").alias("trading_date"))
        .agg(
            F.min_by("_price", moment).alias("open"),
            F.max("_price").alias("high"),
            F.min("_price").alias("low"),
            F.max_by("_price", moment).alias("close"),
            F.sum("l_quantity").alias("volume"),
            F.sum("l_extendedprice").alias("amount"),
        )
    )


def capital(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circulating capital announced on the first day of the next quarter."""
    quarter = F.date_trunc("quarter", "l_shipdate").cast("date")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("symbol"), F.add_months(quarter, 3).alias("announce_date"))
        .agg((10 * F.sum("l_quantity")).alias("circulating_capital"))
    )


def bars_with_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attach_turnover(bars(spark, sf_dir), capital(spark, sf_dir))


_COUNTS: dict[tuple, object] = {}


def forget_counts() -> None:
    """Count again at the next use (timings that include the counting)."""
    _COUNTS.clear()


def counted(*names: str) -> Callable:
    """Remember a count of the named tables for as long as their files stay the same."""

    def remember(count: Callable) -> Callable:
        @wraps(count)
        def known(sf_dir: str, *more: str):
            files = []
            for name in names:
                facts = table(_session(), sf_dir, name).select(
                    "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time"
                )
                files += sorted(map(tuple, facts.distinct().collect()))  # one row per file
            key = (count.__name__, sf_dir, more, tuple(files))
            if key not in _COUNTS:
                _COUNTS[key] = count(sf_dir, *more)
            return _COUNTS[key]

        return known

    return remember


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


@counted("lineitem", "part")
def universe(sf_dir: str, symbol: str = "l_suppkey", period: str = "week") -> tuple[int, int]:
    """(symbols, calendar days): two counts that bound every later group."""
    spark = _session()
    items = table(spark, sf_dir, "lineitem")
    if symbol == "p_brand":
        items = items.join(
            table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")
        )
    symbols = items.select(symbol).distinct().count()
    days = items.select(F.date_trunc(period, "l_shipdate")).distinct().count()
    return symbols, days


def panel(spark: SparkSession, sf_dir: str, horizon: int | None = HORIZON, turnover: bool = False) -> DataFrame:
    """Dense market panel; ``fwd`` is the forward return over ``horizon`` days."""
    source = bars_with_turnover(spark, sf_dir) if turnover else bars(spark, sf_dir)
    dense = grid.market_panel(source)
    return dense if horizon is None else dense.withColumn("fwd", grid.forward_return(horizon))


# --- the same tables for the checking SQL ----------------------------------------------

BARS_SQL = """
bars AS (
  SELECT l_suppkey AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS trading_date,
         arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close,
         sum(l_quantity) AS volume, sum(l_extendedprice) AS amount
  FROM (SELECT *, l_extendedprice / l_quantity AS p,
               row(l_shipdate, l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem)
  GROUP BY 1, 2),
capital AS (
  SELECT l_suppkey AS symbol, CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH AS DATE) AS announce_date,
         10 * sum(l_quantity) AS circulating_capital
  FROM lineitem GROUP BY 1, 2),
tbars AS (
  SELECT b.*, coalesce(b.volume / c.circulating_capital, 0.0) AS turnover,
         CAST(CASE WHEN c.circulating_capital IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS turnover_observed
  FROM bars b ASOF LEFT JOIN capital c ON b.symbol = c.symbol AND b.trading_date >= c.announce_date),
calendar AS (
  SELECT trading_date, CAST(row_number() OVER (ORDER BY trading_date) - 1 AS INTEGER) AS d,
         count(*) OVER () AS n_days
  FROM (SELECT DISTINCT trading_date FROM bars)),
cells AS (
  SELECT s.symbol, c.d, c.n_days, c.trading_date, b.open, b.high, b.low, b.close, b.volume, b.amount, b.turnover
  FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN calendar c
  LEFT JOIN tbars b ON b.symbol = s.symbol AND b.trading_date = c.trading_date),
panel AS (
  SELECT *, CASE WHEN volume <> 0 THEN amount / volume END AS vwap,
         close / nullif(lag(close) OVER s, 0) - 1 AS ret,
         lead(close, 5) OVER s / nullif(close, 0) - 1 AS fwd
  FROM cells WINDOW s AS (PARTITION BY symbol ORDER BY d))
"""


def with_bars(body: str) -> str:
    """Prefix a SELECT (or further CTEs) with the bars, calendar and panel tables."""
    return f"WITH {BARS_SQL.strip()}\n{body.strip()}"


@counted("events")
def users(sf_dir: str) -> int:
    """Distinct users: the largest cross-section of the signal panel."""
    return table(_session(), sf_dir, "events").select("user_id").distinct().count()


@counted("events")
def event_rows(sf_dir: str) -> int:
    return table(_session(), sf_dir, "events").count()


@counted("lineitem")
def bar_rows(sf_dir: str) -> int:
    """Number of bars (filled cells of the grid)."""
    items = table(_session(), sf_dir, "lineitem")
    return items.select("l_suppkey", F.date_trunc("week", "l_shipdate")).distinct().count()


@counted("embeddings")
def embedding_rows(sf_dir: str) -> int:
    return table(_session(), sf_dir, "embeddings").count()
