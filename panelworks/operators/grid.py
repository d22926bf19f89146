"""Dense ``symbol x calendar`` panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BAR_FIELDS = ("open", "high", "low", "close", "volume", "amount", "turnover")


def calendar(bars: DataFrame) -> DataFrame:
    """Distinct trading dates with their dense 0-based index ``d`` and the total ``n_days``.

    The one unpartitioned window runs over calendar dates only: a century of
    days is under 40 000 rows whatever the size of the bars.
    """
    dates = bars.select("trading_date").distinct()
    everything = Window.partitionBy()
    return dates.select(
        "trading_date",
        (F.row_number().over(everything.orderBy("trading_date")) - 1).alias("d"),
        F.count(F.lit(1)).over(everything).alias("n_days"),
    )


def with_day_index(bars: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Attach ``d`` and ``n_days``; the calendar side is bounded by its date range."""
    return bars.join(F.broadcast(calendar(bars) if days is None else days), "trading_date")


def dense_panel(bars: DataFrame, days: DataFrame | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per symbol and calendar day; cells without a bar hold NULL.

    Each bar is stretched up to the day before the symbol's next bar (the first
    one also backwards to day 0), so the grid needs a single exchange by symbol
    and neither a cross join nor a join back to the bars. Every later
    per-symbol window reuses that exchange.
    """
    days = calendar(bars) if days is None else days
    fields = [name for name in (*BAR_FIELDS, *extra) if name in bars.columns]
    by_day = Window.partitionBy("symbol").orderBy("d")
    # An explicit count: every bar row grows into calendar cells and rolling work
    # after this exchange, so merging its small partitions would starve the tasks.
    tasks = int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = (
        with_day_index(bars, days)
        .repartition(tasks, "symbol")
        .withColumn("_next", F.lead("d").over(by_day))
        .withColumn("_first", F.when(F.lag("d").over(by_day).isNull(), F.lit(0)).otherwise(F.col("d")))
    )
    span = F.sequence(F.col("_first"), F.coalesce(F.col("_next"), F.col("n_days").cast("int")) - 1)
    cells = spans.withColumn("_bar", F.col("d")).withColumn("d", F.explode(span))
    here = F.col("d") == F.col("_bar")
    present = [F.when(here, F.col(name)).alias(name) for name in fields]
    absent = [F.lit(None).cast("double").alias(name) for name in BAR_FIELDS if name not in fields]
    return cells.select("symbol", "d", *present, *absent)


def with_dates(panel: DataFrame, days: DataFrame) -> DataFrame:
    return panel.join(F.broadcast(days.select("d", "trading_date")), "d")


def vwap() -> Column:
    return F.when(F.col("volume") != 0, F.col("amount") / F.col("volume"))


def simple_return() -> Column:
    previous = F.lag("close").over(Window.partitionBy("symbol").orderBy("d"))
    return F.when(previous != 0, F.col("close") / previous - 1)


def market_panel(bars: DataFrame, days: DataFrame | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Dense panel with the derived ``vwap`` and ``ret`` columns."""
    return dense_panel(bars, days, extra).withColumns({"vwap": vwap(), "ret": simple_return()})


def forward_return(horizon: int, price: str = "close") -> Column:
    """Return from a day to ``horizon`` days later; NULL at the calendar's end."""
    ahead = F.lead(price, horizon).over(Window.partitionBy("symbol").orderBy("d"))
    return F.when(F.col(price) != 0, ahead / F.col(price) - 1)
