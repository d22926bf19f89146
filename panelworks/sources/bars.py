"""Bar snapshots on disk, and nested market payloads."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelworks.operators.prepare import content_digest

BAR_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("trading_date", T.DateType()),
        *[T.StructField(n, T.DoubleType()) for n in ("open", "high", "low", "close", "volume", "amount", "turnover")],
    ]
)
STATE_COLUMNS = (
    "is_suspended",
    "is_st",
    "is_star_st",
    "is_delisting",
    "is_limit_up",
    "is_limit_down",
    "st_observed",
    "suspension_observed",
    "limit_observed",
    "delisting_observed",
    "turnover_observed",
    "price_observed",
    "volume_observed",
)
REQUIRED_BARS = ("open", "high", "low", "close", "volume", "amount")


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars of one snapshot with a fixed schema; NaN counts as missing."""
    found = spark.read.parquet(path)
    missing = [f.name for f in BAR_SCHEMA if f.name not in found.columns]
    if missing:
        raise ValueError(f"snapshot is missing columns: {missing}")
    states = [c for c in (*STATE_COLUMNS, "listing_days", "board", "industry") if c in found.columns]
    typed = found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in BAR_SCHEMA], *states)
    doubles = [f.name for f in BAR_SCHEMA if isinstance(f.dataType, T.DoubleType)]
    return typed.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in doubles})


def write_bars(bars: DataFrame, root: str) -> str:
    """Write an immutable snapshot named after its content; returns its id.

    The manifest is written last and commits the snapshot: a folder without one is an unfinished write and is
    written again. A committed snapshot, its files included, must hold the same number of rows.
    """
    spark = bars.sparkSession
    facts = content_digest(bars).first()  # one row
    snapshot_id = f"mds-{facts['digest']}"
    path = f"{root}/{snapshot_id}"
    manifest = read_manifest(spark, root, snapshot_id)
    if manifest is None:
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ordered = bars.repartition(tasks, "symbol").sortWithinPartitions("symbol", "trading_date")
        ordered.write.mode("overwrite").parquet(path)
        facts_of = snapshot_manifest(spark.read.parquet(path), snapshot_id)
        facts_of.coalesce(1).write.mode("errorifexists").parquet(f"{root}/manifests/{snapshot_id}")
        return snapshot_id
    found = {manifest.first()["row_count"], spark.read.parquet(path).count()}
    if found != {facts["row_count"]}:
        raise ValueError(f"snapshot {snapshot_id} exists with {sorted(found)} rows")
    return snapshot_id


def read_manifest(spark: SparkSession, root: str, snapshot_id: str) -> DataFrame | None:
    """The manifest of a committed snapshot, None where there is none."""
    try:
        return spark.read.parquet(f"{root}/manifests/{snapshot_id}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def snapshot_manifest(bars: DataFrame, snapshot_id: str) -> DataFrame:
    """Row count, date range, symbol count and field list of a snapshot."""
    return bars.agg(
        F.lit(snapshot_id).alias("snapshot_id"),
        F.count(F.lit(1)).alias("row_count"),
        F.min("trading_date").alias("min_date"),
        F.max("trading_date").alias("max_date"),
        F.count_distinct("symbol").alias("symbols"),
        F.array(*[F.lit(c) for c in bars.columns]).alias("fields"),
    )


def write_series(series: DataFrame, path: str, buckets: int, table: str) -> None:
    """Per-symbol series bucketed by symbol: later windows read without a shuffle."""
    writer = series.write.mode("errorifexists").format("parquet").option("path", path)
    writer.bucketBy(buckets, "symbol").sortBy("symbol", "trading_date").saveAsTable(table)


def payload_rows(payload: DataFrame) -> DataFrame:
    """Rows from column-oriented payloads ``symbols[], dates[], bars{name: matrix}``.

    ``payload`` has one JSON document per row in column ``body``. A document
    without a required field gives no rows.
    """
    schema = "symbols array<string>, dates array<string>, bars map<string, array<array<double>>>"
    parsed = payload.select(F.from_json("body", schema).alias("p")).select("p.*")
    keys = F.map_keys("bars")
    complete = F.forall(F.array(*[F.lit(n) for n in REQUIRED_BARS]), lambda n: F.array_contains(keys, n))
    names = (*REQUIRED_BARS, "turnover")
    by_symbol = parsed.where(complete).select(
        F.posexplode("symbols").alias("i", "symbol"), "dates", F.col("bars").alias("bars")
    )
    lines = by_symbol.select(
        "symbol",
        F.posexplode("dates").alias("j", "date"),
        *[F.try_element_at(F.try_element_at("bars", F.lit(n)), F.col("i") + 1).alias(n) for n in names],
    )
    return lines.select(
        "symbol",
        F.to_date("date").alias("trading_date"),
        *[F.try_element_at(n, F.col("j") + 1).alias(n) for n in names],
    )
