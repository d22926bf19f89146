"""Content signals, sample indexes and gold records from JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNAL_TIMES = (
    "occurrence_at",
    "business_as_of",
    "knowledge_projection_at",
    "source_available_at",
    "available_from",
    "lifecycle_as_of",
)
SIGNAL_TEXTS = (
    "signal_id",
    "symbol",
    "subject_key",
    "source_availability_quality",
    "sentiment",
    "knowledge_kind",
    "truth_status",
    "source_video_id",
    "producer_commit",
)
SIGNAL_SCORES = ("content_attention_score", "cross_video_consensus", "cross_video_disagreement")
SAMPLE_SCHEMA = "symbol string, start_index int, end_index int, as_of date, split string, quality_ratio double"
GOLD_SCHEMA = (
    "sample_id string, symbol string, as_of string, snapshot_id string, labels map<string,double>, confidence double,"
    " annotator_a string, annotator_b string, annotator_a_labels map<string,double>,"
    " annotator_b_labels map<string,double>, notes string, expected_split string"
)


def read_signals(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(signals, rejected rows) with a fixed schema.

    Strict reading rejects malformed rows, rows without an id and rows whose
    timestamps are missing or carry no time zone; otherwise gaps become NULL.
    """
    text = [*SIGNAL_TEXTS, *SIGNAL_TIMES]
    schema = ", ".join(
        [*[f"{c} string" for c in text], "support_count int", *[f"{c} double" for c in SIGNAL_SCORES], "_broken string"]
    )
    raw = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_broken").json(path)
    zoned = F.lit(True)
    for name in SIGNAL_TIMES:
        zoned = zoned & F.coalesce(F.col(name).rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), F.lit(False))
    problem = F.when(F.col("_broken").isNotNull(), "malformed").when(F.col("signal_id").isNull(), "signal_id_missing")
    if strict:
        problem = problem.when(~zoned, "timestamp_without_zone")
    checked = raw.withColumn("problem", problem)
    times = {name: F.to_utc_timestamp(F.try_to_timestamp(name), F.current_timezone()) for name in SIGNAL_TIMES}
    good = checked.where(F.col("problem").isNull()).withColumns(times).drop("_broken", "problem")
    return good, checked.where(F.col("problem").isNotNull()).select("signal_id", "problem")


def write_samples(samples: DataFrame, path: str) -> None:
    samples.write.mode("errorifexists").partitionBy("split").json(path)


def read_samples(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Sample index; ``test`` is accepted for ``time_test`` and prunes folders."""
    samples = spark.read.schema(SAMPLE_SCHEMA).json(path)
    wanted = "time_test" if split == "test" else split
    return samples if wanted is None else samples.where(F.col("split") == wanted)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold records; a repeated ``sample_id`` fails the read at run time."""
    records = spark.read.schema(GOLD_SCHEMA).json(path)
    repeats = records.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_n"))
    checked = records.join(repeats, "sample_id")
    error = F.raise_error(F.concat(F.lit("duplicate sample_id: "), F.col("sample_id")))
    return checked.withColumn("sample_id", F.when(F.col("_n") == 1, F.col("sample_id")).otherwise(error)).drop("_n")
