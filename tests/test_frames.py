"""Frames computed in batches against Spark's own windows, bit by bit."""

import math
import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelworks.functions.frames import Frame, positioned, with_frames
from panelworks.functions.rolling import Rolling
from panelworks.operators.features import build_features
from panelworks.operators.labels import build_labels

SF_DIR = "/root/testdata/sf0.001"


def _rows():
    draw = random.Random(5)
    sizes = {None: 4, 1: 1, 2: 33, 3: 60, 4: 8}
    return [
        (k, d, draw.choice([None, 0.0, 0.1, 1 / 3, math.nan, draw.uniform(-1e6, 1e6), draw.gauss(0, 1)]))
        for k, n in sizes.items()
        for d in range(n)
    ]


def test_frames_equal_spark_windows_over_batches(spark):
    df = spark.createDataFrame(_rows(), "symbol int, trading_date int, x double")
    at, w = positioned(df, ["symbol"], "trading_date", "at"), Rolling()
    frames = {
        "mean": Frame("mean", "x", 5, 2),
        "whole": Frame("mean", "x", 9),
        "std": Frame("std", "x", 6, 1),
        "sum": Frame("sum", "x", 7, 3),
        "max": Frame("max", "x", 4, 1, back=1),
        "min": Frame("min", "x", 4, 1, back=1),
        "lag": Frame("lag", "x", 11),
        "since": Frame("since", "x", 6),
        "place": Frame("percentile", "x", 3),
    }
    x = F.col("x")
    plain = {
        "mean": w.mean(x, 5, 2),
        "whole": w.mean(x, 9),
        "std": w.std(x, 6, 1),
        "sum": w.sum(x, 7, 3),
        "max": w.max_before(x, 4, 1),
        "min": w.min_before(x, 4, 1),
        "lag": w.lag(x, 11),
        "since": w.rows_since(x > 0, F.col("at"), 6).cast("double"),
        "place": w.percentile(x, 3),
    }
    order = Window.partitionBy("symbol").orderBy("trading_date")
    wanted = df.withColumn("at", F.row_number().over(order)).withColumns(plain)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(map(repr, with_frames(at, "at", frames).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == sorted(map(repr, wanted.collect()))


def test_percentile_frame(spark):
    values = [3.0, 1.0, 2.0, 2.0, None, 5.0, 2.0, 4.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "symbol int, trading_date int, x double")
    made = with_frames(positioned(df, ["symbol"], "trading_date", "at"), "at", {"p": Frame("percentile", "x", 3)})
    assert [r.p for r in made.orderBy("at").collect()] == [None, None, 2 / 3, 2.5 / 3, None, None, None, 2 / 3]


def test_no_moving_window_is_left_to_spark(spark):
    """Spark adds up each row of a moving frame anew: features and labels have none."""
    names = ("open", "high", "low", "close", "volume", "amount", "turnover")
    bars = spark.range(4).select(
        F.col("id").alias("symbol"), F.current_date().alias("trading_date"), *[F.rand().alias(n) for n in names]
    )
    for build in (build_features, build_labels):
        plan = build(bars)._jdf.queryExecution().optimizedPlan().toString()
        assert "RowFrame, -" not in plan.replace("RowFrame, -1, -1", "") and "MapInArrow" in plan


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables are not here")
@pytest.mark.parametrize("name", ["regression_metrics", "event_metrics"])
def test_metrics_read_labels_made_once(spark, name):
    """The metrics read their rows several times: from a stored table, not from the line items anew."""
    import __spark_entry__ as registry

    files = registry.queries()[name](spark, SF_DIR).inputFiles()
    assert files and not [f for f in files if "lineitem" in f]
