"""Readers and writers on small files."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from panelworks.operators import audits, content, prepare
from panelworks.sources import bars as bar_source
from panelworks.sources import signals as signal_source


def some_bars(spark, n=4):
    rows = [(f"S{i % 2}", date(2024, 1, 1 + i), 1.0, 2.0, 0.5, 1.5, 10.0 + i, 15.0, 0.1) for i in range(n)]
    return spark.createDataFrame(rows, bar_source.BAR_SCHEMA)


def test_snapshot_round_trip(spark, tmp_path):
    bars = some_bars(spark)
    name = bar_source.write_bars(bars, str(tmp_path))
    assert bar_source.write_bars(bars.orderBy(F.desc("volume")), str(tmp_path)) == name
    assert bar_source.write_bars(bars.withColumn("close", F.lit(9.0)), str(tmp_path)) != name
    back = bar_source.read_bars(spark, f"{tmp_path}/{name}")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, bars.collect()))
    manifest = bar_source.snapshot_manifest(back, name).first()
    assert (manifest.row_count, manifest.symbols) == (4, 2)


def test_digest_sees_every_cell(spark):
    bars = some_bars(spark)
    one = prepare.content_digest(bars).first()
    assert one == prepare.content_digest(bars.repartition(3)).first()
    assert one != prepare.content_digest(bars.withColumn("volume", F.col("volume") + F.when(F.col("symbol") == "S0", 1).otherwise(0))).first()


def test_payload_rows(spark):
    matrix = [[1.0, 2.0], [3.0, None]]
    fields = {n: matrix for n in bar_source.REQUIRED_BARS}
    good = json.dumps({"symbols": ["A", "B"], "dates": ["2024-01-01", "2024-01-02"], "bars": fields})
    bad = json.dumps({"symbols": ["A"], "dates": ["2024-01-01"], "bars": {"open": [[1.0]]}})
    rows = bar_source.payload_rows(spark.createDataFrame([(good,), (bad,)], "body string")).orderBy("symbol", "trading_date").collect()
    assert [(r.symbol, r.trading_date.day, r.close, r.turnover) for r in rows] == [
        ("A", 1, 1.0, None),
        ("A", 2, 2.0, None),
        ("B", 1, 3.0, None),
        ("B", 2, None, None),
    ]


def signal(i, zone="+00:00", **extra):
    times = {name: f"2024-01-0{i}T00:00:00{zone}" for name in signal_source.SIGNAL_TIMES}
    return json.dumps({"signal_id": f"s{i}", "symbol": "600519", "support_count": 2, **times, **extra})


def test_signal_reading_is_strict(spark, tmp_path):
    path = tmp_path / "signals.json"
    path.write_text("\n".join([signal(1), signal(2, zone=""), "{broken", signal(3, zone="+08:00")]))
    good, bad = signal_source.read_signals(spark, str(path))
    rows = {r.signal_id: r for r in good.collect()}
    assert set(rows) == {"s1", "s3"}
    assert rows["s3"].available_from.hour == 16  # midnight at UTC+8
    assert sorted(r.problem for r in bad.collect()) == ["malformed", "timestamp_without_zone"]
    loose, _ = signal_source.read_signals(spark, str(path), strict=False)
    assert {r.signal_id for r in loose.collect()} == {"s1", "s2", "s3"}


def test_samples_and_gold(spark, tmp_path):
    rows = [("A", 0, 127, date(2024, 1, 1), "train", 1.0), ("B", 5, 132, date(2024, 1, 2), "time_test", 0.9)]
    signal_source.write_samples(spark.createDataFrame(rows, signal_source.SAMPLE_SCHEMA), str(tmp_path / "samples"))
    assert [r.symbol for r in signal_source.read_samples(spark, str(tmp_path / "samples"), "test").collect()] == ["B"]
    gold = tmp_path / "gold.json"
    record = {"sample_id": "g1", "symbol": "A", "as_of": "2024-01-01", "labels": {"sc": 1}, "annotator_a_labels": {"sc": 1}, "annotator_b_labels": {"sc": 0}}
    gold.write_text(json.dumps(record))
    pairs = audits.annotator_pairs(signal_source.read_gold(spark, str(gold))).collect()
    assert [tuple(p) for p in pairs] == [("sc", 1, 0)]
    gold.write_text("\n".join([json.dumps(record)] * 2))
    with pytest.raises(Exception, match="duplicate sample_id"):
        signal_source.read_gold(spark, str(gold)).collect()


def test_signals_turn_visible_at_the_cutoff(spark):
    from datetime import datetime

    rows = [("a", datetime(2024, 1, 1, 1, 25)), ("b", datetime(2024, 1, 1, 1, 26))]
    signals = spark.createDataFrame(rows, "signal_id string, available_from timestamp_ntz").withColumn("symbol", F.lit("US.X"))
    days = spark.createDataFrame([(date(2024, 1, 1 + i), i) for i in range(10)], "trading_date date, d int")
    seen = {}
    for r in content.visible_cells(signals, days).collect():
        seen.setdefault(r.signal_id, set()).add(r.d)
    assert seen == {"a": {0, 1, 2, 3, 4, 5}, "b": {1, 2, 3, 4, 5}}


def test_features_fold_signals_before_their_days(spark):
    from datetime import datetime, timedelta

    rows = []
    for i in range(400):
        at = datetime(2024, 1, 1) + timedelta(hours=(i * 7) % 200)
        uid, source = (f"u{i % 3}" if i % 5 else None), (None, "", "v1", "v2", "u1")[i % 5]
        mood = ("BULLISH", "BEARISH", "NEUTRAL", None)[(i // 3) % 4]
        score = float(i) if i % 4 == 0 else None
        given = 1.0 if i % 97 == 0 else None
        review = "REJECTED" if i % 11 == 0 else None
        rows.append((f"s{i}", f"US.{i % 2}", at, uid, source, ("A", "B", "", None)[(i // 7) % 4], mood, "FACT", "EXTERNALLY_VERIFIED", score, given, review))
    schema = (
        "signal_id string, symbol string, available_from timestamp_ntz, knowledge_uid string, source_video_id string, subject string,"
        " sentiment string, knowledge_kind string, truth_status string, content_attention_score double, cross_video_consensus double, review_status string"
    )
    signals = spark.createDataFrame(rows, schema)
    days = spark.createDataFrame([(date(2024, 1, 1 + i), i) for i in range(0, 15, 2)], "trading_date date, d int")
    want = content.content_features(content.visible_cells(signals, days)).sort("symbol", "d").collect()
    made = content.visible_features(signals, days, 50 * content.SIGNALS_PER_TASK)
    assert len(want) > 8 and made.sort("symbol", "d").collect() == want
    plan = made._jdf.queryExecution().executedPlan().toString()
    # tasks follow the number of signals, and no aggregate stands before the first exchange of the scan
    assert "hashpartitioning(symbol" in plan and plan.count(", 50), REPARTITION_BY_NUM") >= 2
    assert plan.count("Scan ExistingRDD[signal_id") == 1


def test_unfinished_and_damaged_snapshots(spark, tmp_path):
    bars, root = some_bars(spark), str(tmp_path)
    name = f"mds-{prepare.content_digest(bars).first()['digest']}"
    bars.limit(1).write.parquet(f"{root}/{name}")  # a writer that died before its manifest
    assert bar_source.read_manifest(spark, root, name) is None
    assert bar_source.write_bars(bars, root) == name
    assert bar_source.read_bars(spark, f"{root}/{name}").count() == 4
    assert bar_source.read_manifest(spark, root, name).first()["row_count"] == 4
    bars.limit(2).write.mode("append").parquet(f"{root}/{name}")  # committed, then changed
    with pytest.raises(ValueError, match="exists with"):
        bar_source.write_bars(bars, root)


def test_bucketed_series_are_windowed_without_an_exchange(spark, tmp_path):
    rows = [(f"S{i % 7}", date(2024, 1, 1 + i % 28), float(i)) for i in range(100)]
    series = spark.createDataFrame(rows, "symbol string, trading_date date, close double")
    name = f"series_{tmp_path.name.replace('-', '_')}"
    bar_source.write_series(series, str(tmp_path / "series"), 4, name)
    try:
        windows = "sum(close) OVER (PARTITION BY symbol ORDER BY trading_date, close ROWS 5 PRECEDING) AS total"
        back = spark.table(name).selectExpr("symbol", "trading_date", "close", windows)
        plan = back._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
        expected = series.selectExpr("symbol", "trading_date", "close", windows)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, expected.collect()))
    finally:
        spark.sql(f"DROP TABLE {name}")
