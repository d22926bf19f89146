"""Metrics of wide histories, from packed columns in parts and blocks, against the operators over long rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelworks.operators import history_metrics as hm
from panelworks.operators import labels as lb
from panelworks.operators import metrics, ranking

NAMES = ("ma5_slope", "percent_b", "bull_cross_5_20", "sos_score", "sow_score", "spring_score")
GROUP_OF = {n: g for g, names in lb.GROUPS.items() for n in names}


def history_frame(spark, n):
    rng = np.random.default_rng(7)
    columns = {"row": np.arange(n)}
    for name in (*NAMES, *lb.PHASES):
        made = [np.round(rng.random(n), 2 if hm.is_event(name) else 6) for _ in range(2)]
        if name == "percent_b":
            made = [np.round(m, 1) - 0.5 for m in made]
        columns[name], columns[f"_p_{name}"] = made
    columns["spring_score"] = np.zeros(n)  # an event without a hit
    gone = {c: rng.random(n) < 0.1 for c in columns if c != "row" and c.removeprefix("_p_") not in lb.PHASES}
    for side in ("", "_p_"):
        missing = rng.random(n) < 0.1
        gone |= {f"{side}{c}": missing for c in lb.PHASES}
    rows = [tuple(int(v[i]) if c == "row" else None if gone[c][i] else float(v[i]) for c, v in columns.items()) for i in range(n)]
    schema = ", ".join(f"`{c}` {'long' if c == 'row' else 'double'}" for c in columns)
    return spark.createDataFrame(rows, schema).repartitionByRange(3, "row").sortWithinPartitions("row")


@pytest.mark.parametrize("n, part_cells, block_rows", [(700, 60, 40), (700, 10**6, 1 << 15), (0, 60, 40)])
def test_history_metrics_equal_those_of_long_rows(spark, monkeypatch, n, part_cells, block_rows):
    monkeypatch.setattr(ranking, "PART_CELLS", part_cells)
    history = history_frame(spark, n)
    cells = [
        F.struct(*[F.lit(v).alias(k) for k, v in (("group", GROUP_OF[c]), ("name", c), ("task", lb.task_type(c)))], F.col(c).alias("target"), F.col(f"_p_{c}").alias("prediction"))
        for c in NAMES
    ]
    long = history.select(F.lpad(F.col("row").cast("string"), 9, "0").alias("row_id"), F.explode(F.array(*cells)).alias("c")).select("row_id", "c.*")
    known = F.col("markup").isNotNull() & F.col("_p_markup").isNotNull()
    phases = history.where(known).select(
        F.col("row").alias("row_id"), F.array(*lb.PHASES).alias("targets"), F.array(*[f"_p_{c}" for c in lb.PHASES]).alias("scores")
    )
    want = {tuple(r[:3]): r.value for r in metrics.grouped_metrics(long, phases, 1000).collect()}
    sums = hm.history_sums(history, NAMES, n, phases=True, block_rows=block_rows)
    got = {tuple(r[:3]): r.value for r in hm.grouped_metrics(sums, NAMES, GROUP_OF).collect()}
    assert got.keys() == want.keys() and (n == 0 or len(got) > 50)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    fewer = hm.grouped_metrics(hm.history_sums(history, NAMES, n, ranked=["percent_b"], phases=True), NAMES, GROUP_OF)
    left = {tuple(r[:3]): r.value for r in fewer.where("name <> 'aggregate'").collect()}
    assert left.keys() == {k for k in want if k[1] != "aggregate" and k[1:] != ("ma5_slope", "spearman")}


def test_rows_are_made_once_and_cells_stay_packed(spark):
    """The sums of a history are one stored row per label; the rows behind them are neither stored nor read again."""
    from panelworks.plans import scoring

    sums = scoring.history_sums(spark, "/root/testdata/sf0.001", NAMES, phases=True)
    assert sums.count() == len(NAMES) + 1 and {r.name for r in sums.select("name").collect()} == {*NAMES, "phase"}
    plan = scoring.label_history(scoring.prepared_bars(spark, "/root/testdata/sf0.001"), NAMES, by_range=True)._jdf.queryExecution().executedPlan().toString()
    tail = plan.split("MapInArrow")[0]
    assert "Exchange" not in tail and "rangepartitioning(symbol" in plan


def test_composite_scores_every_label_of_its_summary(spark, monkeypatch):
    """No figure of the summary is 0 because its labels were not scored, in the query and in its SQL."""
    import __spark_entry__ as registry
    from panelworks.plans import scoring

    seen = {}
    made = scoring.history_sums
    monkeypatch.setattr(scoring, "history_sums", lambda *a, **k: seen.update(names=a[2], ranked=k["ranked"]) or made(*a, **k))
    assert scoring.composite_scores(spark, "/root/testdata/sf0.001").count() == 1
    sql = registry.oracle_sql()["composite_scores"]
    for _, group, names, metric in metrics.SUMMARY_PARTS:
        for name in names if group != "phase" else ():
            assert name in seen["names"] and f"'{name}' AS name" in sql
            assert metric != "spearman" or name in seen["ranked"]
