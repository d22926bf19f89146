"""Prediction metrics, neighbours and probes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.functions import scalar
from panelworks.functions.frames import Frame, with_frames
from panelworks.operators import dataset, metrics, neighbors
from panelworks.operators import history_metrics as hm
from panelworks.operators import labels as lb
from panelworks.plans import inputs
from panelworks.plans.inputs import with_bars
from panelworks.plans.learning import LABELS_SQL, drawn_symbols
from panelworks.plans.registry import query, rounded
from panelworks.plans.signals import prepared_bars
from panelworks.session import stored

_NAMES = ("ma5_slope", "bull_alignment_score", "compression_score", "percent_b", "squeeze_score", "trend_direction", "bull_cross_5_20", "sos_score", "sow_score")
_GROUP_OF = {name: group for group, names in lb.GROUPS.items() for name in names}


def label_history(bars: DataFrame, names: Sequence[str], by_range: bool = False) -> DataFrame:
    """Labels and their previous values (``_p_`` names) on the ordered bars; ``by_range`` also orders the partitions."""
    made = lb.build_labels(bars.repartitionByRange("symbol") if by_range else bars, keep=["_row"], names=names)
    return with_frames(made, "_row", {f"_p_{n}": Frame("lag", n, 1) for n in names})


def history_sums(spark: SparkSession, sf_dir: str, names: Sequence[str], phases: bool = False, ranked: Sequence[str] | None = None) -> DataFrame:
    """Sums of the persistence baseline: each label predicted by its previous value."""
    taken = ("high", "low", "close", "volume", "turnover", "turnover_observed")
    bars = stored(prepared_bars(spark, sf_dir).select("symbol", "trading_date", *taken))
    wanted = [*names, *(lb.PHASES if phases else ())]
    drawn = label_history(drawn_symbols(bars), wanted)
    return hm.history_sums(label_history(bars, wanted, by_range=True), names, inputs.bar_rows(sf_dir), drawn, ranked, phases)


def _of_task(binary: bool) -> list[str]:
    return [n for n in _NAMES if (lb.task_type(n) == "binary_event") == binary]


def scored_sql(names: Sequence[str]) -> str:
    """Targets and predictions of the named labels, long."""
    return (
        LABELS_SQL
        + ", sc AS ("
        + " UNION ALL ".join(
            f"SELECT lpad(CAST(symbol AS VARCHAR), 12, '0') || '|' || trading_date AS row_id, '{_GROUP_OF[n]}' AS grp, '{n}' AS name, '{lb.task_type(n)}' AS task,"
            f" {n}::DOUBLE AS t, lag({n}::DOUBLE) OVER (PARTITION BY symbol ORDER BY trading_date) AS p FROM labs"
            for n in names
        )
        + "), ok AS (SELECT * FROM sc WHERE t IS NOT NULL AND p IS NOT NULL)"
    )


SCORED_SQL = scored_sql(_NAMES)
_REGRESSION_SQL = """
, rk AS (SELECT *, rank() OVER (PARTITION BY name ORDER BY t) + (count(*) OVER (PARTITION BY name, t) - 1) / 2.0::DOUBLE AS rt,
  rank() OVER (PARTITION BY name ORDER BY p) + (count(*) OVER (PARTITION BY name, p) - 1) / 2.0::DOUBLE AS rp FROM ok WHERE task <> 'binary_event'),
reg AS (SELECT grp, name, avg(abs(p - t)) AS mae, sqrt(avg((p - t) * (p - t))) AS rmse, corr(p, t) AS pearson, corr(rp, rt) AS spearman,
  avg(CASE WHEN sign(p) = sign(t) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS sign_accuracy, count(*) AS valid_count FROM rk GROUP BY 1, 2)
"""
_BINS = " + ".join(f"CASE WHEN p >= {i * 0.1!r}::DOUBLE THEN 1 ELSE 0 END" for i in range(1, 10))
_EVENT_SQL = f"""
, ev AS (SELECT *, t > 0.5 AS y, row_number() OVER (PARTITION BY name ORDER BY p DESC, row_id) AS r, count(*) OVER (PARTITION BY name) AS n,
  count(*) FILTER (WHERE t > 0.5) OVER (PARTITION BY name ORDER BY p DESC, row_id ROWS UNBOUNDED PRECEDING) AS tp, {_BINS} AS b FROM ok WHERE task = 'binary_event'),
ece AS (SELECT name, sum(n * g) / sum(n) AS ece FROM (SELECT name, b, count(*) AS n, abs(avg(t) - avg(p)) AS g FROM ev GROUP BY 1, 2) GROUP BY 1),
e0 AS (SELECT grp, name, count(*) AS valid_count, count(*) FILTER (WHERE y) AS pos, coalesce(sum(tp / r::DOUBLE) FILTER (WHERE y), 0) AS area, (count(*) FILTER (WHERE y AND p >= 0.5))::DOUBLE AS a,
  (count(*) FILTER (WHERE NOT y AND p >= 0.5))::DOUBLE AS f, (count(*) FILTER (WHERE y AND p < 0.5))::DOUBLE AS m,
  avg(CASE WHEN y THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE r <= greatest(1, ceil(n * 0.01))) AS precision_at_top1pct,
  avg(CASE WHEN y THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE r <= greatest(1, ceil(n * 0.05))) AS precision_at_top5pct FROM ev GROUP BY 1, 2),
e1 AS (SELECT *, CASE WHEN pos > 0 THEN area / pos ELSE 0.0 END AS pr_auc, pos / valid_count::DOUBLE AS prevalence, a / greatest(a + f, 1.0) AS pr, a / greatest(a + m, 1.0) AS rc FROM e0),
evm AS (SELECT grp, e1.name, pr_auc, prevalence, pr_auc / greatest(prevalence, 1e-12) AS pr_auc_multiple_of_prevalence, least(pr_auc / greatest(prevalence, 1e-4), 10.0) / 10 AS relative_pr,
  pr AS precision, rc AS recall, 2 * pr * rc / greatest(pr + rc, 1e-12) AS f1, precision_at_top1pct, precision_at_top5pct, valid_count, ece FROM e1 JOIN ece USING (name))
"""
_REG = ("mae", "rmse", "pearson", "spearman", "sign_accuracy")


@query(
    "regression_metrics",
    with_bars(SCORED_SQL + _REGRESSION_SQL + 'SELECT grp AS "group", name, ' + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _REG) + ", valid_count FROM reg"),
)
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _of_task(binary=False)
    return rounded(hm.regression_rows(history_sums(spark, sf_dir, names), names, _GROUP_OF))


_EVENT_COLUMNS = (*metrics.EVENT_FIELDS, "prevalence")


@query(
    "event_metrics",
    with_bars(SCORED_SQL + _EVENT_SQL + 'SELECT grp AS "group", name, ' + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _EVENT_COLUMNS) + ", valid_count FROM evm"),
)
def event_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _of_task(binary=True)
    return rounded(hm.event_rows(history_sums(spark, sf_dir, names), names, _GROUP_OF))


def phase_rows(pairs: DataFrame) -> DataFrame:
    """Target and score arrays of the rows of a label history whose phases are all valid."""
    known = F.col("markup").isNotNull() & F.col("_p_markup").isNotNull()
    return pairs.where(known).select(
        "symbol",
        "trading_date",
        F.array(*lb.PHASES).alias("targets"),
        F.array(*[F.col(f"_p_{n}") for n in lb.PHASES]).alias("scores"),
    )


def _each(expression: str) -> str:
    return "(" + " + ".join(expression.replace("#", str(i)) for i in range(1, 6)) + ")"


_PHASE_CTES = (
    ", ph AS (SELECT symbol, trading_date, "
    + ", ".join(f"{n} AS t{i}, lag({n}) OVER s AS q{i}" for i, n in enumerate(lb.PHASES, 1))
    + " FROM labs WINDOW s AS (PARTITION BY symbol ORDER BY trading_date)), "
    + "a0 AS (SELECT *, greatest(q1, q2, q3, q4, q5) AS mq FROM ph WHERE t2 IS NOT NULL AND q2 IS NOT NULL), "
    + f"a1 AS (SELECT *, {', '.join(f'exp(q{i} - mq) / ' + _each('exp(q# - mq)') + f' AS p{i}, t{i} / ' + _each('t#') + f' AS y{i}' for i in range(1, 6))} FROM a0), "
    + f"a2 AS (SELECT *, -{_each('y# * ln(greatest(p#, 1e-12))')} AS ce, {_each('y# * ln(greatest(y#, 1e-12) / greatest(p#, 1e-12))')} AS kl,"
    + f" 0.5 * {_each('y# * ln(greatest(y#, 1e-12) / greatest((y# + p#) / 2, 1e-12))')} + 0.5 * {_each('p# * ln(greatest(p#, 1e-12) / greatest((y# + p#) / 2, 1e-12))')} AS js,"
    + f" {_each('(p# - y#) * (p# - y#)')} AS br, list_position([y1, y2, y3, y4, y5], greatest(y1, y2, y3, y4, y5)) - 1 AS act,"
    + " list_position([p1, p2, p3, p4, p5], greatest(p1, p2, p3, p4, p5)) - 1 AS prd, greatest(p1, p2, p3, p4, p5) AS p FROM a1)"
)
_PHASE_SQL = LABELS_SQL + _PHASE_CTES
_PHASE_FIGURES = f""", ec AS (SELECT sum(n * g) / sum(n) AS ece FROM (SELECT b, count(*) AS n, abs(avg(h) - avg(p)) AS g FROM (SELECT p, CASE WHEN act = prd THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS h, {_BINS} AS b FROM a2) GROUP BY 1)),
f1 AS (SELECT avg(2 * pr * rc / greatest(pr + rc, 1e-12)) AS macro_f1 FROM (SELECT k, (SELECT count(*) FROM a2 WHERE act = k AND prd = k) / greatest((SELECT count(*) FROM a2 WHERE prd = k), 1)::DOUBLE AS pr,
  (SELECT count(*) FROM a2 WHERE act = k AND prd = k) / greatest((SELECT count(*) FROM a2 WHERE act = k), 1)::DOUBLE AS rc FROM (SELECT unnest(range(5)) AS k))),
pm AS (SELECT avg(ce) AS soft_ce, avg(kl) AS kl_divergence, avg(js) AS js_divergence, avg(br) AS brier_score, any_value(ece) AS ece, any_value(macro_f1) AS macro_f1 FROM a2, ec, f1)"""
_PHASE_METRICS = ("soft_ce", "kl_divergence", "js_divergence", "brier_score", "ece", "macro_f1")


_LONG_SQL = (
    ", lg AS ("
    + " UNION ALL ".join(f"SELECT grp, name, '{c}' AS metric, {c}::DOUBLE AS value FROM reg" for c in _REG)
    + " UNION ALL "
    + " UNION ALL ".join(f"SELECT grp, name, '{c}' AS metric, {c}::DOUBLE AS value FROM evm" for c in metrics.EVENT_FIELDS)
    + ")"
    + _PHASE_CTES
    + _PHASE_FIGURES
    + ", al AS (SELECT * FROM lg UNION ALL SELECT grp, 'aggregate', metric, avg(value) FROM lg GROUP BY 1, 3 UNION ALL "
    + " UNION ALL ".join(f"SELECT 'phase', 'aggregate', '{c}', {c}::DOUBLE FROM pm" for c in _PHASE_METRICS)
    + ")"
)


@query(
    "grouped_metrics",
    with_bars(SCORED_SQL + _REGRESSION_SQL + _EVENT_SQL + _LONG_SQL + 'SELECT grp AS "group", name, metric, round(value, 6) + 0.0 AS value FROM al'),
)
def grouped_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hm.grouped_metrics(history_sums(spark, sf_dir, _NAMES, phases=True), _NAMES, _GROUP_OF))


def _figure(out: str, group: str, names: str, metric: str) -> str:
    return f"coalesce(avg(value) FILTER (WHERE grp = '{group}' AND name IN ({names}) AND metric = '{metric}'), 0) AS {out}"


_SLOPES = "'ma5_slope', 'ma10_slope', 'ma20_slope', 'ma30_slope', 'ma60_slope', 'ma120_slope'"
_EVENTS = "'sc_score', 'bc_score', 'spring_score', 'upthrust_score', 'sos_score', 'sow_score'"
_PRIMITIVES = "'trend_direction', 'wyckoff_trend_strength', 'trading_range_score', 'support_distance', 'resistance_distance', 'breakout_strength', 'breakdown_strength', 'false_breakout_score', 'effort_result_divergence'"
_COMPOSITE_SQL = (
    ", sm AS (SELECT "
    + ", ".join(
        [
            _figure("slope_r", "ma", _SLOPES, "pearson"),
            _figure("slope_s", "ma", _SLOPES, "sign_accuracy"),
            _figure("align", "ma", "'bull_alignment_score', 'bear_alignment_score'", "spearman"),
            _figure("tight", "ma", "'compression_score'", "pearson"),
            _figure("pb", "bollinger", "'percent_b'", "pearson"),
            _figure("bz", "bollinger", "'boll_zscore'", "pearson"),
            _figure("bw", "bollinger", "'bandwidth'", "pearson"),
            _figure("sq", "bollinger", "'squeeze_score'", "spearman"),
            _figure("ex", "bollinger", "'boll_expansion_score'", "spearman"),
            _figure("primitive", "wyckoff_primitives", _PRIMITIVES, "spearman"),
            _figure("pf", "phase", "'aggregate'", "macro_f1"),
            _figure("pj", "phase", "'aggregate'", "js_divergence"),
            _figure("pe", "phase", "'aggregate'", "ece"),
            _figure("er", "events", _EVENTS, "relative_pr"),
            _figure("ef", "events", _EVENTS, "f1"),
            _figure("e1", "events", _EVENTS, "precision_at_top1pct"),
            _figure("e5", "events", _EVENTS, "precision_at_top5pct"),
        ]
    )
    + """ FROM al), cp AS (SELECT 0.40 * slope_r + 0.30 * slope_s + 0.15 * align + 0.15 * tight AS ma,
  0.30 * pb + 0.25 * bz + 0.20 * bw + 0.15 * sq + 0.10 * ex AS boll, primitive,
  0.60 * pf + 0.20 * (1 - least(greatest(pj / ln(2), 0), 1)) + 0.20 * (1 - least(greatest(pe, 0), 1)) AS phase,
  0.60 * er + 0.20 * ef + 0.10 * e1 + 0.10 * e5 AS event FROM sm)"""
)
_COMPOSITE_COLUMNS = ("ma", "boll", "primitive", "phase", "event")
# every label that a figure of the summary reads, and those whose ranks one reads
_SUMMARIZED = tuple(dict.fromkeys(n for _, group, names, _ in metrics.SUMMARY_PARTS if group != "phase" for n in names))
_RANKED = tuple(n for _, _, names, metric in metrics.SUMMARY_PARTS if metric == "spearman" for n in names)


@query(
    "composite_scores",
    with_bars(
        scored_sql(_SUMMARIZED)
        + _REGRESSION_SQL
        + _EVENT_SQL
        + _LONG_SQL
        + _COMPOSITE_SQL
        + "SELECT "
        + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _COMPOSITE_COLUMNS)
        + """, round(0.20 * ma + 0.20 * boll + 0.25 * primitive + 0.15 * phase + 0.20 * event, 6) + 0.0 AS composite,
 round(0.50 * ma + 0.50 * boll, 6) + 0.0 AS select_ma_bollinger, round(0.20 * ma + 0.20 * boll + 0.60 * primitive, 6) + 0.0 AS select_wyckoff_primitives,
 round(0.10 * ma + 0.10 * boll + 0.20 * primitive + 0.25 * phase + 0.35 * event, 6) + 0.0 AS select_wyckoff_phase_events"""
        + " FROM cp"
    ),
)
def composite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = history_sums(spark, sf_dir, _SUMMARIZED, phases=True, ranked=_RANKED)
    long = hm.grouped_metrics(sums, _SUMMARIZED, _GROUP_OF)
    scored = metrics.composite_scores(metrics.metric_summary(long))
    stages = [f"select_{stage}" for stage in metrics.STAGES]
    return rounded(scored.select(*_COMPOSITE_COLUMNS, "composite", *stages))


@query(
    "soft_phase_metrics",
    with_bars(
        _PHASE_SQL + _PHASE_FIGURES + "SELECT " + ", ".join(f"round({c}, 6) AS {c}" for c in _PHASE_METRICS) + " FROM pm"
    ),
)
def soft_phase_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hm.phase_row(history_sums(spark, sf_dir, (), phases=True)))


@query(
    "phase_confusion",
    with_bars(_PHASE_SQL + "SELECT CAST(act AS INTEGER) AS actual, CAST(prd AS INTEGER) AS predicted, count(*) AS n FROM a2 GROUP BY 1, 2"),
)
def phase_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(metrics.soft_rows(phase_rows(label_history(prepared_bars(spark, sf_dir), lb.PHASES))))


@query(
    "event_weights",
    """SELECT event, round(least(greatest((count(*) - sum(v)) / greatest(sum(v), 1), 1), 20), 6) AS weight
FROM (SELECT 'quality' AS event, quality::DOUBLE AS v FROM labels UNION ALL SELECT 'toxic', toxic::DOUBLE FROM labels) GROUP BY 1""",
)
def event_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = inputs.table(spark, sf_dir, "labels").unpivot("doc_id", ["quality", "toxic"], "event", "target")
    return rounded(metrics.event_weights(marks.withColumn("target", F.col("target").cast("double")), ["event"]))


@query(
    "split_degradation",
    """WITH s AS (SELECT o_orderkey % 4 AS k, avg(o_totalprice) / 100000 AS v FROM orders GROUP BY 1),
w AS (SELECT max(v) FILTER (WHERE k = 0) AS a, max(v) FILTER (WHERE k = 1) AS b, max(v) FILTER (WHERE k = 2) AS c, max(v) FILTER (WHERE k = 3) AS d FROM s)
SELECT round(a, 6) AS valid, round(b, 6) AS time_test, round(c, 6) AS instrument_test, round(d, 6) AS double_oos, round(greatest(0, 1 - b / a), 6) + 0.0 AS time_test_degradation,
 round(greatest(0, 1 - c / a), 6) + 0.0 AS instrument_test_degradation, round(greatest(0, 1 - d / a), 6) + 0.0 AS double_oos_degradation FROM w""",
)
def split_degradation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    name = F.when(k == 0, "valid").when(k == 1, "time_test").when(k == 2, "instrument_test").otherwise("double_oos")
    scores = inputs.table(spark, sf_dir, "orders").groupBy(name.alias("split")).agg((F.avg("o_totalprice") / 100000).alias("score"))
    return rounded(metrics.split_degradation(scores))


@query(
    "relative_gain",
    """WITH s AS (SELECT max(v) FILTER (WHERE p = 'F') AS m, max(v) FILTER (WHERE p = 'O') AS b FROM (SELECT o_orderstatus AS p, avg(o_totalprice) AS v FROM orders GROUP BY 1))
SELECT round(m, 4) AS model_score, round(b, 4) AS baseline_score, round(m / greatest(abs(b), 1e-12) - 1, 6) + 0.0 AS relative_gain, m / greatest(abs(b), 1e-12) - 1 >= 0.05 AS passes_gain FROM s""",
)
def relative_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = inputs.table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("model")).agg(F.avg("o_totalprice").alias("score"))
    return rounded(metrics.relative_gain(scores, "F", "O"), 4, relative_gain=6)


# --- embeddings ------------------------------------------------------------------------------------


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def found(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return neighbors.nearest_neighbors(vectors(spark, sf_dir), inputs.embedding_rows(sf_dir), k)


_KNN = """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
s AS (SELECT a.id, b.id AS neighbor, a.label AS la, b.label AS lb, list_cosine_similarity(a.e, b.e) AS score FROM v a JOIN v b ON a.id <> b.id),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, neighbor) AS INTEGER) AS k FROM s)
"""


@query("nearest_neighbors", _KNN + "SELECT id, neighbor, k, round(score, 6) + 0.0 AS score FROM t WHERE k <= 20")
def nearest_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(found(spark, sf_dir, 20))


@query(
    "neighbor_semantic_hit",
    _KNN + "SELECT round(avg(CASE WHEN la = lb THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS semantic_hit_rate, count(*) AS links FROM t WHERE k <= 20",
)
def neighbor_semantic_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(neighbors.semantic_hit_rate(found(spark, sf_dir, 20), vectors(spark, sf_dir)))


def _phases_of(label) -> list:
    return [((label * 3 + i * 7) % 11).cast("double") for i in range(5)]


@query(
    "weak_phase_hit",
    _KNN
    + """, ph AS (SELECT id, list_position(l, list_max(l)) AS c FROM (SELECT id, list_transform(range(0, 5), lambda i: (label * 3 + i * 7) % 11) AS l FROM v))
SELECT round(avg(CASE WHEN x.c = y.c THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS semantic_hit_rate, count(*) AS links FROM t JOIN ph x ON x.id = t.id JOIN ph y ON y.id = t.neighbor WHERE k <= 20""",
)
def weak_phase_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).withColumn("phases", F.array(*_phases_of(F.col("label")))).drop("label")
    return rounded(neighbors.semantic_hit_rate(found(spark, sf_dir, 20), neighbors.phase_labels(rows)))


@query(
    "gold_neighbor_hit",
    _KNN
    + """, g AS (SELECT id, [CASE WHEN label % 2 = 1 THEN 1 ELSE 0 END, CASE WHEN label = 4 THEN 1 ELSE 0 END, CASE WHEN id = 17 THEN 1 ELSE 0 END] AS ev FROM v),
m AS (SELECT x.id, y.id AS nid, CASE WHEN list_max(x.ev) > 0 THEN list_dot_product(CAST(x.ev AS DOUBLE[]), CAST(y.ev AS DOUBLE[])) > 0 ELSE x.ev = y.ev END AS ok FROM g x JOIN g y ON x.id <> y.id),
has AS (SELECT id FROM m GROUP BY 1 HAVING bool_or(ok))
SELECT round(avg(CASE WHEN m.ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS gold_hit_rate, count(*) AS anchors FROM t JOIN has USING (id) JOIN m ON m.id = t.id AND m.nid = t.neighbor WHERE t.k = 1""",
)
def gold_neighbor_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label")
    flags = F.array((label % 2 == 1).cast("int"), (label == 4).cast("int"), (F.col("id") == 17).cast("int"))
    rows = vectors(spark, sf_dir).withColumn("events", flags)
    return rounded(neighbors.gold_neighbor_hit(found(spark, sf_dir, 1), rows, 3))


@query(
    "cosine_to_label_center",
    """WITH u AS (SELECT label, i, avg(x) AS c FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2),
c AS (SELECT label, list(c ORDER BY i) AS center FROM u GROUP BY 1)
SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), center), 6) + 0.0 AS cosine FROM embeddings JOIN c USING (label)""",
)
def cosine_to_label_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    cells = rows.select("label", F.posexplode("vector").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("c"))
    centers = cells.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "c"))).alias("cells"))  # dims per label
    centers = centers.select("label", F.transform("cells", lambda z: z["c"]).alias("center"))
    joined = rows.join(centers, "label")
    return rounded(joined.select("id", scalar.cosine(F.col("vector"), F.col("center")).alias("cosine")))


@query(
    "chronological_split",
    """SELECT vec_id AS id, CASE WHEN row_number() OVER (ORDER BY vec_id) <= least(greatest(1, floor(count(*) OVER () * 0.8)), greatest(1, count(*) OVER () - 1)) THEN 'train' ELSE 'test' END AS part FROM embeddings""",
)
def chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.chronological_parts(vectors(spark, sf_dir), "id", n_rows=inputs.embedding_rows(sf_dir)).select("id", "part")


def probe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dataset.chronological_parts(vectors(spark, sf_dir), "id", n_rows=inputs.embedding_rows(sf_dir))
    # draws depend on the row's id alone, not on where the row is processed
    part = lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", "id", F.lit(i))), 1, 8), 16, 10).cast("double")
    noise = F.array(*[part(i) / float(1 << 32) - 0.5 for i in range(64)])
    return rows.withColumns({"random": noise, "raw": F.slice("vector", 1, 8), "is_even": (F.col("label") % 2).cast("double")})


@query("linear_probe")
def linear_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = probe_rows(spark, sf_dir).withColumn("target", F.col("label"))
    weights = neighbors.fit_linear_probe(rows.where(F.col("part") == "train"))
    return rounded(neighbors.evaluate_linear_probe(rows.where(F.col("part") == "test"), weights, inputs.embedding_rows(sf_dir)))


@query("classification_probe")
def classification_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = probe_rows(spark, sf_dir).withColumn("target", F.col("label"))
    train, test = rows.where(F.col("part") == "train"), rows.where(F.col("part") == "test")
    return rounded(neighbors.classification_probe(train, test, classes=10))


@query("probe_suite")
def probe_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs_by_name = {"embedding": "vector", "random": "random", "raw": "raw"}
    return rounded(neighbors.probe_suite(probe_rows(spark, sf_dir), inputs_by_name, ["label", "is_even"], inputs.embedding_rows(sf_dir)))


@query(
    "probe_gram",
    """WITH p AS (SELECT label::DOUBLE AS label, (label % 2)::DOUBLE AS is_even, embedding AS vector, CASE WHEN row_number() OVER (ORDER BY vec_id) <= least(greatest(1, floor(count(*) OVER () * 0.8)), greatest(1, count(*) OVER () - 1)) THEN 'train' ELSE 'test' END AS part FROM embeddings),
t AS (SELECT row_number() OVER () AS i, label, is_even, list_transform(vector[1:8], lambda v: v::DOUBLE) AS v FROM p WHERE part = 'train'),
x AS (SELECT i, 'label' AS target, list_concat(v, [1.0::DOUBLE, label]) AS r FROM t UNION ALL SELECT i, 'is_even', list_concat(v, [1.0::DOUBLE, is_even]) FROM t),
c AS (SELECT i, target, len(r) AS n, generate_subscripts(r, 1) - 1 AS k, unnest(r) AS v FROM x)
SELECT 'raw' AS input, a.target, CAST(a.k * a.n + b.k AS INTEGER) AS cell, round(sum(a.v * b.v), 4) + 0.0 AS value FROM c a JOIN c b USING (i, target) GROUP BY a.target, a.n, a.k, b.k""",
)
def probe_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sums from which the linear probes of the suite are solved."""
    train = probe_rows(spark, sf_dir).where(F.col("part") == "train")
    return rounded(neighbors.probe_grams(train, ["raw"], ["label", "is_even"]), 4)
