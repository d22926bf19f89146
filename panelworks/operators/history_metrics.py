"""The metrics of ``operators.metrics`` for wide histories of labels, from one pass over their rows.

A history holds each label ``x`` and its prediction ``_p_x`` as two columns. Blocks of rows become sums inside the
tasks; only the cells whose order matters are exchanged, packed (see ``ranking.fold_ranks``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.operators import metrics, ranking
from panelworks.operators.labels import PHASES, task_type
from panelworks.session import stored

_BINS = [f"{x}{i}" for x in ("bn", "bt", "bp") for i in range(metrics.ECE_BINS)]
_MOMENTS = ["mt", "mp", "stt", "spp", "stp"]
_REGRESSION = ["n", "gap", "square", "same", *_MOMENTS]
_RANKS = ["rtt", "rpp", "rtp"]
_EVENT = ["n", "_positives", "_tp", "_fp", "_fn", *_BINS]
_ORDERED = ["_area", *[f"{x}_{top}" for top in metrics.TOP_SHARES for x in ("rows", "hits")]]
_CELLS = [f"c{a}_{b}" for a in range(len(PHASES)) for b in range(len(PHASES))]
_PHASE = ["n", "ce", "kl", "js", "brier", *_BINS, *_CELLS]
_ADDED = dict.fromkeys([*_REGRESSION[1:4], *_RANKS, *_EVENT[1:], *_ORDERED, *_PHASE[1:]])
_SUMS = "name string, n long, " + ", ".join(f"{c} double" for c in [*_MOMENTS, *_ADDED])


def is_event(name: str) -> bool:
    return task_type(name) == "binary_event"


def _pair(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Targets and predictions of the rows that have both."""
    found = [table.column(c).combine_chunks() for c in (name, f"_p_{name}")]
    both = np.logical_and(*[x.is_valid().to_numpy(zero_copy_only=False) for x in found])
    t, p = (x.to_numpy(zero_copy_only=False).astype(float)[both] for x in found)
    return t, p


def _bins(target: np.ndarray, prediction: np.ndarray) -> list[float]:
    """Rows, targets and predictions per bin of equal width; predictions outside [0, 1] are in none."""
    inside = (prediction >= 0) & (prediction <= 1)
    t, p = target[inside], prediction[inside]
    edges = [i * (1.0 / metrics.ECE_BINS) for i in range(1, metrics.ECE_BINS)]
    at = np.searchsorted(edges, p, side="right")
    return np.concatenate([np.bincount(at, w, metrics.ECE_BINS) for w in (None, t, p)]).tolist()


def _regression_sums(t: np.ndarray, p: np.ndarray) -> list[float]:
    if not len(t):
        return [0.0] * len(_REGRESSION)
    gap, mt, mp = p - t, t.mean(), p.mean()
    moments = [mt, mp, ((t - mt) ** 2).sum(), ((p - mp) ** 2).sum(), ((t - mt) * (p - mp)).sum()]
    return [len(t), np.abs(gap).sum(), (gap * gap).sum(), (np.sign(p) == np.sign(t)).sum(), *moments]


def _event_sums(t: np.ndarray, p: np.ndarray, threshold: float) -> list[float]:
    hit, predicted = t > metrics.POSITIVE, p >= threshold
    counts = [len(t), hit.sum(), (hit & predicted).sum(), (~hit & predicted).sum(), (hit & ~predicted).sum()]
    return [*counts, *_bins(t, p)]


def _phase_sums(table: pa.Table) -> list[float]:
    """Losses, bins and classes of the rows whose phases are all valid."""
    pairs = [table.column(c).combine_chunks() for c in (*PHASES, *[f"_p_{c}" for c in PHASES])]
    known = np.logical_and(*[pairs[PHASES.index("markup") + k].is_valid().to_numpy(zero_copy_only=False) for k in (0, len(PHASES))])
    cells = np.column_stack([x.to_numpy(zero_copy_only=False).astype(float)[known] for x in pairs])
    if not len(cells):
        return [0.0] * len(_PHASE)
    y, scores = cells[:, : len(PHASES)], cells[:, len(PHASES) :]
    y = y / np.maximum(y.sum(axis=1, keepdims=True), 1e-12)
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1e-12)
    m = 0.5 * (y + p)

    def log(x: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(x, 1e-12))

    def divergence(a: np.ndarray, b: np.ndarray) -> float:
        return (a * np.log(np.maximum(a, 1e-12) / np.maximum(b, 1e-12))).sum()

    actual, predicted = y.argmax(axis=1), p.argmax(axis=1)
    losses = [-(y * log(p)).sum(), divergence(y, p), 0.5 * divergence(y, m) + 0.5 * divergence(p, m), ((p - y) ** 2).sum()]
    confusion = np.bincount(actual * len(PHASES) + predicted, minlength=len(PHASES) ** 2)
    return [len(y), *losses, *_bins((actual == predicted).astype(float), p.max(axis=1)), *confusion]


def _rank_sums(t: ranking.Placed, p: ranking.Placed) -> list[float]:
    ranks = np.zeros((2, len(t.rest)))
    for row, c in zip(ranks, (t, p)):
        row[c.rest] = np.repeat(c.at, c.n) / 2
    return [ranks[0] @ ranks[0], ranks[1] @ ranks[1], ranks[0] @ ranks[1]]


def _order_sums(c: ranking.Placed) -> list[float]:
    """Sum of the precision at each hit, and rows and hits among the first shares of the column."""
    first = np.cumsum(c.n) - c.n
    hit = c.rest.astype(np.int64)
    before = np.cumsum(hit) - hit  # in this block
    rank = np.repeat(c.at - first, c.n) + np.arange(len(hit)) + 1
    found = (np.repeat(c.hits_at - before[first], c.n) + before + 1)[hit > 0]
    sums = [(found / rank[hit > 0]).sum()]
    for share in metrics.TOP_SHARES.values():
        top = rank <= max(1, math.ceil(c.rows * share))
        sums += [top.sum(), hit[top].sum()]
    return sums


def history_sums(
    history: DataFrame,
    names: Sequence[str],
    n_rows: int,
    drawn: DataFrame | None = None,
    ranked: Sequence[str] | None = None,
    phases: bool = False,
    threshold: float = 0.5,
    block_rows: int | None = None,
) -> DataFrame:
    """One row of sums per label, and one named ``phase``; stored, since every metric reads it.

    Equal predictions of events keep the order of the rows: ``history`` holds them by the range of their identity, in order
    inside a partition. Only labels in ``ranked`` (all, if not given) get their rank sums. ``n_rows`` (about how many
    there are) and ``drawn`` (some rows of the same kind) balance the tasks.
    """
    plain, events = [n for n in names if not is_event(n)], [n for n in names if is_event(n)]
    placed_of = [n for n in plain if ranked is None or n in ranked]

    def present(name: str, value: str, sign: int = 1) -> Column:
        return F.when(F.col(name).isNotNull() & F.col(f"_p_{name}").isNotNull(), sign * F.col(value))

    wanted = [present(n, c) for n in placed_of for c in (n, f"_p_{n}")] + [present(n, f"_p_{n}", -1) for n in events]
    edges = ranking.part_edges(history if drawn is None else drawn, wanted, -(-n_rows // ranking.PART_CELLS))

    def cut(table: pa.Table) -> tuple[np.ndarray, list[ranking.Cells]]:
        own, columns = [], []
        for name in plain:
            t, p = _pair(table, name)
            own += _regression_sums(t, p)
            if name in placed_of:
                places = np.arange(len(t), dtype=np.uint16)
                columns += [ranking.ordered_cells(x, places) for x in (t, p)]
        for name in events:
            t, p = _pair(table, name)
            own += _event_sums(t, p, threshold)
            hit = t > metrics.POSITIVE
            columns.append(ranking.ordered_cells(-p, hit.astype(np.uint16), hit))
        return np.array(own + (_phase_sums(table) if phases else []), dtype=float), columns

    def fold(own: np.ndarray, columns: list[ranking.Placed]) -> pa.Table:
        rows, at = [], 0
        for name, fields in [*[(n, _REGRESSION) for n in plain], *[(n, _EVENT) for n in events], *[("phase", _PHASE)] * phases]:
            rows.append({"name": name} | dict(zip(fields, own[at : at + len(fields)].tolist())))
            at += len(fields)
        by_name = {r["name"]: r for r in rows}
        for i, name in enumerate(placed_of):
            by_name[name] |= zip(_RANKS, _rank_sums(columns[2 * i], columns[2 * i + 1]))
        for name, c in zip(events, columns[2 * len(placed_of) :]):
            by_name[name] |= zip(_ORDERED, _order_sums(c))
        frame = pd.DataFrame(rows, columns=["name", "n", *_MOMENTS, *_ADDED])
        kinds = {"name": pa.string(), "n": pa.int64()}
        schema = pa.schema([(c, kinds.get(c, pa.float64())) for c in frame.columns])
        return pa.Table.from_pandas(frame.astype({"n": "int64"}), schema=schema, preserve_index=False)

    ordinal = range(2 * len(placed_of), len(edges))
    columns = [c for n in [*names, *(PHASES if phases else ())] for c in (n, f"_p_{n}")]
    parts = ranking.fold_ranks(history.select(*columns), cut, fold, _SUMS, edges, ordinal, block_rows)
    n = F.sum("n")
    mt, mp = F.sum(F.col("n") * F.col("mt")) / n, F.sum(F.col("n") * F.col("mp")) / n
    merged = {"stt": ("mt", "mt", mt, mt), "spp": ("mp", "mp", mp, mp), "stp": ("mt", "mp", mt, mp)}
    return stored(
        parts.groupBy("name").agg(
            n.alias("n"),
            *[
                (F.sum(s) + F.sum(F.col("n") * F.col(a) * F.col(b)) - n * ma * mb).alias(s)
                for s, (a, b, ma, mb) in merged.items()
            ],
            *[F.sum(c).alias(c) for c in _ADDED],
        )
    )


def _named(sums: DataFrame, names: Sequence[str], group_of: dict[str, str]) -> DataFrame:
    group = F.create_map(*[F.lit(x) for n in names for x in (n, group_of[n])]) if names else F.create_map(F.lit(""), F.lit(""))
    return sums.where(F.col("name").isin(*names) & (F.col("n") > 0)).withColumn("group", group[F.col("name")])


def _correlation(xx: str, yy: str, xy: str) -> Column:
    """0 for a flat side."""
    return F.when((F.col("n") >= 2) & (F.col(xx) > 0) & (F.col(yy) > 0), F.col(xy) / F.sqrt(F.col(xx)) / F.sqrt(F.col(yy))).otherwise(0.0)


def _calibration_error() -> Column:
    gaps = [F.abs(F.col(f"bt{i}") - F.col(f"bp{i}")) for i in range(metrics.ECE_BINS)]
    return sum(gaps, F.lit(0.0)) / F.col("n")


def regression_rows(sums: DataFrame, names: Sequence[str], group_of: dict[str, str]) -> DataFrame:
    """``metrics.regression_metrics`` of the labels that have rows; ``spearman`` is NULL where ranks were not wanted."""
    return _named(sums, [n for n in names if not is_event(n)], group_of).select(
        "group",
        "name",
        (F.col("gap") / F.col("n")).alias("mae"),
        F.sqrt(F.col("square") / F.col("n")).alias("rmse"),
        _correlation("stt", "spp", "stp").alias("pearson"),
        F.when(F.col("rtt").isNotNull(), _correlation("rtt", "rpp", "rtp")).alias("spearman"),
        (F.col("same") / F.col("n")).alias("sign_accuracy"),
        F.col("n").alias("valid_count"),
    )


def event_rows(sums: DataFrame, names: Sequence[str], group_of: dict[str, str]) -> DataFrame:
    """``metrics.event_metrics`` of the labels that have rows."""
    tops = {top: F.col(f"hits_{top}") / F.col(f"rows_{top}") for top in metrics.TOP_SHARES}
    found = _named(sums, [n for n in names if is_event(n)], group_of)
    found = found.withColumns({**tops, "ece": _calibration_error(), "valid_count": F.col("n")})
    return metrics.event_figures(found, ["group", "name", *tops, "ece"], "valid_count")


def phase_row(sums: DataFrame) -> DataFrame:
    """``metrics.soft_phase_metrics``, one row."""
    found = sums.where((F.col("name") == "phase") & (F.col("n") > 0))
    classes = range(len(PHASES))
    rates = []
    for k in classes:
        tp, wanted = F.col(f"c{k}_{k}"), [sum((F.col(c) for c in cells), F.lit(0.0)) for cells in ([f"c{a}_{k}" for a in classes], [f"c{k}_{a}" for a in classes])]
        precision, recall = (tp / F.greatest(w, F.lit(1.0)) for w in wanted)
        rates.append(2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12)))
    losses = {"soft_ce": "ce", "kl_divergence": "kl", "js_divergence": "js", "brier_score": "brier"}
    return found.agg(
        *[F.max(F.col(c) / F.col("n")).alias(out) for out, c in losses.items()],
        F.max(_calibration_error()).alias("ece"),
        F.max(sum(rates, F.lit(0.0)) / len(PHASES)).alias("macro_f1"),
    )


def grouped_metrics(sums: DataFrame, names: Sequence[str], group_of: dict[str, str]) -> DataFrame:
    """``metrics.grouped_metrics``; figures that were not wanted are left out."""
    long = metrics.long_metrics(regression_rows(sums, names, group_of), event_rows(sums, names, group_of), phase_row(sums))
    return long.where(F.col("value").isNotNull())
