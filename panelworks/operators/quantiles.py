"""Exact quantiles of many columns by narrowing brackets."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelworks.session import stored

#: Distinct values of a bracket that one task may order, and the accuracy of the sketches that set brackets.
ORDERED, ACCURACY = 200_000, 10_000


@dataclass
class Target:
    """One quantile of one column: the values at 0-based ``position`` and the next lie between ``low`` and ``high``."""

    column: str
    share: float
    rows: int
    low: float
    high: float
    below: int = 0
    inside: int = 0

    @property
    def position(self) -> int:
        return math.floor((self.rows - 1) * self.share)

    @property
    def last(self) -> int:
        return math.ceil((self.rows - 1) * self.share)

    @property
    def held(self) -> bool:
        """Both needed values are in the bracket."""
        return self.below <= self.position and self.last < self.below + self.inside

    @property
    def open(self) -> bool:
        """More than one value may be in the bracket."""
        return self.low != self.high and not math.isnan(self.low)

    def within(self):
        return F.when(F.col(self.column).between(self.low, self.high), F.col(self.column))

    def split(self, values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which known values lie below and in the bracket; NaN is the largest value, as in Spark."""
        below = known & (~np.isnan(values) if math.isnan(self.low) else values < self.low)
        inside = known & ~below
        return below, inside if math.isnan(self.high) else inside & (values <= self.high)


def _column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    cells = batch.column(name)
    return cells.to_numpy(zero_copy_only=False).astype(float), cells.is_valid().to_numpy(zero_copy_only=False)


def _counted(rows: DataFrame, targets: list[Target]) -> None:
    """Fill in how many values lie below and in each bracket; a task counts whole columns of its batches."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(targets), 2), dtype=np.int64)
        for batch in batches:
            columns = {t.column: None for t in targets}
            for i, t in enumerate(targets):
                columns[t.column] = columns[t.column] or _column(batch, t.column)
                totals[i] += [np.count_nonzero(x) for x in t.split(*columns[t.column])]
        numbers = pa.array(np.arange(len(targets), dtype=np.int32))
        yield pa.RecordBatch.from_arrays([numbers, *map(pa.array, totals.T)], ["target", "below", "inside"])

    needed = rows.select(*dict.fromkeys(t.column for t in targets))
    found = needed.mapInArrow(count, "target int, below long, inside long")
    for r in found.groupBy("target").agg(F.sum("below").alias("below"), F.sum("inside").alias("inside")).collect():  # a row per target
        targets[r["target"]].below, targets[r["target"]].inside = r["below"], r["inside"]


def _inside(rows: DataFrame, targets: list[Target]) -> DataFrame:
    """(target, value, n): the values of each bracket, equal ones of a batch as one row."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in enumerate(targets):
                values, known = _column(batch, t.column)
                distinct, times = np.unique(values[t.split(values, known)[1]], return_counts=True)
                if len(distinct):
                    cells = [np.full(len(distinct), i, dtype=np.int32), distinct, times.astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["target", "value", "n"])

    needed = rows.select(*dict.fromkeys(t.column for t in targets))
    return needed.mapInArrow(pick, "target int, value double, n long")


def exact_quantiles(
    rows: DataFrame,
    columns: Sequence[str],
    shares: Sequence[float],
    ordered: int = ORDERED,
    accuracy: int = ACCURACY,
    kept: bool = False,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column (NULLs left out; None for a column without values).

    Mergeable sketches of all columns, from one scan, bracket each wanted rank; exact counts say how many values
    lie below and inside; brackets that hold more than ``ordered`` values are sketched again. Only what is left in the
    brackets is exchanged, equal values as one row. Rows are read a few times and never sorted; the driver sees
    numbers per column and share. Rows that are not ``kept`` in a table already are stored for that.
    """
    rows = rows.select(*[F.col(c).cast("double").alias(c) for c in columns])
    rows = rows if kept else stored(rows)
    margin = 2 / accuracy

    def around(share: float) -> list[float]:
        return [max(0.0, share - margin), min(1.0, share + margin)]

    probes = [p for share in shares for p in around(share)]
    facts = []
    for c in columns:
        sketch = F.percentile_approx(c, F.array(*[F.lit(p) for p in probes]), F.lit(accuracy))
        facts += [F.count(c), F.min(c), F.max(c), sketch]
    seen = rows.agg(*[f.alias(f"f{i}") for i, f in enumerate(facts)]).first()
    ends = {c: (seen[4 * i + 1], seen[4 * i + 2]) for i, c in enumerate(columns)}
    targets = [
        Target(c, share, seen[4 * i], float(seen[4 * i + 3][2 * k]), float(seen[4 * i + 3][2 * k + 1]))
        for i, c in enumerate(columns)
        if seen[4 * i]
        for k, share in enumerate(shares)
    ]
    if targets:
        _counted(rows, targets)
    missed = [t for t in targets if not t.held]
    if missed:  # a sketch that kept less than it promises: start from all values
        for t in missed:
            t.low, t.high = map(float, ends[t.column])
        _counted(rows, missed)
    while wide := [t for t in targets if t.inside > ordered and t.open]:
        sketches = [
            F.percentile_approx(t.within(), F.array(*[F.lit(p) for p in around((t.position - t.below) / t.inside)]), F.lit(accuracy))
            for t in wide
        ]
        found = rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sketches)]).first()
        narrowed = [Target(t.column, t.share, t.rows, float(s[0]), float(s[1])) for t, s in zip(wide, found)]
        _counted(rows, narrowed)
        stuck = True
        for t, new in zip(wide, narrowed):
            if new.held and new.inside < t.inside:
                t.low, t.high, t.below, t.inside, stuck = new.low, new.high, new.below, new.inside, False
        if stuck:  # what is left are few distinct values, which meet as one row each
            break
    return _picked(rows, columns, shares, targets)


def _picked(rows: DataFrame, columns: Sequence[str], shares: Sequence[float], targets: list[Target]) -> dict[str, list[float | None]]:
    """The values at the wanted positions of each bracket, from counts of its distinct values."""
    values: dict[tuple[str, float], float] = {(t.column, t.share): t.low for t in targets if not t.open}
    open_ = [t for t in targets if t.open]
    if open_:
        counts = _inside(rows, open_).groupBy("target", "value").agg(F.sum("n").alias("n"))
        upto = Window.partitionBy("target").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        ranked = counts.withColumn("upto", F.sum("n").over(upto))
        first = F.create_map(*[x for i, t in enumerate(open_) for x in (F.lit(i), F.lit(t.position - t.below))])
        second = F.create_map(*[x for i, t in enumerate(open_) for x in (F.lit(i), F.lit(t.last - t.below))])
        at, last = F.element_at(first, F.col("target")), F.element_at(second, F.col("target"))
        picks = ranked.groupBy("target").agg(
            F.min(F.when(F.col("upto") > at, F.col("value"))).alias("low"), F.min(F.when(F.col("upto") > last, F.col("value"))).alias("high")
        )
        for r in picks.collect():  # one row per open bracket
            t = open_[r.target]
            values[t.column, t.share] = r.low + (r.high - r.low) * ((t.rows - 1) * t.share - t.position)
    return {c: [values.get((c, s)) for s in shares] for c in columns}
