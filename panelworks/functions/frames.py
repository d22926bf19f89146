"""Trailing frames of bar rows, computed batch by batch inside the tasks.

Spark's window operator adds up every row of a moving frame anew, in each aggregate.
Here a task reads its rows in the order of a window (``positioned``) as Arrow batches and
moves whole columns through a frame at once, oldest row first, so that sums, means and
deviations are those of the window operator to the last bit. The last rows of a batch are carried to the next
one: no group is ever held as a whole.

``Frame`` names what is computed; a NULL is skipped, and fewer than ``least`` present values give NULL.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType


class Frame(NamedTuple):
    """``kind`` of ``column`` over ``rows`` rows that end ``back`` rows before the current one."""

    kind: str  # mean, std, sum, max, min, lag, percentile, since
    column: str
    rows: int
    least: int | None = None
    back: int = 0


def positioned(df: DataFrame, by: Sequence[str], order: str, at: str) -> DataFrame:
    """Rows with their position (from 1) in their group; a task holds its groups in order, one after the other."""
    return df.withColumn(at, F.row_number().over(Window.partitionBy(*by).orderBy(order)))


def with_frames(df: DataFrame, at: str, frames: dict[str, Frame]) -> DataFrame:
    """Add a double column per frame to the rows of ``positioned``, whose order stays.

    Only what keeps the order of rows (columns added or dropped, this function) may stand between the two.
    """
    schema = StructType(list(df.schema.fields))
    for name in frames:
        schema = schema.add(name, DoubleType())
    inputs = list(dict.fromkeys(f.column for f in frames.values()))
    reach = max(f.rows + f.back for f in frames.values())

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        places = np.zeros(0, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = batch.column(batch.schema.get_field_index(at)).to_numpy(zero_copy_only=False).astype(np.int64)
            before = len(places)
            places = np.concatenate([places, fresh])
            step = np.diff(places)
            if before + (fresh[0] == 1) == 0 or not ((step == 1) | (places[1:] == 1)).all():
                raise ValueError("rows of a frame are not in the order of their positions")
            # every group gets its own stretch of slots behind `reach` empty ones
            slots = np.arange(len(places)) + reach * (1 + np.cumsum(np.append(False, places[1:] == 1)))
            spread = {}
            for name in inputs:
                values, present = _column(batch.column(batch.schema.get_field_index(name)))
                if before:
                    values, present = (np.concatenate(pair) for pair in zip(held[name], (values, present)))
                held[name] = values[-reach:], present[-reach:]
                x, has = np.zeros(slots[-1] + 1), np.zeros(slots[-1] + 1, dtype=bool)
                x[slots], has[slots] = np.where(present, values, 0.0), present
                spread[name] = x, has
            added = [_framed(f, *spread[f.column], slots[before:]) for f in frames.values()]
            places = places[-reach:]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(v, mask=~known) for v, known in added]], names=[*batch.schema.names, *frames]
            )

    return df.mapInArrow(framed, schema)


def _column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and which of them are present."""
    present = column.is_valid().to_numpy(zero_copy_only=False)
    return column.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False), present


def _framed(frame: Frame, x: np.ndarray, has: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The frame's value, and whether there is one, at every slot."""
    kind, _, w, least, back = frame
    with np.errstate(all="ignore"):
        if kind == "lag":
            return x[slots - w], has[slots - w]
        if kind == "since":  # rows since the last positive value (as in Spark, NaN is one), at most w
            since, event = np.full(len(x), float(w)), has & ~(x <= 0)
            for k in range(w - 1, -1, -1):
                since[k:][event[: len(x) - k]] = k
            return since[slots], np.ones(len(slots), dtype=bool)
        n = len(x) - (w - 1)  # frames by their oldest slot
        oldest = slots - back - (w - 1)
        seen = np.append(0, np.cumsum(has))
        count = (seen[w:] - seen[: n])[oldest]
        known = count >= max(1, w if least is None else least)
        columns = [(x[k : k + n], has[k : k + n]) for k in range(w)]
        if kind in ("mean", "sum"):
            total = np.zeros(n)
            for value, _ in columns:
                total += value
            return (total[oldest] / count if kind == "mean" else total[oldest]), known
        if kind == "std":
            number, mean, squares = np.zeros(n), np.zeros(n), np.zeros(n)
            for value, present in columns:
                number += present
                delta = np.where(present, value - mean, 0.0)
                share = np.where(present, delta / number, 0.0)
                mean += share
                squares += delta * (delta - share)
            return np.sqrt(squares[oldest] / count), known
        if kind in ("max", "min"):  # NaN is the largest value
            pick, none = (np.maximum, -np.inf) if kind == "max" else (np.fmin, np.nan)
            best = np.full(n, none)
            for value, present in columns:
                best = pick(best, np.where(present, value, none))
            return best[oldest], known
        if kind == "percentile":  # smaller values count 1, equal ones a half: the mean rank
            last, place = x[w - 1 :], np.full(n, 0.5)
            if np.isnan(x).any():  # NaN is the largest value and equal to itself: numbers in order stand for the values
                order = np.append(np.unique(x[~np.isnan(x)]), np.nan)
                x = np.searchsorted(order, x).astype(float)
                last, columns = x[w - 1 :], [(x[k : k + n], None) for k in range(w)]
            for value, _ in columns:
                place += (value < last) + 0.5 * (value == last)
            return place[oldest] / w, known & has[slots]
    raise ValueError(f"unknown frame {kind}")
