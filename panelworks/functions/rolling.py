"""Trailing-window functions.

Two families share the frame ``w-1 preceding .. current``:

* ``ts_*`` for the dense ``symbol x d`` grid: the frame must lie inside the
  calendar (``d >= w-1``), missing cells inside it are skipped.
* ``Rolling`` for bar rows: a value needs ``min_periods`` present observations.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

# Fixed value: a product of deviations at or below this is treated as constant.
DEVIATION_FLOOR = 1e-12


class Grid:
    """Where the frames run: partition columns and the dense day index."""

    def __init__(self, by: Sequence[str] = ("symbol",), day: str = "d") -> None:
        self.by, self.day = tuple(by), day

    @property
    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(self.day)

    def last(self, w: int) -> WindowSpec:
        return self.ordered.rowsBetween(-(w - 1), 0)

    def full(self, w: int, value: Column) -> Column:
        return F.when(F.col(self.day) >= w - 1, value)


SYMBOL_GRID = Grid()


def ts_mean(x: Column, w: int, grid: Grid = SYMBOL_GRID) -> Column:
    return grid.full(w, F.avg(x).over(grid.last(w)))


def ts_std(x: Column, w: int, grid: Grid = SYMBOL_GRID) -> Column:
    return grid.full(w, F.stddev_pop(x).over(grid.last(w)))


def ts_max(x: Column, w: int, grid: Grid = SYMBOL_GRID) -> Column:
    return grid.full(w, F.max(x).over(grid.last(w)))


def ts_min(x: Column, w: int, grid: Grid = SYMBOL_GRID) -> Column:
    return grid.full(w, F.min(x).over(grid.last(w)))


def ts_sum(x: Column, w: int, grid: Grid = SYMBOL_GRID) -> Column:
    return grid.full(w, F.sum(x).over(grid.last(w)))


def ts_delay(x: Column, w: int, grid: Grid = SYMBOL_GRID) -> Column:
    return F.lag(x, w).over(grid.ordered)


def ts_delta(x: Column, w: int, grid: Grid = SYMBOL_GRID) -> Column:
    return x - ts_delay(x, w, grid)


def ts_rank(x: Column, w: int, grid: Grid = SYMBOL_GRID) -> Column:
    """Share of the frame's present values that do not exceed the current one."""
    seen = F.collect_list(x).over(grid.last(w))
    share = F.size(F.filter(seen, lambda v: v <= x)) / F.size(seen)
    return grid.full(w, F.when(x.isNotNull(), share))


def decay_linear(x: Column, w: int, grid: Grid = SYMBOL_GRID) -> Column:
    """Weights 1..w by recency over the present values.

    The weight of a cell at day ``e`` seen from day ``d`` is ``e - (d - w)``, so
    both sums split into plain frame sums and no per-row array is needed.
    """
    frame, day = grid.last(w), F.col(grid.day).cast("double")
    offset = day - w
    weighted = F.sum(x * day).over(frame) - offset * F.sum(x).over(frame)
    weights = F.sum(F.when(x.isNotNull(), day)).over(frame) - offset * F.count(x).over(frame)
    return grid.full(w, F.when(weights > 0, weighted / weights))


def ts_argmax(x: Column, w: int, grid: Grid = SYMBOL_GRID) -> Column:
    """Days since the frame maximum; the earliest of equal maxima wins."""
    day = F.col(grid.day)
    best = F.max(F.when(x.isNotNull(), F.struct(x.alias("v"), (-day).alias("e")))).over(grid.last(w))
    return grid.full(w, (day + best["e"]).cast("double"))


def ts_argmin(x: Column, w: int, grid: Grid = SYMBOL_GRID) -> Column:
    """Days since the frame minimum; the earliest of equal minima wins."""
    day = F.col(grid.day)
    best = F.min(F.when(x.isNotNull(), F.struct(x.alias("v"), day.alias("e")))).over(grid.last(w))
    return grid.full(w, (day - best["e"]).cast("double"))


def count_positive(x: Column, w: int, grid: Grid = SYMBOL_GRID) -> Column:
    frame = grid.last(w)
    return grid.full(w, F.when(F.count(x).over(frame) > 0, F.count_if(x > 0).over(frame).cast("double")))


def ts_cov(a: Column, b: Column, w: int, grid: Grid = SYMBOL_GRID) -> Column:
    """Population covariance of the cells where both sides are present."""
    frame = grid.last(w)
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return grid.full(w, F.when(F.count(x).over(frame) >= 2, F.covar_pop(x, y).over(frame)))


def ts_corr(a: Column, b: Column, w: int, grid: Grid = SYMBOL_GRID) -> Column:
    """Pearson correlation of the cells where both sides are present."""
    frame = grid.last(w)
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    spread = F.stddev_pop(x).over(frame) * F.stddev_pop(y).over(frame)
    usable = (F.count(x).over(frame) >= 2) & (spread > DEVIATION_FLOOR)
    return grid.full(w, F.when(usable, F.covar_pop(x, y).over(frame) / spread))


TS_UNARY = {
    "ts_mean": ts_mean,
    "ts_std": ts_std,
    "ts_max": ts_max,
    "ts_min": ts_min,
    "ts_delta": ts_delta,
    "ts_delay": ts_delay,
    "ts_rank": ts_rank,
    "ts_sum": ts_sum,
    "decay_linear": decay_linear,
    "ts_argmax": ts_argmax,
    "ts_argmin": ts_argmin,
    "count": count_positive,
}
TS_BINARY = {"ts_corr": ts_corr, "ts_cov": ts_cov}


class Rolling:
    """Bar-row windows with a minimum number of present observations."""

    def __init__(self, by: Sequence[str] = ("symbol",), order: str = "trading_date") -> None:
        self.by, self.order = tuple(by), order

    @property
    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(self.order)

    def lag(self, x: Column, k: int = 1) -> Column:
        return F.lag(x, k).over(self.ordered)

    def _agg(
        self, agg: Callable[[Column], Column], x: Column, w: int, min_periods: int | None, first: int = 0
    ) -> Column:
        frame = self.ordered.rowsBetween(-(w - 1) - first, -first)
        return F.when(F.count(x).over(frame) >= (w if min_periods is None else min_periods), agg(x).over(frame))

    def mean(self, x: Column, w: int, min_periods: int | None = None) -> Column:
        return self._agg(F.avg, x, w, min_periods)

    def std(self, x: Column, w: int, min_periods: int | None = None) -> Column:
        return self._agg(F.stddev_pop, x, w, min_periods)

    def sum(self, x: Column, w: int, min_periods: int | None = None) -> Column:
        return self._agg(F.sum, x, w, min_periods)

    def max_before(self, x: Column, w: int, min_periods: int) -> Column:
        """Extreme of the ``w`` rows that end one row earlier."""
        return self._agg(F.max, x, w, min_periods, first=1)

    def min_before(self, x: Column, w: int, min_periods: int) -> Column:
        return self._agg(F.min, x, w, min_periods, first=1)

    def change(self, x: Column, k: int) -> Column:
        """Relative change over ``k`` rows without padding; NULL on a zero base."""
        base = self.lag(x, k)
        return F.when(base != 0, x / base - 1)

    def zscore(self, x: Column, w: int, eps: float = 1e-8) -> Column:
        deviation = self.std(x, w)
        return F.when(deviation != 0, (x - self.mean(x, w)) / (deviation + eps))

    def percentile(self, x: Column, w: int) -> Column:
        """Average-rank share of the current value inside a full frame."""
        frame = self.ordered.rowsBetween(-(w - 1), 0)
        seen = F.collect_list(x).over(frame)
        # smaller values count 1, equal ones a half: the mean rank in one pass
        place = F.aggregate(seen, F.lit(0.5), lambda s, v: s + F.when(v < x, 1.0).when(v == x, 0.5).otherwise(0.0))
        return F.when((F.count(x).over(frame) == w) & x.isNotNull(), place / w)

    def rows_since(self, event: Column, row: Column, cap: int) -> Column:
        """Rows since the last TRUE event, capped; ``cap`` before the first one."""
        frame = self.ordered.rowsBetween(Window.unboundedPreceding, 0)
        last = F.max(F.when(event, row)).over(frame)
        return F.least(F.coalesce(row - last, F.lit(cap)), F.lit(cap))
