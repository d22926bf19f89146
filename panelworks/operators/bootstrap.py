"""Block bootstraps of any statistic, a matrix of resampled values at a time.

A series is one row with its values in order (bounded by the calendar). An iteration is a list of blocks (first
position, length) drawn from digests of (seed, series, iteration, block), so draws depend neither on partitioning
nor on a task's history. Series and chunks of iterations are dealt to the tasks; inside a task the resampled values of
several iterations form one matrix, from which every statistic is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spread below which a ratio to it counts as missing.
FLAT = 1e-12
#: Iterations in one row: the most that one task makes of a series at a time.
CHUNK = 500
#: Resampled values held at once.
CELLS = 250_000

#: A statistic of (values, companions), both (iterations x length): one number per iteration, NaN where it is missing.
Statistic = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Blocks of (uniform, first iteration, last iteration, length of the series): positions (iterations x length).
Blocks = Callable[[Callable, range, int], np.ndarray]


def _centred(x: np.ndarray) -> np.ndarray:
    return x - x.mean(axis=1, keepdims=True)


def mean(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x.mean(axis=1)


def sharpe(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Mean over the sample standard deviation."""
    if x.shape[1] < 2:
        return np.full(len(x), np.nan)
    deviation = x.std(axis=1, ddof=1)
    return np.divide(x.mean(axis=1), deviation, out=np.full(len(x), np.nan), where=deviation > FLAT)


def hit_rate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x > 0).mean(axis=1)


def correlation(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pearson correlation of the value with its companion."""
    a, b = _centred(x), _centred(y)
    spread = np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b))
    return np.divide(np.einsum("ij,ij->i", a, b), spread, out=np.full(len(x), np.nan), where=spread > FLAT)


def median(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    low, high = (x.shape[1] - 1) // 2, x.shape[1] // 2
    ordered = np.partition(x, (low, high), axis=1)
    return (ordered[:, low] + ordered[:, high]) / 2


STATISTICS: dict[str, Statistic] = {
    "mean": mean,
    "sharpe": sharpe,
    "hit_rate": hit_rate,
    "correlation": correlation,
    "median": median,
}


def _uniform(seed: int, series: str | None) -> Callable[[range, range], np.ndarray]:
    """Two numbers in [0, 1) of 52 bits for each iteration and block of a series."""
    head = ":".join([str(seed), *([] if series is None else [series])]).encode()

    def draws(iterations: range, blocks: range) -> np.ndarray:
        tails = [b":%d" % j for j in blocks]
        heads = [head + b":%d" % i for i in iterations]
        digests = b"".join([hashlib.md5(h + t, usedforsecurity=False).digest() for h in heads for t in tails])
        words = np.frombuffer(digests, dtype=">u8").astype(np.uint64).reshape(len(iterations), len(blocks), 2)
        first, second = words[..., 0], words[..., 1]
        # hexadecimal digits 1 to 13 and 14 to 26
        low = ((first & np.uint64(0xFFF)) << np.uint64(40)) | (second >> np.uint64(24))
        return np.stack([first >> np.uint64(12), low]).astype(np.float64) / 2.0**52

    return draws


def moving_blocks(length: int) -> Blocks:
    """Blocks of one length from anywhere in the series; the last is cut to the length of the series."""

    def positions(draws: Callable, iterations: range, n: int) -> np.ndarray:
        start = np.floor(draws(iterations, range(-(-n // length)))[0] * (n - length + 1)).astype(np.int64)
        return (start[:, :, None] + np.arange(length)).reshape(len(iterations), -1)[:, :n]

    return positions


def stationary_blocks(expected_length: float) -> Blocks:
    """Blocks of geometric length on a circle until the series is filled."""

    def positions(draws: Callable, iterations: range, n: int) -> np.ndarray:
        starts, sizes, filled, done = [], [], np.zeros(len(iterations), dtype=np.int64), 0
        while filled.min() < n:  # most iterations are filled by the first round
            more = range(done, min(n, done + int(1.5 * (n - filled.min()) / expected_length) + 4))
            start, size = draws(iterations, more)
            if expected_length > 1:
                size = np.minimum(np.floor(np.log(1 - size) / np.log(1 - 1 / expected_length)) + 1, n).astype(np.int64)
            else:
                size = np.ones(size.shape, dtype=np.int64)
            starts.append(np.floor(start * n).astype(np.int64))
            sizes.append(size)
            filled, done = filled + size.sum(axis=1), more.stop
        start, size = np.concatenate(starts, axis=1), np.concatenate(sizes, axis=1)
        before = np.cumsum(size, axis=1) - size
        size = np.clip(n - before, 0, size)  # every iteration now has n positions in all
        shift = np.repeat((start - before).ravel(), size.ravel()).reshape(len(iterations), n)
        return (shift + np.arange(n)) % n

    return positions


def prepared(series: DataFrame) -> DataFrame:
    """(series_id, x, y): the values and their companions by position."""
    companion = F.col("companion") if "companion" in series.columns else F.lit(None)
    rows = series.select(
        "series_id", "position", F.col("value").cast("double").alias("x"), F.coalesce(companion.cast("double"), F.lit(0.0)).alias("y")
    )
    cells = F.sort_array(F.collect_list(F.struct("position", "x", "y"))).alias("cells")
    whole = rows.where(F.col("x").isNotNull()).groupBy("series_id").agg(cells)
    return whole.select("series_id", F.col("cells.x").alias("x"), F.col("cells.y").alias("y"))


def _estimates(blocks: Blocks, statistics: dict[str, Statistic], seed: int) -> Callable:
    """Rows (series_id, tag, x, y, first, last) to the point estimates and those of the iterations first to last."""

    def resampled(x: np.ndarray, y: np.ndarray, tag: str | None, first: int, last: int) -> np.ndarray:
        draws, step = _uniform(seed, tag), max(1, CELLS // len(x))
        found = [np.empty((len(statistics), 0))]
        for at in range(first, last + 1, step):
            places = blocks(draws, range(at, min(at + step, last + 1)), len(x))
            chosen = x[places], y[places]
            found.append(np.stack([f(*chosen) for f in statistics.values()]))
        return np.concatenate(found, axis=1)

    def estimated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column("x"), batch.column("y")
            facts = zip(*[batch.column(c).to_pylist() for c in ("tag", "first", "last")], strict=True)
            for i, (tag, first, last) in enumerate(facts):
                x, y = (side[i].values.to_numpy(zero_copy_only=False) for side in (xs, ys))
                points = [float(f(x[None, :], y[None, :])[0]) for f in statistics.values()]
                found = resampled(x, y, tag, first, last)
                lists = [pa.array([row], type=pa.list_(pa.float64())) for row in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("series_id").slice(i, 1), *[pa.array([p], type=pa.float64()) for p in points], *lists],
                    names=["series_id", *[f"p{k}" for k in range(len(points))], *[f"s{k}" for k in range(len(points))]],
                )

    return estimated


def _quantile(ordered: Column, share: float) -> Column:
    """Between the two nearest of the ordered values."""
    at = (F.size(ordered) - 1) * F.lit(share)
    low = F.floor(at).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, F.ceil(at).cast("int"))
    return a + (at - low) * (b - a)


def block_bootstrap(
    series: DataFrame,
    blocks: Blocks,
    statistics: dict[str, Statistic],
    seed: int = 0,
    iterations: int = 500,
    confidence: float = 0.95,
    least: int = 4,
) -> DataFrame:
    """(series_id, statistic, point_estimate, ci_lower, ci_upper, iterations).

    ``series`` holds series_id, position, value and, where a statistic wants it, companion. A series
    with fewer than ``least`` values has its point estimate alone.
    """
    whole = prepared(series)
    chunks = F.transform(
        F.sequence(F.lit(0), F.lit(iterations - 1), F.lit(CHUNK)),
        lambda i: F.struct(i.alias("first"), F.least(i + (CHUNK - 1), F.lit(iterations - 1)).alias("last")),
    )
    none = F.array(F.struct(F.lit(0).alias("first"), F.lit(-1).alias("last")))
    chunk = F.explode(F.when(F.size("x") >= least, chunks).otherwise(none)).alias("chunk")
    rows = whole.select("series_id", F.col("series_id").cast("string").alias("tag"), "x", "y", chunk)
    rows = rows.select("series_id", "tag", "x", "y", "chunk.first", "chunk.last")
    # an explicit count: a small row means much work, so merging small partitions would starve the tasks
    tasks = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = range(len(statistics))
    schema = ", ".join([f"p{k} double" for k in names] + [f"s{k} array<double>" for k in names])
    kind = series.schema["series_id"].dataType.simpleString()
    made = rows.repartition(tasks, "series_id", "first").mapInArrow(_estimates(blocks, statistics, seed), f"series_id {kind}, {schema}")

    def present(k: int) -> Column:
        return F.array_sort(F.filter(F.flatten(F.collect_list(f"s{k}")), lambda v: ~F.isnan(v)))

    gathered = made.groupBy("series_id").agg(*[F.first(f"p{k}").alias(f"p{k}") for k in names], *[present(k).alias(f"s{k}") for k in names])
    each = [F.struct(F.lit(n).alias("statistic"), F.nanvl(f"p{k}", F.lit(None)).alias("point"), F.col(f"s{k}").alias("s")) for k, n in enumerate(statistics)]
    spread = gathered.select("series_id", F.inline(F.array(*each)))
    tail = (1 - confidence) / 2
    return spread.select(
        "series_id",
        "statistic",
        F.col("point").alias("point_estimate"),
        _quantile(F.col("s"), tail).alias("ci_lower"),
        _quantile(F.col("s"), 1 - tail).alias("ci_upper"),
        F.size("s").cast("long").alias("iterations"),
    )


def moving_block_bootstrap(
    series: DataFrame,
    block_length: int = 10,
    iterations: int = 500,
    seed: int = 0,
    confidence: float = 0.95,
    statistics: Sequence[str] | dict[str, Statistic] = ("mean",),
) -> DataFrame:
    """Confidence intervals from resampled blocks of one length."""
    if block_length < 1:
        raise ValueError("a block holds at least one value")
    chosen = statistics if isinstance(statistics, dict) else {k: STATISTICS[k] for k in statistics}
    return block_bootstrap(series, moving_blocks(block_length), chosen, seed, iterations, confidence, max(4, block_length))


def stationary_bootstrap(
    series: DataFrame,
    expected_length: float = 10.0,
    iterations: int = 500,
    seed: int = 0,
    confidence: float = 0.95,
    statistics: Sequence[str] | dict[str, Statistic] = ("mean",),
) -> DataFrame:
    """Like the block bootstrap with geometric block lengths on a circle."""
    if expected_length < 1:
        raise ValueError("a block holds at least one value")
    chosen = statistics if isinstance(statistics, dict) else {k: STATISTICS[k] for k in statistics}
    return block_bootstrap(series, stationary_blocks(expected_length), chosen, seed, iterations, confidence)
