"""Ordinal ranks inside groups of any size, and average ranks."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.session import GROUP_ROWS_PER_TASK, ensure_checkpoint_dir


# A side table up to this many (narrow) rows is broadcast after it was counted.
BROADCAST_ROWS = 2_000_000

#: Rows of one matrix of ranks (at most 65536, a power of two), and cells of a column that one task ranks.
BLOCK_ROWS, PART_CELLS = 1 << 15, 1_000_000


def _broadcast_if_small(side: DataFrame) -> DataFrame:
    """Materialise a per-group table and broadcast it only when its counted size allows.

    A larger one is joined by shuffle, where AQE splits skewed partitions.
    """
    kept = side.checkpoint()
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def ordinal_rank(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    out: str,
    group_rows: int,
    limit: int = GROUP_ROWS_PER_TASK,
) -> DataFrame:
    """1-based position inside ``group`` by ascending ``order`` (a total order).

    ``group_rows`` is a known upper bound on the rows of one group (for a
    cross-section: the number of symbols). Groups that fit one task are ranked
    by a window. Larger ones are range-partitioned on ``group + order``, so a
    group may span any number of tasks: each task knows a row's position among
    its own rows, and the earlier tasks' counts are added from a table with one
    row per (task, group) pair.
    """
    if group_rows <= limit:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    ensure_checkpoint_dir(df.sparkSession)
    placed = (
        df.repartitionByRange(*group, *order)
        .sortWithinPartitions(*group, *order)
        .withColumns({"_task": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
        .checkpoint()  # both uses below must see one placement, also after a lost executor
    )
    runs = placed.groupBy(*group, "_task").agg(F.min("_at").alias("_start"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")
    runs = _broadcast_if_small(runs)
    position = (F.col("_at") - F.col("_start") + F.col("_before") + 1).cast("long")
    return placed.join(runs, [*group, "_task"]).withColumn(out, position).drop("_task", "_at", "_start", "_before")


def with_group_stats(
    df: DataFrame,
    group: Sequence[str],
    stats: dict[str, Column],
    group_rows: int,
    order: Sequence[str] = (),
    limit: int = GROUP_ROWS_PER_TASK,
) -> DataFrame:
    """Attach group aggregates to every row.

    Groups that fit one task share the exchange of the ranks that follow, and
    with ``order`` (the order of those ranks) also their sort. Larger
    ones are aggregated with map-side combine and joined back, so no task ever
    holds a whole group.
    """
    if not stats:
        return df
    if group_rows <= limit:
        whole = Window.partitionBy(*group)
        if order:
            whole = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return df.withColumns({name: agg.over(whole) for name, agg in stats.items()})
    ensure_checkpoint_dir(df.sparkSession)
    df = df.checkpoint()  # the input is read twice below
    totals = df.groupBy(*group).agg(*[agg.alias(name) for name, agg in stats.items()])
    return df.join(_broadcast_if_small(totals), list(group))


def average_ranks_by_value(
    df: DataFrame, group: Sequence[str], value: str, out: str, group_rows: int, limit: int = GROUP_ROWS_PER_TASK
) -> DataFrame:
    """Average ranks through a value histogram.

    Equal values are counted before anything is ordered, so a value that fills
    a third of the rows is one histogram row. The histogram of a group of up to ``limit``
    rows is ordered by one task; that of a larger one is range-partitioned on group and
    value, and the earlier tasks' counts are added. NULL values keep a NULL rank.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    if group_rows <= limit:
        below = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("_n").over(below), F.lit(0))
    else:
        ensure_checkpoint_dir(df.sparkSession)
        counts = counts.repartitionByRange(*group, value).withColumn("_task", F.spark_partition_id()).checkpoint()
        runs = counts.groupBy(*group, "_task").agg(F.sum("_n").alias("_rows"))
        earlier = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
        runs = runs.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")
        below = Window.partitionBy(*group, "_task").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.join(_broadcast_if_small(runs), [*group, "_task"])
        before = F.coalesce(F.sum("_n").over(below), F.lit(0)) + F.col("_before")
    ranks = counts.select(*group, value, (before + (F.col("_n") - 1) / 2).alias(out))
    return df.join(ranks, [*group, value], "left")


def running_extreme(
    df: DataFrame, family: Sequence[str], position: str, value: str, out: str, largest: bool, block: int = 1_000_000
) -> DataFrame:
    """Running maximum (or minimum) of ``value`` by 1-based ``position`` in a family.

    Positions are cut into blocks: each block runs on its own, and the extreme of
    all earlier blocks comes from a table with one row per block.
    """
    pick = F.max if largest else F.min
    combine = F.greatest if largest else F.least
    cut = df.withColumn("_block", F.floor((F.col(position) - 1) / block))
    key = [*family, "_block"]
    before = Window.partitionBy(*family).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut.groupBy(*key).agg(pick(value).alias("_top")).withColumn("_earlier", pick("_top").over(before))
    inside = Window.partitionBy(*key).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.withColumn(out, pick(value).over(inside)).join(blocks.drop("_top"), key)
    return joined.withColumn(out, combine(F.col(out), F.col("_earlier"))).drop("_block", "_earlier")


# --- ranks of many columns -----------------------------------------------------------------------


class Cells(NamedTuple):
    """The cells of one column in a block of rows, by value: the distinct values, how often each occurs and how often as a
    hit (if hits matter), and a small number that goes along with each cell, in that order."""

    value: np.ndarray
    n: np.ndarray
    hits: np.ndarray
    rest: np.ndarray


class Placed(NamedTuple):
    """The same cells with their place in the whole column: per distinct value twice the average rank less its mean, or
    the cells (and hits) ahead; and the cells and hits of the column."""

    at: np.ndarray
    hits_at: np.ndarray
    n: np.ndarray
    rest: np.ndarray
    rows: int
    hits: int


def ordered_cells(values: np.ndarray, rest: np.ndarray, hit: np.ndarray | None = None) -> Cells:
    """Equal values keep the order of the rows; NaN is the largest value and equal to itself."""
    order = np.argsort(values, kind="stable")
    placed = values[order]
    new = (placed[1:] != placed[:-1]) & ~(np.isnan(placed[1:]) & np.isnan(placed[:-1]))
    first = np.flatnonzero(np.append(True, new)) if len(placed) else np.zeros(0, dtype=np.int64)
    n = np.diff(np.append(first, len(placed))).astype(np.int32)
    hits = np.zeros(0, dtype=np.int32)
    if hit is not None and len(placed):
        hits = np.add.reduceat(hit[order], first, dtype=np.int32)
    return Cells(placed[first], n, hits, rest[order])


def _packed(values: np.ndarray) -> bytes:
    """Numbers with their first bytes together, compressed: sorted ones shrink to little more than what differs."""
    if not len(values):
        return b""
    spread = values.view(np.uint8).reshape(len(values), -1).T.tobytes()
    return pa.Codec("zstd").compress(spread, asbytes=True)


def _unpacked(data: bytes, dtype: type, n: int) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    if not data:
        return np.zeros(0, dtype=dtype)
    spread = pa.Codec("zstd").decompress(data, n * width, asbytes=True)
    return np.frombuffer(spread, dtype=np.uint8).reshape(width, n).T.copy().view(dtype).reshape(n)


def part_edges(drawn: DataFrame, columns: Sequence[str | Column], parts: int) -> list[np.ndarray]:
    """Values that cut each column into about equal parts. A thin draw of rows serves: edges only balance the tasks."""
    if parts <= 1:
        return [np.zeros(0)] * len(columns)
    shares = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    found = drawn.agg(*[F.percentile_approx(c, shares, F.lit(100 * parts)).alias(f"e{i}") for i, c in enumerate(columns)]).first()
    edges = [np.unique(np.array(e or [], dtype=float)) for e in found]
    return [e[~np.isnan(e)] for e in edges]


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """A task's rows in order, ``rows`` at a time."""
    held, size = [], 0
    for batch in batches:
        while batch.num_rows:
            held.append(batch.slice(0, rows - size))
            batch, size = batch.slice(len(held[-1])), size + len(held[-1])
            if size == rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def fold_ranks(
    rows: DataFrame,
    cut: Callable[[pa.Table], tuple[np.ndarray, list[Cells]]],
    fold: Callable[[np.ndarray, list[Placed]], pa.Table],
    schema: str,
    edges: list[np.ndarray],
    ordinal: Collection[int] = (),
    block_rows: int | None = None,
) -> DataFrame:
    """``fold`` of every block of rows, given what ``cut`` made of it and the ranks of its cells in their whole columns.

    ``cut`` turns a block into numbers of its own, which come along, and the cells of each column, which ``edges`` cut into
    parts. The distinct values of a block and part go, packed, to the task that ranks this part, which sends back their
    ranks in the same order and the size of the part. So rows are read once, and a cell costs its value once, what goes
    along with it twice and a small difference of ranks. In the ``ordinal`` columns equal values rank in the order of
    partitions and rows (each has a place of its own), in others by their average rank.
    """
    block_rows = block_rows or BLOCK_ROWS

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for number, table in enumerate(_blocks(batches, block_rows)):
            own, columns = cut(table)
            made = [(-1, first + number, first + number, 0, len(own), _packed(own), b"", b"", b"")]
            for k, (cells, e) in enumerate(zip(columns, edges, strict=True)):
                ends = [0, *np.searchsorted(cells.value, e, side="left").tolist(), len(cells.value)]
                upto = np.append(0, np.cumsum(cells.n, dtype=np.int64))
                for part, (a, b) in enumerate(zip(ends, ends[1:])):  # empty ones too: they bring back the part's size
                    along = cells.rest[upto[a] : upto[b]]
                    packed = [_packed(x) for x in (cells.value[a:b], cells.n[a:b], cells.hits[a:b], along)]
                    made.append((k, part, first + number, b - a, len(along), *packed))
            names = ["c", "p", "block", "distinct", "size", "value", "n", "hits", "rest"]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made)], names=names)

    def ranked(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        got = table.to_pydict()
        if got["c"][0] < 0:
            at, hits_at, size, hit = got["value"], got["hits"], 0, 0
        else:
            n, hits = (np.concatenate([_unpacked(x, np.int32, d) for x, d in zip(got[c], got["distinct"])]) for c in ("n", "hits"))
            values = np.concatenate([_unpacked(x, np.float64, d) for x, d in zip(got["value"], got["distinct"])])
            size, hit, cuts = int(n.sum()), int(hits.sum()), np.cumsum(got["distinct"])[:-1]
            if got["c"][0] in ordinal:
                order = np.argsort(values, kind="stable")
                ahead = [np.zeros(len(x), dtype=np.int64) for x in (n, hits)]
                for to, x in zip(ahead, (n, hits)):
                    if len(x):
                        to[order] = np.cumsum(x[order], dtype=np.int64) - x[order]
            else:
                _, where = np.unique(values, return_inverse=True)
                equal = np.bincount(where, n).astype(np.int64)
                ahead = [(2 * (np.cumsum(equal) - equal) + equal)[where], np.zeros(0, dtype=np.int64)]
            at, hits_at = ([_packed(np.diff(x, prepend=0)) for x in np.split(y, cuts)] if len(y) else [b""] * len(table) for y in ahead)
        kept = table.select(["c", "p", "block", "distinct", "size", "n", "rest"])
        for name, made in (("at", at), ("hits_at", hits_at)):
            kept = kept.append_column(name, pa.array(made, type=pa.binary()))
        for name, made in (("rows", size), ("hits", hit)):
            kept = kept.append_column(name, pa.array([made] * len(table), type=pa.int64()))
        return kept

    def folded(table: pa.Table) -> pa.Table:
        found = table.sort_by([("c", "ascending"), ("p", "ascending")]).to_pylist()
        own = _unpacked(found[0]["at"], np.float64, found[0]["size"])
        columns = []
        for c in range(len(edges)):
            parts = [r for r in found if r["c"] == c]
            size, hits, at, hits_at = 0, 0, [], []
            for r in parts:
                at.append(np.cumsum(_unpacked(r["at"], np.int64, r["distinct"])) + (size if c in ordinal else 2 * size))
                hits_at.append(np.cumsum(_unpacked(r["hits_at"], np.int64, r["distinct"])) + hits)
                size, hits = size + r["rows"], hits + r["hits"]
            at = np.concatenate(at) - (0 if c in ordinal else size)
            n = np.concatenate([_unpacked(r["n"], np.int32, r["distinct"]) for r in parts])
            along = np.concatenate([_unpacked(r["rest"], np.uint16, r["size"]) for r in parts])
            columns.append(Placed(at, np.concatenate(hits_at), n, along, size, hits))
        return fold(own, columns)

    sent = rows.mapInArrow(
        pieces, "c long, p long, block long, distinct long, size long, value binary, n binary, hits binary, rest binary"
    )
    back = sent.groupBy("c", "p").applyInArrow(
        ranked,
        "c long, p long, block long, distinct long, size long, n binary, rest binary, at binary, hits_at binary, rows long, hits long",
    )
    return back.groupBy("block").applyInArrow(folded, schema)


def matrix_of(table: pa.Table, columns: Sequence[str]) -> np.ndarray:
    """Rows x columns; a NULL is NaN."""
    return np.column_stack([table.column(c).to_numpy() for c in columns])


def fold_average_ranks(
    rows: DataFrame,
    columns: Sequence[str],
    own: Callable[[np.ndarray], np.ndarray],
    fold: Callable[[np.ndarray, np.ndarray], pd.DataFrame],
    schema: str,
    n_rows: int,
    drawn: DataFrame | None = None,
    part_cells: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """``fold`` of ``own`` of a block's matrix (rows x columns) and the matrix of its average ranks, less their mean.

    ``rows`` are doubles without NULLs and are read once; ``n_rows`` (about how many there are) sets how many parts a column
    is cut into, by the values of ``drawn`` (about one row in many).
    """
    columns = list(columns)
    parts = -(-n_rows // (part_cells or PART_CELLS))
    edges = part_edges(rows if drawn is None else drawn, columns, parts)

    def cut(table: pa.Table) -> tuple[np.ndarray, list[Cells]]:
        values = matrix_of(table, columns)
        places = np.arange(len(values), dtype=np.uint16)
        return own(values), [ordered_cells(values[:, k], places) for k in range(len(columns))]

    def folded(sums: np.ndarray, placed: list[Placed]) -> pa.Table:
        ranks = np.zeros((len(placed[0].rest), len(placed)))
        for k, c in enumerate(placed):
            ranks[c.rest, k] = np.repeat(c.at, c.n) / 2
        return pa.Table.from_pandas(fold(sums, ranks), preserve_index=False)

    return fold_ranks(rows.select(*columns), cut, folded, schema, edges, block_rows=block_rows)
