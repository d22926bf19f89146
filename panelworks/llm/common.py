"""Shared small helpers: tables, checkpoints, size-checked broadcasts and hashes of spans."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.session import ensure_checkpoint_dir, stored as stored

#: A side of a join is broadcast only when its counted rows stay below this (narrow rows only).
BROADCAST_ROWS = 1_000_000

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def broadcast_if_small(side: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Count a (materialised) narrow table and broadcast it only below ``limit`` rows."""
    return F.broadcast(side) if side.limit(limit + 1).count() <= limit else side


def free_names(columns: Sequence[str], *wanted: str) -> list[str]:
    """The wanted names, each led by underscores until no column has it (names are compared without case)."""
    taken = {c.lower() for c in columns}
    found = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        found.append(name)
    return found


def column(name: str) -> Column:
    """A column by its exact name, dots and back-quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id as text modulo ``divisor``; NULL for a NULL id."""
    return F.crc32(F.col(doc_id).cast("string")) % divisor


def batches(rows: Iterable[pa.RecordBatch], max_chars: int = 4_000_000, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut record batches so that one slice holds at most about ``max_chars`` of text (or one row)."""
    for batch in rows:
        sizes = np.diff(_offsets(batch.column(text)))
        start, total = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and total + size > max_chars:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)


def _offsets(column: pa.Array) -> np.ndarray:
    """Byte offsets of a string column, whatever its offset width."""
    wide = column.cast(pa.large_string())
    return np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = pow(_ODD, -1, 1 << 64)
        _POWERS[:] = [
            np.multiply.accumulate(np.append(np.ones(1, dtype=np.uint64), np.full(size - 1, x, dtype=np.uint64)))
            for x in (_ODD, inverse)
        ]
    return _POWERS[0][:n], _POWERS[1][:n]


def span_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of many byte spans of one buffer: equal bytes give equal hashes."""
    raw = np.frombuffer(data, dtype=np.uint8)
    up, down = _powers(len(raw) + 1)
    sums = np.empty(len(raw) + 1, dtype=np.uint64)
    sums[0] = 0
    # bytes are spread over 64 bits first, so that short spans do not stay small
    np.cumsum(_SPREAD[raw] * up[: len(raw)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_SPREAD = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of other bytes than ASCII white space)."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def arrow_batch(columns: dict[str, object], types: Sequence[pa.DataType]) -> pa.RecordBatch:
    arrays = [pa.array(v, type=t) for v, t in zip(columns.values(), types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))
