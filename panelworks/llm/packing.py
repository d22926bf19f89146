"""Packing of tokenised documents into windows by non-negative least squares over length combinations.

Every document becomes the ids of its whole text and one closing id. Stretches that fill
a window are sequences of their own; the shorter tails are sorted into classes of ``CLASS``
ids of length. Combinations of at most ``DEPTH`` classes that add up to a window are
enumerated, and non-negative least squares finds how often to repeat each of them so that the
histogram of the classes is used up. The counts are rounded down and raised again where
tails are left. A sequence of a combination exceeds the window by less than
``DEPTH * CLASS`` ids, which are cut from its longest member. What is left (cuttings and tails
without a combination) is packed greedily in each task, longest first, cutting at the window.
The last window of a task is cut at powers of two, where no padding is needed, so no
sequence has any.

Only the histogram (one row per class) meets on the driver. Tails get their combination from
their number within their class, which comes from counts per task; a class may hold any number
of tails. The ids lie in a table in the shared folder, in stretches of at most one window.

Defined results: NULL and empty texts are the closing id alone; NULL or repeated ids and
repeated rows are documents of their own; a very long text is cut into windows within one task;
an empty table gives no pieces; other columns are not read. Ties between tails are broken by
their place in the written table. Texts are encoded chunk by chunk between blanks,
which the tokeniser's pattern never crosses, so the ids are those of the whole text.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelworks.llm.common import batches, whole_text
from panelworks.session import ensure_checkpoint_dir

WINDOW = 2048
#: width of a length class; also bounds what is cut from a sequence
CLASS = 16
DEPTH = 3
CLOSING = 1
#: entries of a worker's memory of encoded chunks, and the longest chunk it holds
REMEMBERED, REMEMBERED_LENGTH = 1_000_000, 48
#: outside of these letters, lower case may depend on neighbours or on normal forms; the mark begins a special token
PLAIN_CASE = re.compile("[^\x00-\u012f\u0131-\u017f]|<[|]")
#: a match of the tokeniser's pattern that begins with one of these holds nothing before it
MARKS = ".,!?;:*$#"


def _plain(text: str) -> bool:
    try:
        text.encode("latin-1")  # fast, and inside the bound
    except UnicodeEncodeError:
        return not PLAIN_CASE.search(text)
    return "<|" not in text


class ChunkEncoder:
    """Ids of texts as packed unsigned 16-bit numbers, remembering the ids of chunks between blanks.

    Where that cannot change the ids, chunks are remembered in lower case and without the marks behind a letter.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        self.known: dict[str, bytes] = {"": b""}
        # the letters of lower-case words below the bound of PLAIN_CASE, as the model spells their bytes
        spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        letters = [chr(c) for c in range(128, 0x180) if chr(c).isalpha()]
        self.spelling = {ord(c): spelled(c)[0][0] for c in letters}
        self.model = self.tokenizer.model  # a word of letters is one piece, which normal forms leave alone

    def _ids(self, chunk: str) -> bytes:
        if chunk.isalpha() and chunk.islower() and (chunk.isascii() or not PLAIN_CASE.search(chunk)):
            ids = [token.id for token in self.model.tokenize(chunk.translate(self.spelling))]
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}H", *ids)

    def _remembered(self, chunk: str) -> bytes:
        ids = self.known.get(chunk)
        if ids is None:
            ids = self._ids(chunk)
            if len(chunk) <= REMEMBERED_LENGTH:
                self.known[chunk] = ids
        return ids

    def _learn(self, chunks: Iterable[str]) -> dict[str, bytes]:
        """Ids of chunks that are not remembered."""
        if len(self.known) > REMEMBERED:
            self.known = {"": b""}
        found = {}
        for c in chunks:
            core = c.rstrip(MARKS)
            if len(core) < len(c) and core[-1:].isalpha():
                found[c] = self._remembered(core) + self._remembered(c[len(core) :])
                if len(c) <= REMEMBERED_LENGTH:
                    self.known[c] = found[c]
            else:
                found[c] = self._remembered(c)
        return found

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        plain = [t.lower() if _plain(t) else t for t in texts]
        cut = [t.replace("\n", " ").replace("\t", " ").split(" ") for t in plain]
        ids = [list(map(self.known.get, chunks)) for chunks in cut]
        new = {c for chunks, found in zip(cut, ids) if None in found for c, i in zip(chunks, found) if i is None}
        learned = self._learn(new) if new else {}
        return [
            b"".join([learned[c] if i is None else i for c, i in zip(chunks, found)] if None in found else found)
            for chunks, found in zip(cut, ids)
        ]


_ENCODERS: dict[str, ChunkEncoder] = {}


def stretches(docs: DataFrame, path: str, window: int = WINDOW, closing: int = CLOSING) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): every document's ids, cut at multiples of the window."""

    def cut(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = ChunkEncoder(path)
        own = _ENCODERS[path]
        last = np.array([closing], dtype="<u2").tobytes()
        for batch in batches(rows, max_chars=1_000_000, text="_text"):
            row, start, size, whole, parts = [], [], [], [], []
            for i, ids in enumerate(own.encode_all(batch.column("_text").to_pylist())):
                ids += last
                for at in range(0, len(ids), 2 * window):
                    row.append(i)
                    start.append(at // 2)
                    parts.append(ids[at : at + 2 * window])
                    size.append(len(parts[-1]) // 2)
                    whole.append(len(ids) // 2)
            numbers = [pa.array(v, type=pa.int64()) for v in (start, size, whole)]
            doc = batch.column("doc_id").take(pa.array(row, type=pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [doc, *numbers, pa.array(parts, type=pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "ids"]
            )

    chosen = docs.select("doc_id", whole_text("text").alias("_text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(cut, f"doc_id {kind}, start long, length long, doc_tokens long, ids binary")


def combinations(units: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Every multiset of at most ``depth`` classes of one unit or more that adds up to ``units``."""
    found = []
    for size in range(2, depth + 1):
        for first in combinations_with_replacement(range(1, units), size - 1):
            rest = units - sum(first)
            if rest >= first[-1]:
                found.append((*first, rest))
    return found


def non_negative_least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The x >= 0 that minimises the length of a x - b: columns enter by the steepest gradient, leave at zero."""
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, dtype=bool)
    for _ in range(3 * n):
        gradient = a.T @ (b - a @ x)
        gradient[used] = -np.inf
        new = int(np.argmax(gradient))
        if gradient[new] <= 1e-10 * max(1.0, float(np.abs(b).max(initial=0))):
            break
        used[new] = True
        while used.any():
            best = np.zeros(n)
            best[used] = np.linalg.lstsq(a[:, used], b, rcond=None)[0]
            low = used & (best <= 0)
            if not low.any():
                break
            step = (x[low] / np.maximum(x[low] - best[low], 1e-300)).min()
            x += step * (best - x)
            used &= x > 1e-12
            x[~used] = 0
        x = best if used.any() else x
    return x


def repeat_counts(histogram: dict[int, int], units: int, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats) that fit into the histogram of classes."""
    classes = {c: n for c, n in histogram.items() if n > 0 and 0 < c < units}
    kinds = [k for k in combinations(units, depth) if all(c in classes for c in k)]
    if not kinds:
        return []
    order = sorted(classes)
    place = {c: i for i, c in enumerate(order)}
    a = np.zeros((len(order), len(kinds)))
    for j, kind in enumerate(kinds):
        for c in kind:
            a[place[c], j] += 1
    counts = np.array([classes[c] for c in order], dtype=float)
    scale = counts.max()
    x = non_negative_least_squares(a, counts / scale) * scale
    left, repeats = counts.astype(np.int64), np.zeros(len(kinds), dtype=np.int64)
    ranked = np.argsort(-x, kind="stable")
    for rounding in (np.floor(x + 1e-6), np.full(len(kinds), np.inf)):  # rounded, then raised while tails are left
        for j in ranked:
            need = a[:, j].astype(np.int64)
            most = int((left[need > 0] // need[need > 0]).min())
            extra = int(min(most, rounding[j]))
            repeats[j] += extra
            left -= extra * need
    return [(kinds[j], int(repeats[j])) for j in ranked if repeats[j]]


def _numbered(tails: DataFrame) -> DataFrame:
    """The 0-based number of each tail within its class: its place in its task and the counts of earlier tasks."""
    placed = tails.withColumn("task", F.shiftright("piece", 33))
    counts = placed.groupBy("class", "task").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("class", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    here = F.row_number().over(Window.partitionBy("class", "task").orderBy("piece")) - 1
    return placed.withColumn("at", here).join(counts, ["class", "task"]).withColumn("at", F.col("at") + F.col("before"))


def _combined(tails: DataFrame, plan: list[tuple[tuple[int, ...], int]]) -> DataFrame:
    """``tails`` with the number of their combined sequence (NULL: none)."""
    used: dict[int, int] = {}
    slots, base = [], 0
    for kind, repeats in plan:
        for c in sorted(set(kind)):
            members = kind.count(c)
            start = used.get(c, 0)
            slots.append((c, start, start + members * repeats, base, repeats))
            used[c] = start + members * repeats
        base += repeats
    spark = tails.sparkSession
    table = spark.createDataFrame(slots, "class long, low long, high long, base long, repeats long")
    # one row for each class of each used combination: bounded by the classes, whatever the number of documents
    inside = (tails["class"] == table["class"]) & (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high"))
    found = tails.join(F.broadcast(table), inside, "left").drop(table["class"])
    return found.withColumn("combined", F.col("base") + (F.col("at") - F.col("low")) % F.col("repeats"))


_PLACED = "piece long, skip long, length long, sequence_id long, offset long"


def _greedy(window: int):
    """Pieces of one task one after the other, cut at windows; the last window is cut at powers of two."""

    def pack(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 33
        out: list[tuple[int, int, int, int, int]] = []
        opened: list[tuple[int, int, int]] = []  # pieces of the open window, fewer than its ids
        filled = 0

        def close(size: int, parts: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
            """Emit one sequence of ``size`` ids from the front of ``parts``; gives the rest back."""
            nonlocal sequence
            at, rest = 0, []
            for piece, skip, length in parts:
                here = min(length, size - at)
                if here:
                    out.append((piece, skip, here, 3 * sequence + 2, at))
                    at += here
                if length > here:
                    rest.append((piece, skip + here, length - here))
            sequence += 1
            return rest

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * 5
            out.clear()
            arrays = [pa.array(c, type=pa.int64()) for c in columns]
            return pa.RecordBatch.from_arrays(arrays, names=["piece", "skip", "length", "sequence_id", "offset"])

        for block in rows:
            for piece, skip, length in zip(*[block.column(c).to_pylist() for c in ("piece", "skip", "length")]):
                opened.append((piece, skip, length))
                filled += length
                while filled >= window:
                    opened = close(window, opened)
                    filled -= window
            yield batch()
        while filled:
            power = 1 << (filled.bit_length() - 1)
            opened = close(power, opened)
            filled -= power
        yield batch()

    return pack


def pieces(docs: DataFrame, path: str, window: int = WINDOW, width: int = CLASS, depth: int = DEPTH) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids) of every piece; ``ids`` are packed
    little-endian unsigned 32-bit numbers. Sequence numbers are unique, not dense."""
    if window % width or window < 2 * width:
        raise ValueError("the window must be a multiple of the class width")
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/packing-{uuid.uuid4()}"
    stretches(docs, path, window).withColumn("piece", F.monotonically_increasing_id()).write.parquet(folder)
    table = spark.read.parquet(folder)
    tails = table.where(F.col("length") < window).select("piece", "length", F.floor(F.col("length") / width).alias("class"))
    histogram = {r["class"]: r["count"] for r in tails.groupBy("class").count().collect()}
    plan = repeat_counts(histogram, window // width, depth)
    combined = _combined(_numbered(tails), plan)

    # the longest member comes last and gives up what exceeds the window
    members = Window.partitionBy("combined").orderBy("length", "piece")
    sequences = combined.where("combined IS NOT NULL").select(
        "piece",
        "length",
        (3 * F.col("combined")).alias("sequence_id"),
        (F.sum("length").over(members) - F.col("length")).alias("offset"),
        F.greatest(F.sum("length").over(members) - window, F.lit(0)).alias("excess"),
    )
    placed = sequences.select("piece", F.lit(0).cast("long").alias("skip"), (F.col("length") - F.col("excess")).alias("length"), "sequence_id", "offset")
    cuttings = sequences.where("excess > 0").select("piece", (F.col("length") - F.col("excess")).alias("skip"), F.col("excess").alias("length"))
    single = combined.where("combined IS NULL").select("piece", F.lit(0).cast("long").alias("skip"), "length")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rest = single.union(cuttings).repartition(n, "piece").sortWithinPartitions(F.desc("length"), "piece", "skip")
    placed = placed.union(rest.mapInArrow(_greedy(window), _PLACED))

    def widened(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            wide = [np.frombuffer(b, dtype="<u2").astype("<u4").tobytes() for b in batch.column("ids").to_pylist()]
            columns = [*batch.columns[:-1], pa.array(wide, type=pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    full = table.where(F.col("length") == window).select(
        "doc_id", "start", "length", "doc_tokens", (3 * F.col("piece") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids"
    )
    short = table.where(F.col("length") < window).drop("length").join(placed, "piece").select(
        "doc_id",
        (F.col("start") + F.col("skip")).alias("start"),
        "length",
        "doc_tokens",
        "sequence_id",
        "offset",
        F.expr("substring(ids, CAST(2 * skip + 1 AS INT), CAST(2 * length AS INT))").alias("ids"),
    )
    every = full.union(short)
    kind = every.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return every.select(*names).mapInArrow(widened, schema)
