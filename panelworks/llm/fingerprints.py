"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is the multiset of its paragraphs (lines; long ones are cut at sentence
ends, and sentences every ``PIECE`` code points, so that an edit stays local).
The digest of a paragraph and its occurrence is hashed into three cells of a
sketch, each holding a count, the XOR of digests and the XOR of check values.
Two sketches of one size subtract cell by cell; peeling cells with a single
digest recovers the differing digests of both sides. Where peeling gets stuck, the
pair is tried again with sketches ``GROWTH`` times as large. The likeness of two
texts is the Jaccard similarity of their paragraph multisets that follows from
the recovered digests.

Documents are dealt by evenly wide ranges of their ids and walked in descending
order; the first document of a range is also sent to the range before it, so that
each document meets the next one with a single exchange of the texts. Ids spread
in any way give the same result, evenly spread ones the most even tasks.

Defined results: NULL and empty texts have no paragraphs and are all alike (1.0);
rows with one id come in the order of their texts; NULL ids come last; a table of
one row is its own next document.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.llm.common import batches, mixed, span_hashes, whole_text

PIECE = 160
CELLS, GROWTH = 24, 4
CHARS_PER_RANGE = 4_000_000
#: The table of range heads is broadcast, so there are at most this many ranges.
MOST_RANGES = 200_000
SENTENCE = re.compile(r"(?<=[.!?]) ")


def pieces(text: str) -> list[str]:
    if not text:
        return []
    found: list[str] = []
    for line in text.split("\n"):
        if len(line) <= PIECE:
            found.append(line)
            continue
        for sentence in SENTENCE.split(line):
            found += [sentence[at : at + PIECE] for at in range(0, len(sentence), PIECE)] or [""]
    return found


class Digests:
    """Paragraph digests of many texts in one array; ``owner`` says whose each one is."""

    def __init__(self, texts: list[str]) -> None:
        parts = [pieces(t) for t in texts]
        self.sizes = np.array([len(p) for p in parts], dtype=np.int64)
        encoded = [p.encode("utf-8", "surrogatepass") for ps in parts for p in ps]
        ends = np.cumsum([len(e) for e in encoded], dtype=np.int64)
        starts = ends - np.array([len(e) for e in encoded], dtype=np.int64)
        hashes = span_hashes(b"".join(encoded), starts, ends) if encoded else np.empty(0, dtype=np.uint64)
        owner = np.repeat(np.arange(len(texts)), self.sizes)
        order = np.lexsort((hashes, owner))
        self.owner, hashes = owner[order], hashes[order]
        new = np.ones(len(hashes), dtype=bool)
        new[1:] = (self.owner[1:] != self.owner[:-1]) | (hashes[1:] != hashes[:-1])
        run = np.flatnonzero(new)
        occurrence = np.arange(len(hashes)) - np.repeat(run, np.diff(np.append(run, len(hashes))))
        self.keys = mixed(hashes + occurrence.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def of(self, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, number) for a list of texts, numbered by their place in the list; texts may repeat."""
        first = np.concatenate(([0], np.cumsum(self.sizes)))
        sizes = self.sizes[owners]
        number = np.repeat(np.arange(len(owners)), sizes)
        offset = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.keys[np.repeat(first[owners], sizes) + offset], number


class Sketches:
    """A row of sketches of equal size side by side; they add, subtract and peel together."""

    def __init__(self, n: int, cells: int) -> None:
        self.n, self.cells = n, cells
        self.count = np.zeros(n * cells, dtype=np.int64)
        self.keys = np.zeros(n * cells, dtype=np.uint64)
        self.checks = np.zeros(n * cells, dtype=np.uint64)

    @staticmethod
    def check(keys: np.ndarray) -> np.ndarray:
        return mixed(keys ^ np.uint64(0xC2B2AE3D27D4EB4F))

    def places(self, keys: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The three cells of each key, one in each third of its sketch."""
        third = self.cells // 3
        h = [mixed(keys + np.uint64(k + 1)) % np.uint64(third) for k in range(3)]
        return np.stack([number * self.cells + k * third + h[k].astype(np.int64) for k in range(3)])

    def put(self, keys: np.ndarray, number: np.ndarray, sign: np.ndarray | int) -> None:
        checks = self.check(keys)
        for at in self.places(keys, number):
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.keys, at, keys)
            np.bitwise_xor.at(self.checks, at, checks)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(digests only in the first, only in the second, solved) per sketch; empties the solved ones."""
        left, right = np.zeros(self.n, dtype=np.int64), np.zeros(self.n, dtype=np.int64)
        look = np.arange(len(self.count))
        while len(look):
            pure = look[(np.abs(self.count[look]) == 1) & (self.checks[look] == self.check(self.keys[look]))]
            if not len(pure):
                break
            number = pure // self.cells
            by = np.lexsort((self.keys[pure], number))
            pure, number = pure[by], number[by]
            once = np.ones(len(pure), dtype=bool)
            once[1:] = (number[1:] != number[:-1]) | (self.keys[pure[1:]] != self.keys[pure[:-1]])
            pure, number = pure[once], number[once]
            keys, sign = self.keys[pure].copy(), self.count[pure].copy()
            np.add.at(left, number, sign > 0)
            np.add.at(right, number, sign < 0)
            look = np.unique(self.places(keys, number))
            self.put(keys, number, -sign)
        open_cells = (self.count != 0) | (self.keys != 0)
        return left, right, ~open_cells.reshape(self.n, self.cells).any(axis=1)

    def text(self, number: int, size: int) -> str:
        """One sketch as a string: the number of paragraphs and the cells."""
        at = slice(number * self.cells, (number + 1) * self.cells)
        body = b"".join(
            (
                self.count[at].astype("<i4").tobytes(),
                self.keys[at].astype("<u8").tobytes(),
                (self.checks[at] & np.uint64(0xFFFF)).astype("<u2").tobytes(),
            )
        )
        return f"{size}:{base64.b64encode(body).decode()}"


def likeness(one: Digests, two: Digests, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Jaccard similarity of texts ``first`` of ``one`` and ``second`` of ``two``, by sketch differences."""
    near = np.ones(len(first))
    todo, cells = np.arange(len(first)), CELLS
    while len(todo):
        difference = Sketches(len(todo), cells)
        difference.put(*one.of(first[todo]), 1)
        difference.put(*two.of(second[todo]), -1)  # cell by cell the same as subtracting the second sketch
        left, right, solved = difference.peel()
        size = one.sizes[first[todo]]
        union = size + right
        done = todo[solved]
        near[done] = np.where(union > 0, (size - left) / np.maximum(union, 1), 1.0)[solved]
        todo, cells = todo[~solved], cells * GROWTH
    return near


def _walk(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in; each row that is no guest of its range comes out with the row after it."""
    pending: list[tuple] = []
    for batch in batches(rows):
        new = list(zip(*(batch.column(c).to_pylist() for c in ("range", "doc_id", "guest", "text")), strict=True))
        id_type = batch.column("doc_id").type
        pending += new
        if len(pending) > 1:
            yield _described(pending, id_type)
            pending = pending[-1:]
    # the last row of a range is always a guest


def _described(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    at = [i for i in range(len(rows) - 1) if not rows[i][2]]
    texts = [r[3] for r in rows]
    edited = []
    for i in at:
        third = len(texts[i]) // 3
        edited.append(texts[i][: len(texts[i]) - third] + texts[i + 1][:third])
    own, changed = Digests(texts), Digests(edited)
    here, there = np.array(at, dtype=np.int64), np.arange(len(at))
    sketch, sketch_edited = Sketches(len(rows), CELLS), Sketches(len(at), CELLS)
    sketch.put(own.keys, own.owner, 1)
    sketch_edited.put(changed.keys, changed.owner, 1)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([rows[i][1] for i in at], type=id_type),
            pa.array([len(texts[i]) for i in at], type=pa.int64()),
            pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], type=pa.string()),
            pa.array([sketch.text(i, int(own.sizes[i])) for i in at], type=pa.string()),
            pa.array([sketch_edited.text(k, int(changed.sizes[k])) for k in range(len(at))], type=pa.string()),
            pa.array(likeness(own, changed, here, there), type=pa.float64()),
            pa.array(likeness(own, own, here, here + 1), type=pa.float64()),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _range_of(doc_id: Column, lowest: int, highest: int, ranges: int) -> Column:
    """Number of the id's range, counted from the highest id; NULL ids come after all."""
    width = (highest - lowest + 1) / ranges
    at = F.floor((F.lit(float(highest)) - doc_id.cast("double")) / F.lit(width)).cast("long")
    return F.coalesce(F.least(at, F.lit(ranges - 1)), F.lit(ranges)).cast("long")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited text, and their likeness to each other and to the next text."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", whole_text())
    facts = rows.agg(F.min("doc_id"), F.max("doc_id"), F.sum(F.length("text")), F.count(F.lit(1))).first()
    lowest, highest, chars, n = facts[0] or 0, facts[1] or 0, facts[2] or 0, facts[3]
    least = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(max(-(-chars // CHARS_PER_RANGE), least), n // 8, MOST_RANGES))
    placed = rows.withColumn("range", _range_of(F.col("doc_id"), lowest, highest, ranges))
    # the first document of every range that is not empty, and the range before it (one row per range)
    tops = placed.groupBy("range").agg(F.max("doc_id").alias("top"))
    order = Window.orderBy("range")
    before = F.coalesce(F.lag("range").over(order), F.max("range").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    guests = tops.select("top", before.alias("before"))
    visiting = rows.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("top")))
    every = placed.withColumn("guest", F.lit(False)).unionByName(
        visiting.select("doc_id", "text", F.col("before").alias("range"), F.lit(True).alias("guest"))
    )
    dealt = every.repartition("range").sortWithinPartitions("range", "guest", F.col("doc_id").desc_nulls_last(), "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return dealt.select("range", "doc_id", "guest", "text").mapInArrow(_walk, schema)
