"""Byte-level BPE: exact merges in linear time by backtracking over longest matches.

The bytes of a piece are read as Latin-1 characters, so that the trie of an
Aho-Corasick automaton holds every vocabulary entry. The encoder takes the
longest entry at each place it comes to, keeps it only if it may stand beside the entry
before it (merging would not cross the seam), shortens it otherwise and steps
back where nothing fits; every place is left at most once, so the work is linear
in the piece. Two entries may stand side by side exactly when undoing their
merges, latest first, never meets an earlier merge across the seam; answers are
memoised per pair.

Defined results: NULL and empty texts have no ids (the digests are those of the
empty string). A piece that is itself an entry is that one id.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from panelworks.llm.common import batches, whole_text

#: Pieces up to this many characters are remembered, up to this many of them per task.
REMEMBERED_LENGTH, REMEMBERED_PIECES = 40, 500_000
#: A splitting pattern whose matches hold a blank only as their first character or among white space alone.
BLANK_LED_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ranks_of(path: str) -> dict[bytes, int]:
    """The entries of a rank file: one base64 entry and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(entry): int(rank) for entry, rank in map(bytes.split, lines)}


def _put(memory: dict, key: str, ids: tuple[int, ...]) -> None:
    if len(memory) >= REMEMBERED_PIECES:
        memory.clear()
    memory[key] = ids


class BytePairCodec:
    """Encoder and decoder of one vocabulary and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.entries = {rank: entry for entry, rank in ranks.items()}
        self.sizes = {rank: len(entry) for rank, entry in self.entries.items()}
        self.names = {rank: str(rank) for rank in self.entries}
        self.reach = max(map(len, ranks), default=1)
        self.automaton = ahocorasick.Automaton()
        for entry, rank in ranks.items():
            self.automaton.add_word(entry.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merges: dict[tuple[int, int], int] = {}
        self.beside: dict[tuple[int, int], bool] = {}
        for rank in sorted(self.entries):
            self._take_apart(rank)
        self.beside.clear()  # answers from a partial merge table
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.odd_blank = regex.compile(r"\s |[ ]\s|^ | $")
        #: cutting at blanks is only known to be right for patterns that take a blank in front of a match alone
        self.cuts_at_blanks = pattern == BLANK_LED_PATTERN

    def _take_apart(self, rank: int) -> None:
        """Find the longest shorter prefix and the merge that makes an entry."""
        entry = self.entries[rank]
        prefixes = (self.ranks.get(entry[:n], -1) for n in range(len(entry) - 1, 0, -1))
        shorter = [p for p in prefixes if p >= 0]
        self.shorter[rank] = shorter[0] if shorter else -1
        for left in shorter:
            right = self.ranks.get(entry[len(self.entries[left]) :], -1)
            if 0 <= right < rank and left < rank and self._seam_holds(left, right):
                self.parts[rank] = (left, right)
                self.merges[left, right] = rank
                return

    def _seam_holds(self, left: int, right: int) -> bool:
        """Would merging keep the seam between two entries?

        The merges on both sides of the seam are undone from the latest one; a
        merge across it that comes before the one just undone would have won.
        """
        bound = None
        while True:
            across = self.merges.get((left, right))
            if across is not None and (bound is None or across < bound):
                return False
            # of the two, the entry made last goes first; at equal rank the left one was made first
            choices = []
            if left in self.parts:
                choices.append((left, 0))
            if right in self.parts:
                choices.append((right, 1))
            if not choices:
                return True
            rank, side = max(choices)
            if side:
                # a merge of the same rank further left would come first
                bound, right = rank + 1, self.parts[right][0]
            else:
                bound, left = rank, self.parts[left][1]

    def may_stand_beside(self, left: int, right: int) -> bool:
        found = self.beside.get((left, right))
        if found is None:
            if len(self.beside) > 4_000_000:
                self.beside.clear()
            found = self.beside[left, right] = self._seam_holds(left, right)
        return found

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece, as its merges in rank order would leave them."""
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        ranks, sizes, shorter, beside = self.ranks, self.sizes, self.shorter, self.beside
        reach, longest_path = self.reach, self.automaton.longest_prefix
        size = len(piece)
        text = piece.decode("latin-1")
        usable = bytearray(b"\x01") * (size + 1)
        ids: list[int] = []
        at, before, rank = 0, -1, -1
        while at < size:
            if rank < 0:  # the longest entry here: the longest path of the trie, cut to an entry
                length = longest_path(text[at : at + reach])
                while (rank := ranks.get(piece[at : at + length], -1)) < 0:
                    length -= 1
            end = at + sizes[rank]
            if usable[end] and (before < 0 or beside.get((before, rank)) or self.may_stand_beside(before, rank)):
                ids.append(rank)
                at, before, rank = end, rank, -1
            elif shorter[rank] >= 0:
                rank = shorter[rank]
            else:
                usable[at] = 0
                rank = ids.pop()
                at -= sizes[rank]
                before = ids[-1] if ids else -1
        return tuple(ids)

    def _piece(self, piece: str) -> tuple[int, ...]:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.encode_piece(piece.encode("utf-8"))
            if len(piece) <= REMEMBERED_LENGTH:
                _put(self.pieces, piece, ids)
        return ids

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a blank and the white-space-free ``chunk`` after it."""
        ids = tuple(chain.from_iterable(map(self._piece, self.pattern.findall(" " + chunk))))
        if len(chunk) <= REMEMBERED_LENGTH:
            _put(self.chunks, chunk, ids)
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a text.

        A blank between two other characters always begins a match of the
        pattern, so the text may be cut there and the cuts remembered.
        """
        if not self.cuts_at_blanks or self.odd_blank.search(text):
            return list(chain.from_iterable(map(self._piece, self.pattern.findall(text))))
        first, *rest = text.split(" ")
        known, new = self.chunks.get, self._chunk
        ids = list(chain.from_iterable(map(self._piece, self.pattern.findall(first))))
        ids.extend(chain.from_iterable([known(c) or new(c) for c in rest]))
        return ids

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.entries.__getitem__, ids))

    def id_text(self, ids: Sequence[int]) -> str:
        return " ".join(map(self.names.__getitem__, ids))


_CODECS: dict[str, BytePairCodec] = {}


def _shared_codec(spark: SparkSession, path: str, pattern: str):
    """A function that gives the codec inside a task; built once in each worker process."""
    ranks = spark.sparkContext.broadcast(ranks_of(path))  # a vocabulary file, not a table
    key = f"{path}\n{pattern}"

    def codec() -> BytePairCodec:
        if key not in _CODECS:
            _CODECS[key] = BytePairCodec(ranks.value, pattern)
        return _CODECS[key]

    return codec


def encode_documents(docs: DataFrame, path: str, pattern: str, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``ids`` array<int> and the decoded ``bytes`` of every whole text; a map."""
    codec = _shared_codec(docs.sparkSession, path, pattern)

    def encoded(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec()
        for batch in batches(rows, text="_text"):
            ids = [own.encode(t) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in keep],
                    pa.array(ids, type=pa.list_(pa.int32())),
                    pa.array([own.decode(i) for i in ids], type=pa.binary()),
                ],
                names=[*keep, "ids", "bytes"],
            )

    chosen = docs.select(*keep, whole_text("text").alias("_text"))
    return chosen.mapInArrow(encoded, f"{_schema(chosen, keep)}, ids array<int>, bytes binary")


def document_digests(docs: DataFrame, path: str, pattern: str, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Number of ids and the SHA-256 of ids and of decoded bytes, without carrying the ids on."""
    codec = _shared_codec(docs.sparkSession, path, pattern)

    def digested(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec()
        for batch in batches(rows, text="_text"):
            sizes, of_ids, of_bytes = [], [], []
            for text in batch.column("_text").to_pylist():
                ids = own.encode(text)
                sizes.append(len(ids))
                of_ids.append(hashlib.sha256(own.id_text(ids).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(sizes, type=pa.int64()), pa.array(of_ids), pa.array(of_bytes)],
                names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    chosen = docs.select(*keep, whole_text("text").alias("_text"))
    return chosen.mapInArrow(digested, f"{_schema(chosen, keep)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _schema(df: DataFrame, keep: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
