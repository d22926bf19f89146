"""Benchmark decontamination by latent semantic retrieval.

Texts become sequences of benchmark terms (other words can never match an item)
and are cut into passages of ``PASSAGE`` words at a stride of half a passage.
Document frequencies of the terms cover all passages. A randomised SVD of the
TF-IDF passages gives the latent space: partial sums of A'(A X) are computed per
partition and added by a shuffle, twice, followed by a Rayleigh-Ritz rotation on
the driver (terms x rank numbers). The space is fitted on all passages of the items and
of the documents, balanced against each other. Neighbouring passages share a half, so
products are made per half. Every passage of every document is then searched: passages whose cosine
with a passage of an item reaches ``COSINE`` are candidates. The longest common
subsequence of an item and the text around the passage decides: ``COPY`` of the
item's words is a copy, ``PARAPHRASE`` of them is a paraphrase if the item's
answer (its last sentence, or what follows "answer") is there too.

The benchmark is a stated query set; it is searched in blocks of ``ITEMS`` items,
so that what a task holds is bounded whatever its size.

Defined results: NULL and empty texts and items match nothing; items without a
word are left out; repeated rows give one row per (doc_id, item_id), the best
one; a NULL ``doc_id`` is one document.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import batches, column, free_names, kept, whole_text

PASSAGE, STRIDE = 32, 16
RANK, OVERSAMPLE = 96, 16
#: passages whose counts and products a task makes at once; all are fitted
FIT_PASSAGES = 2_048
#: words of a term in a chunk from which it is multiplied densely
DENSE = 48
ITEMS = 5_000
COSINE = 0.6
COPY, PARAPHRASE, ANSWER = 0.6, 0.45, 0.8
SEED = 20_240_229
WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def answer_of(text: str) -> list[str]:
    """The words of the answer: what follows the last "answer", else the last sentence of three words."""
    marked = re.split(r"\banswer\s*(?:is|:)?", text, flags=re.IGNORECASE)
    if len(marked) > 1 and words_of(marked[-1]):
        return words_of(marked[-1])
    sentences = [w for part in re.split(r"[.!?]\s+|\n", text) if len(w := words_of(part)) >= 3]
    return sentences[-1] if sentences else words_of(text)


class Benchmark:
    """A block of items as term sequences, with their passages."""

    def __init__(self, items: list[tuple[object, str]]) -> None:
        self.terms: dict[str, int] = {}
        number = lambda words: np.array([self.terms.setdefault(w, len(self.terms)) for w in words], dtype=np.int32)
        kept_items = [(i, text) for i, text in items if text and words_of(text)]
        self.ids = [i for i, _ in kept_items]
        self.sequences = [number(words_of(text)) for _, text in kept_items]
        self.answers = [number(answer_of(text)) for _, text in kept_items]
        cut = [(k, s[at : at + PASSAGE]) for k, s in enumerate(self.sequences) for at in _starts(len(s), STRIDE // 2)]
        self.passage_item = np.array([k for k, _ in cut], dtype=np.int64)
        self.passages = [p for _, p in cut]


def _starts(n: int, stride: int) -> range:
    """Passage starts: the last passage may be short, but is no tail of the one before."""
    return range(0, max(1, n - PASSAGE + stride), stride)


def term_sequences(docs: DataFrame, terms: dict[str, int]) -> DataFrame:
    """(doc_id, ids): the benchmark term of each word, -1 for other words, as packed 32-bit numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def numbered(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches(rows):
            packed = [
                np.array([number(w, -1) for w in words_of(t)], dtype=np.int32).tobytes()
                for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(packed, type=pa.binary())], names=["doc_id", "ids"]
            )

    chosen = docs.select("doc_id", whole_text())
    return chosen.mapInArrow(numbered, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, ids binary")


class Halves(NamedTuple):
    """Known terms of a chunk of sequences by half passage: the passage that starts at half h has the terms of h and h + 1."""

    half: np.ndarray  # of each word, ascending
    term: np.ndarray
    starts: np.ndarray  # whether a passage starts at the half; one more half than there are

    def pairs(self, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(half, term, count) of the distinct terms of each half, and the count of the same term in the next half."""
        keys, counts = np.unique(self.half * n_terms + self.term, return_counts=True)
        at = np.minimum(np.searchsorted(keys, keys + n_terms), max(len(keys) - 1, 0))
        following = np.where(keys[at] == keys + n_terms, counts[at], 0)
        return keys // n_terms, keys % n_terms, counts, following


def _halves(packed: Iterable[bytes]) -> Iterator[Halves]:
    """All passages of packed sequences, ``FIT_PASSAGES`` or a text's rest at a time; a long text goes in slices."""
    words, bases, starts, held = [], [], [], 0

    def chunk() -> Halves:
        ids = np.concatenate(words)
        half = np.concatenate([base + np.arange(len(w)) // STRIDE for base, w in zip(bases, words)])
        return Halves(half[ids >= 0], ids[ids >= 0].astype(np.int64), np.concatenate([*starts, [False]]))

    for one in packed:
        ids = np.frombuffer(one, dtype=np.int32)
        passages = len(_starts(len(ids), STRIDE)) if len(ids) else 0
        for first in range(0, passages, FIT_PASSAGES):
            here = min(FIT_PASSAGES, passages - first)
            words.append(ids[first * STRIDE : (first + here + 1) * STRIDE])
            bases.append(held)
            starts.append(np.arange(here + 1) < here)
            held += here + 1
            if held >= FIT_PASSAGES:
                yield chunk()
                words, bases, starts, held = [], [], [], 0
    if words:
        yield chunk()


def document_frequencies(sequences: DataFrame, n_terms: int) -> tuple[np.ndarray, int]:
    """Over all passages: how many hold each term, and how many there are."""

    def counted(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_terms + 1, dtype=np.int64)  # the last one counts passages
        for batch in rows:
            for chunk in _halves(batch.column("ids").to_pylist()):
                counts[-1] += chunk.starts.sum()
                half, term, _, following = chunk.pairs(n_terms)
                # a term of two halves in a row is in the passage of both once
                holds = chunk.starts[half - 1].astype(np.int64) + (chunk.starts[half] & (following == 0))
                counts[:-1] += np.bincount(term, holds, minlength=n_terms).astype(np.int64)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["term", "n"])

    found = sequences.mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(n_terms + 1, dtype=np.int64)
    for row in found:
        counts[row.term] = row.n
    return counts[:-1], int(counts[-1])


def _group_sums(rows: np.ndarray, at: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of ``rows[at]`` over stretches of ``at``: one layer of all stretches at a time, the longest first."""
    longest = np.argsort(-counts, kind="stable")
    held, first = np.zeros((len(counts), rows.shape[1]), dtype=rows.dtype), starts[longest]
    for k, n in enumerate(len(counts) - np.cumsum(np.bincount(counts))[:-1] if len(counts) else ()):
        held[:n] += rows[at[first[:n] + k]]
    sums = np.empty_like(held)
    sums[longest] = held
    return sums


def _add_gram_times(total: np.ndarray, chunk: Halves, idf: np.ndarray, weighted: np.ndarray) -> None:
    """Add A'(A X), less the last factor of idf, of the unit TF-IDF passages of a chunk; ``weighted`` is idf times X."""
    if not len(chunk.term):
        return
    half, term, n, following = chunk.pairs(len(idf))
    size, square = len(chunk.starts), idf[term] ** 2
    own, met = np.bincount(half, n * n * square, size), np.bincount(half, n * following * square, size)
    norm = own + np.append(own[1:], 0.0) + 2 * met
    scale = np.where(chunk.starts, 1 / np.maximum(norm, 1e-12), 0.0).astype(np.float32)[:, None]
    y = np.zeros((size + 1, weighted.shape[1]), dtype=np.float32)
    words = np.bincount(chunk.half, minlength=size)
    y[:-1] = _group_sums(weighted, chunk.term, np.cumsum(words) - words, words)
    passages = (y[:-1] + y[1:]) * scale
    passages[1:] += passages[:-1].copy()  # what the passages of a half give it
    # terms of many words of the chunk in a dense product, the others word by word
    words = np.bincount(chunk.term, minlength=len(idf))
    often, seldom = np.flatnonzero(words > DENSE), np.flatnonzero((words > 0) & (words <= DENSE))
    number = np.full(len(idf), -1)
    number[often] = np.arange(len(often))
    mine = number[chunk.term]
    cells = np.bincount(mine[mine >= 0] * size + chunk.half[mine >= 0], minlength=len(often) * size)
    total[often] += cells.reshape(len(often), size).astype(np.float32) @ passages
    half, term = chunk.half[mine < 0], chunk.term[mine < 0]
    order = np.argsort(term.astype(np.uint16) if len(idf) <= 1 << 16 else term, kind="stable")
    total[seldom] += _group_sums(passages, half[order], np.cumsum(words[seldom]) - words[seldom], words[seldom])


def _gram_times(rows: np.ndarray, terms: np.ndarray, n_rows: int, idf: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A'(A X) of one batch of unit TF-IDF rows."""
    keys, counts = np.unique(rows * len(idf) + terms, return_counts=True)
    row, term = keys // len(idf), keys % len(idf)
    value = counts * idf[term]
    value = value / np.sqrt(np.maximum(np.bincount(row, value * value, n_rows), 1e-12))[row]
    weighted = value[:, None].astype(np.float32) * x.astype(np.float32)[term]
    first = np.flatnonzero(np.diff(row, prepend=-1))  # the keys are in row order
    y = np.zeros((n_rows, x.shape[1]), dtype=np.float32)
    y[row[first]] = np.add.reduceat(weighted, first)
    order = np.argsort(term, kind="stable")
    back = value[order, None].astype(np.float32) * y[row[order]]
    first = np.flatnonzero(np.diff(term[order], prepend=-1))
    out = np.zeros_like(x)
    out[term[order][first]] = np.add.reduceat(back, first)
    return out


def latent_space(sequences: DataFrame, items: Benchmark, idf: np.ndarray, n_passages: int) -> tuple[np.ndarray, np.ndarray]:
    """(terms x rank basis of right singular vectors, singular values) of the passages by a randomised SVD."""
    context = sequences.sparkSession.sparkContext
    width = min(RANK + OVERSAMPLE, len(idf))
    x = np.linalg.qr(np.random.default_rng(SEED).standard_normal((len(idf), width)))[0]
    parts = [_passage_terms(p) for p in items.passages]
    own_row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    own_term = np.concatenate(parts)
    balance = max(1, n_passages) / len(parts)  # items and documents weigh the same
    for turn in range(2):
        shared = context.broadcast((idf, x))

        def partial(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, basis = shared.value
            total, weighted = np.zeros_like(basis), (weights[:, None] * basis).astype(np.float32)
            for batch in rows:
                for chunk in _halves(batch.column("ids").to_pylist()):
                    _add_gram_times(total, chunk, weights, weighted)
            total *= weights[:, None]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total))), pa.array(list(total), type=pa.list_(pa.float64()))], names=["term", "sums"]
            )

        sums = [F.sum(F.col("sums")[k]).alias(f"c{k}") for k in range(width)]
        rows = sequences.mapInArrow(partial, "term long, sums array<double>").groupBy("term").agg(*sums).collect()
        gram = np.zeros_like(x)
        for r in rows:
            gram[r.term] = r[1:]
        gram += balance * _gram_times(own_row, own_term, len(parts), idf, x)
        if turn == 0:
            x = np.linalg.qr(gram)[0]
    values, rotation = np.linalg.eigh(x.T @ gram)
    order = np.argsort(values)[::-1][: min(RANK, width)]
    return x @ rotation[:, order], np.sqrt(np.maximum(values[order], 0))


def _passage_terms(passage: np.ndarray) -> np.ndarray:
    return passage[passage >= 0].astype(np.int64)


def common_subsequence(pattern: dict[int, int], size: int, ids: Iterable[int]) -> int:
    """Length of the longest common subsequence, one machine operation per word of the text.

    ``pattern`` has, for each term, a bit for each place in the item.
    """
    full = (1 << size) - 1
    row = full
    get = pattern.get
    for term in ids:
        match = get(term)
        if match:
            met = row & match
            row = ((row + met) | (row - met)) & full
    return size - row.bit_count()


def _bits(sequence: np.ndarray) -> dict[int, int]:
    found: dict[int, int] = {}
    for at, term in enumerate(sequence.tolist()):
        found[term] = found.get(term, 0) | (1 << at)
    return found


def find_matches(sequences: DataFrame, items: Benchmark, idf: np.ndarray, basis: np.ndarray) -> DataFrame:
    """(doc_id, item, cosine, lcs, answer) of every candidate that the checks confirm."""
    weighted = np.vstack([idf[:, None] * basis, np.zeros(basis.shape[1])]).astype(np.float32)  # the last row: no term
    latent = np.array([weighted[p].sum(axis=0) for p in items.passages])
    latent /= np.maximum(np.linalg.norm(latent, axis=1), 1e-6)[:, None]
    facts = sequences.sparkSession.sparkContext.broadcast(
        (weighted, latent, items.passage_item, items.sequences, items.answers)
    )

    def searched(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted, latent, passage_item, item_ids, answers = facts.value
        patterns = [(_bits(s), len(s)) for s in item_ids]
        answer_patterns = [(_bits(s), len(s)) for s in answers]
        for batch in rows:
            out: list[tuple[int, int, float, int, bool]] = []
            for doc, packed in enumerate(batch.column("ids").to_pylist()):
                ids = np.frombuffer(packed, dtype=np.int32)
                if not len(ids):
                    continue
                for item, cosine, start, end in _candidates(ids, weighted, latent, passage_item):
                    bits, size = patterns[item]
                    region = ids[max(0, start - size) : end + size].tolist()
                    lcs = common_subsequence(bits, size, region)
                    if lcs < PARAPHRASE * size:
                        continue
                    answer_bits, answer_size = answer_patterns[item]
                    answered = common_subsequence(answer_bits, answer_size, region) >= ANSWER * answer_size
                    if lcs >= COPY * size or answered:
                        out.append((doc, item, cosine, lcs, answered))
            at = pa.array([o[0] for o in out], type=pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(at),
                    *[
                        pa.array([o[k] for o in out], type=t)
                        for k, t in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.bool_()), start=1)
                    ],
                ],
                names=["doc_id", "item", "cosine", "lcs", "answer"],
            )

    id_type = sequences.schema["doc_id"].dataType.simpleString()
    return sequences.mapInArrow(searched, f"doc_id {id_type}, item long, cosine double, lcs long, answer boolean")


def _candidates(
    ids: np.ndarray, weighted: np.ndarray, latent: np.ndarray, passage_item: np.ndarray
) -> list[tuple[int, float, int, int]]:
    """(item, cosine, start, end): for each item, each run of neighbouring passages above the cosine."""
    found: dict[int, list[list]] = {}
    for at in range(0, len(ids), 1 << 15):  # long texts go in slices; passages may reach into the next one
        part = ids[at : at + (1 << 15) + STRIDE]
        vectors = weighted[part]
        halves = np.add.reduceat(vectors, np.arange(0, len(part), STRIDE))
        rows = halves.copy()
        rows[:-1] += halves[1:]
        norms = np.linalg.norm(rows, axis=1)
        near = (rows @ latent.T) >= COSINE * np.maximum(norms, 1e-6)[:, None]
        for row, passage in zip(*np.nonzero(near)):
            cosine = float(rows[row] @ latent[passage] / max(norms[row], 1e-6))
            start = at + int(row) * STRIDE
            runs = found.setdefault(int(passage_item[passage]), [])
            if runs and start <= runs[-1][2] + STRIDE:
                runs[-1][0] = max(runs[-1][0], cosine)
                runs[-1][2] = max(runs[-1][2], start + PASSAGE)
            else:
                runs.append([cosine, start, start + PASSAGE])
    return [(item, c, s, e) for item, runs in found.items() for c, s, e in runs]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, n_words, coverage, answer) of every document that holds an item."""
    spark = docs.sparkSession
    texts = benchmark.select("item_id", whole_text()).where("item_id IS NOT NULL")
    texts = kept(texts.groupBy("item_id", "text").count().select("item_id", "text"))
    id_type = texts.schema["item_id"].dataType.simpleString()
    blocks = max(1, -(-texts.count() // ITEMS))
    parts = []
    for block in range(blocks):
        rows = texts.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        items = Benchmark([(r.item_id, r.text) for r in rows])
        if not items.ids:
            continue
        sequences = kept(term_sequences(docs, items.terms))
        counts, n = document_frequencies(sequences, len(items.terms))
        # a term of more than half of the passages tells nothing apart
        idf = np.where(counts > n / 2, 0.0, np.log((n + 1) / (counts + 1)))
        basis, _ = latent_space(sequences, items, idf, n)
        names = spark.createDataFrame(
            [(k, i, len(s)) for k, (i, s) in enumerate(zip(items.ids, items.sequences, strict=True))],
            f"item long, item_id {id_type}, n_words long",
        )
        parts.append(find_matches(sequences, items, idf, basis).join(F.broadcast(names), "item"))  # at most ITEMS rows
    if not parts:
        doc_type = docs.schema["doc_id"].dataType.simpleString()
        schema = f"doc_id {doc_type}, item_id {id_type}, cosine double, lcs long, n_words long, coverage double, answer boolean"
        return spark.createDataFrame([], schema)
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    best = F.max(F.struct("lcs", "cosine", "n_words", "answer")).alias("best")
    return (
        every.groupBy("doc_id", "item_id")
        .agg(best)
        .select(
            "doc_id",
            "item_id",
            F.round("best.cosine", 3).alias("cosine"),
            "best.lcs",
            "best.n_words",
            F.round(F.col("best.lcs") / F.col("best.n_words"), 6).alias("coverage"),
            "best.answer",
        )
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    # ids may be NULL or repeated: a document is told by its id and the digest of its text
    digest = F.unhex(F.md5(whole_text()))
    of_id, of_text = free_names(docs.columns, "_bad", "_of")
    told = docs.select(F.struct("doc_id", digest.alias("digest")).alias("doc_id"), "text")
    bad = kept(contaminated(told, benchmark).select(F.col("doc_id.doc_id").alias(of_id), F.col("doc_id.digest").alias(of_text)).distinct())
    joined = docs.join(bad, F.col("doc_id").eqNullSafe(F.col(of_id)) & (digest == F.col(of_text)), "left_anti")
    return joined.select([column(c) for c in docs.columns])
