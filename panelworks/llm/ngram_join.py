"""Near-duplicate documents: N-gram Jaccard join with Bayesian pruning of candidates.

Documents are sets of word shingles (five lower-cased words; all words of a
shorter text). Equal word sequences are one class from the start. Classes that
share a band of MinHash values are candidates; the connected groups of
candidates are the families. A family is dealt out in blocks of about ``BLOCK``
classes, and each block meets each block of its family in a task of its own, so
that no group is gathered and no pair ever becomes a row. There the MinHash
values of all pairs are compared a few at a time; a pair is dropped as soon as the
posterior probability that its similarity reaches the threshold falls below
``TOLERANCE``. What is left is verified exactly on the shingle sets of the two
whole texts. A task returns, per class, its number of links and one link towards
the rest of its group, from which the connected classes follow.

Defined results: NULL and empty texts are one class of equal documents; rows
that repeat a document are members of its class; a NULL ``doc_id`` is kept and
never becomes a class id unless all ids of the class are NULL. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.llm.common import arrow_batch, batches, broadcast_if_small, column, free_names, kept, mixed, span_hashes, word_spans
from panelworks.llm.linking import components, shared_buckets

SHINGLE, THRESHOLD = 5, 0.8
#: At the threshold a pair misses all bands with probability (1 - 0.8**4)**24, about 3 in a million.
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
#: Pairs are dropped when reaching the threshold is less likely than this.
TOLERANCE = 1e-4
STEP = 16
#: Classes of one block; a task holds two blocks.
BLOCK = 512

_SEEDS = mixed(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).astype(np.uint32) | np.uint32(1)
_SHIFTS = mixed(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)).astype(np.uint32)


def normal_text(text: str) -> Column:
    """Lower-cased words joined by single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"\s+", " "))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a normalised text."""
    data = text.encode("utf-8", "surrogatepass")
    starts, ends = word_spans(data)
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    width = min(SHINGLE, len(starts))
    return np.unique(span_hashes(data, starts[: len(starts) - width + 1], ends[width - 1 :]))


def signature(found: np.ndarray) -> np.ndarray:
    """MinHash values of a shingle set."""
    lows = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 2048):
        part = short[at : at + 2048]
        values = part[None, :] * _SEEDS[:, None] + _SHIFTS[:, None]
        values ^= values >> np.uint32(15)
        values *= np.uint32(0x2C1B3C6D)
        values ^= values >> np.uint32(12)
        np.minimum(lows, values.min(axis=1), out=lows)
    return lows


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


@lru_cache(maxsize=8)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For each number of compared values, the fewest equal ones with which a pair stays.

    With a uniform prior the posterior of the similarity after m of n equal values
    is Beta(m + 1, n - m + 1), whose upper tail is a binomial sum.
    """

    def tail(m: int, n: int) -> float:
        return sum(comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))

    return tuple(next(m for m in range(n + 1) if tail(m, n) >= tolerance) for n in range(HASHES + 1))


def _bands(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows, text="words"):
        bands = []
        for text in batch.column("words").to_pylist():
            found = shingles(text)
            lows = signature(found)
            keys = np.zeros(BANDS, dtype=np.uint64)
            for row in range(ROWS):
                keys = mixed(keys * np.uint64(31) + lows[row::ROWS])
            bands.append(mixed(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64) if len(found) else [])
        columns = {c: batch.column(c) for c in ("doc_id", "key", "digest")}
        yield arrow_batch(
            columns | {"bands": bands}, [batch.column("doc_id").type, pa.int64(), pa.binary(), pa.list_(pa.int64())]
        )


def plausible(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Pairs of two blocks of signatures that leave the threshold within reach, compared step by step."""
    least = least_matches()
    matches = np.zeros((len(one), len(two)), dtype=np.int16)
    alive: tuple[np.ndarray, ...] | None = None
    for n in range(STEP, HASHES + 1, STEP):
        if alive is None:
            for k in range(n - STEP, n):
                matches += one[:, k, None] == two[None, :, k]
            alive = np.nonzero(matches >= least[n])
        else:
            matches[alive] += (one[alive[0], n - STEP : n] == two[alive[1], n - STEP : n]).sum(axis=1, dtype=np.int16)
            stay = matches[alive] >= least[n]
            alive = (alive[0][stay], alive[1][stay])
    found = np.zeros((len(one), len(two)), dtype=bool)
    found[alive] = True
    return found


def _block_links(key: tuple, rows: pa.Table) -> pa.Table:
    """Link counts and connecting links of the classes of two blocks of one family (or of one block with itself)."""
    _, first, second = (k.as_py() for k in key)
    sides = []
    for block in (first,) if first == second else (first, second):
        found: dict[int, tuple[str, int]] = {}
        part = rows.filter(pc.equal(rows["block"], block))
        for k, words, copies in zip(*(part[c].to_pylist() for c in ("key", "words", "copies")), strict=True):
            found[k] = (words, copies)  # rows that repeat an id and a text come once
        keys = sorted(found)
        sets = [shingles(found[k][0]) for k in keys]
        sides.append((keys, sets, np.array([found[k][1] for k in keys], dtype=np.int64)))
    (keys_a, sets_a, copies_a), (keys_b, sets_b, copies_b) = sides[0], sides[-1]
    counts: dict[int, int] = {}
    near: dict[int, int] = {}
    if keys_a and keys_b:
        signs_a, signs_b = (np.array([signature(s) for s in sets]) for sets in (sets_a, sets_b))
        linked = plausible(signs_a, signs_b)
        if first == second:
            linked &= ~np.tri(len(keys_a), dtype=bool)  # each pair once
        linked = _verified(linked, sets_a, sets_b)
        if first == second:
            linked |= linked.T
            counts = dict(zip(keys_a, (linked @ copies_a).tolist()))
        else:
            counts = dict(zip(keys_a, (linked @ copies_b).tolist())) | dict(zip(keys_b, (copies_a @ linked).tolist()))
        near = _connecting(linked, keys_a, keys_b)
    out = [k for k, n in counts.items() if n]
    return pa.table(
        {
            "key": pa.array(out, type=pa.int64()),
            "links": pa.array([counts[k] for k in out], type=pa.int64()),
            "near": pa.array([near[k] for k in out], type=pa.int64()),
        }
    )


def _verified(pairs: np.ndarray, sets_a: list[np.ndarray], sets_b: list[np.ndarray]) -> np.ndarray:
    """The pairs that truly reach the threshold: few are compared one by one, many by counting."""
    one, two = np.nonzero(pairs)
    if len(one) < 4 * (len(sets_a) + len(sets_b)):
        good = np.zeros_like(pairs)
        for i, j in zip(one.tolist(), two.tolist()):
            good[i, j] = similarity(sets_a[i], sets_b[j]) >= THRESHOLD
        return good
    shared = shared_counts(sets_a, sets_b)
    size_a, size_b = (np.array([len(s) for s in x], dtype=np.float64) for x in (sets_a, sets_b))
    return pairs & (shared >= THRESHOLD * (size_a[:, None] + size_b[None, :] - shared) - 1e-9)


def _connecting(linked: np.ndarray, keys_a: list[int], keys_b: list[int]) -> dict[int, int]:
    """For every key, the smallest key of its connected group in the two blocks."""
    lows_a, lows_b = np.array(keys_a), np.array(keys_b)
    far = np.iinfo(np.int64).max
    while True:
        new_b = np.minimum(lows_b, np.where(linked, lows_a[:, None], far).min(axis=0))
        new_a = np.minimum(lows_a, np.where(linked, new_b[None, :], far).min(axis=1))
        if keys_a == keys_b:  # one block: both sides are the same classes
            new_a = new_b = np.minimum(new_a, new_b)
        if (new_a == lows_a).all() and (new_b == lows_b).all():
            return dict(zip(keys_b, new_b.tolist())) | dict(zip(keys_a, new_a.tolist()))
        lows_a, lows_b = new_a, new_b


def shared_counts(sets_a: list[np.ndarray], sets_b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: frequent shingles by matrix products, rare ones by their lists."""
    every = np.concatenate([*sets_a, *sets_b])
    values, column = np.unique(every, return_inverse=True)
    cut = sum(map(len, sets_a))
    row_a = np.repeat(np.arange(len(sets_a)), [len(s) for s in sets_a])
    row_b = np.repeat(np.arange(len(sets_b)), [len(s) for s in sets_b])
    col_a, col_b = column[:cut], column[cut:]
    in_a, in_b = np.bincount(col_a, minlength=len(values)), np.bincount(col_b, minlength=len(values))
    shared = np.zeros((len(sets_a), len(sets_b)), dtype=np.float32)
    frequent = np.flatnonzero((in_a > 0) & (in_b > 0) & (in_a.astype(np.int64) * in_b > 256))
    slot = np.full(len(values), -1)
    slot[frequent] = np.arange(len(frequent))
    for at in range(0, len(frequent), 1024):
        dense = []
        for rows, cols, n in ((row_a, col_a, len(sets_a)), (row_b, col_b, len(sets_b))):
            part = (slot[cols] >= at) & (slot[cols] < at + 1024)
            matrix = np.zeros((n, min(1024, len(frequent) - at)), dtype=np.float32)
            matrix[rows[part], slot[cols[part]] - at] = 1
            dense.append(matrix)
        shared += dense[0] @ dense[1].T
    rare = (in_a > 0) & (in_b > 0) & (slot < 0)
    pick_a, pick_b = np.flatnonzero(rare[col_a]), np.flatnonzero(rare[col_b])
    pick_a, pick_b = pick_a[np.argsort(col_a[pick_a], kind="stable")], pick_b[np.argsort(col_b[pick_b], kind="stable")]
    if len(pick_a):
        # for every rare occurrence on one side, the run of its shingle on the other
        start = np.searchsorted(col_b[pick_b], col_a[pick_a], "left")
        count = np.searchsorted(col_b[pick_b], col_a[pick_a], "right") - start
        left = np.repeat(row_a[pick_a], count)
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        right = row_b[pick_b][np.repeat(start, count) + offset]
        np.add.at(shared, (left, right), 1)
    return shared.astype(np.float64)


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with their digest, classes with component, links and copies)."""
    words = docs.select("doc_id", normal_text("text").alias("words"))
    words = words.withColumns({"digest": F.unhex(F.md5("words")), "key": F.xxhash64("words")})
    id_type = docs.schema["doc_id"].dataType.simpleString()
    marked = kept(words.mapInArrow(_bands, f"doc_id {id_type}, key long, digest binary, bands array<long>"))
    # equal texts are told by the digest; the shorter key names classes while they are linked
    copies = marked.groupBy("digest", "key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("lowest"))
    copies = kept(copies)
    members = shared_buckets(marked.select(F.explode("bands").alias("bucket"), "key").distinct())
    low = F.min("key").over(Window.partitionBy("bucket"))
    families = components(members.select(F.col("key").alias("a"), low.alias("b")))
    sizes = families.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = families.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    placed = kept(placed.join(copies, "key").select("component", "block", "blocks", "copies", "lowest", F.col("digest").alias("of")))
    # one text of each class: that of its smallest id
    mine = (words["digest"] == placed["of"]) & words["doc_id"].eqNullSafe(placed["lowest"])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = words.join(broadcast_if_small(placed), mine).select("component", "key", "copies", "words", "block", other)
    met = met.withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")})
    found = kept(
        met.groupBy("component", "first", "second").applyInArrow(_block_links, "key long, links long, near long")
    )
    linked = components(found.select(F.col("key").alias("a"), F.col("near").alias("b")))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    groups = copies.join(linked, "key", "left").join(links, "key", "left")
    filled = {
        "component": F.coalesce(F.concat(F.lit("k"), F.col("component").cast("string")), F.hex("digest")),
        "links": F.coalesce("links", F.lit(0).cast("long")),
    }
    return marked.select("doc_id", "digest"), kept(groups.withColumns(filled))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links, class_size) of every row.

    ``class_id`` is the smallest ``doc_id`` of the connected documents, ``n_links`` the number of
    other rows whose similarity reaches the threshold (copies included).
    """
    marked, groups = _grouped(docs)
    whole = groups.groupBy("component").agg(F.min("lowest").alias("class_id"), F.sum("copies").alias("class_size"))
    of_key = groups.join(whole, "component").select(
        "digest", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "class_size"
    )
    return marked.join(of_key, "digest").select("doc_id", "class_id", "n_links", "class_size")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class stays, with all its columns: the one with the smallest id, NULL last."""
    marked, groups = _grouped(docs)
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("\0"))
    rows = marked.groupBy("digest", "doc_id").count().join(groups.select("digest", "component"), "digest")
    first = rows.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    )
    is_first = (F.col("digest") == F.col("first.digest")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    placed = rows.join(first, "component").select(
        F.col("digest").alias("_key"), named.alias("_id"), is_first.alias("first"), "count"
    )
    several = kept(placed.where("NOT first OR count > 1"))
    own = [column(c) for c in docs.columns]
    names = free_names(docs.columns, "_key", "_id")
    several = several.select(*[F.col(c).alias(n) for c, n in zip(("_key", "_id"), names, strict=True)], "first")
    at = docs.select(*own, F.unhex(F.md5(normal_text("text"))).alias(names[0]), named.alias(names[1]))
    alone = at.join(broadcast_if_small(several.select(*names)), names, "left_anti")
    repeated = at.join(broadcast_if_small(several.where("first").select(*names)), names, "left_semi")
    return alone.select(*own).union(repeated.dropDuplicates(names).select(*own))
