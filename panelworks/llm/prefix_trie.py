"""The prefix trie of rebuilt conversations, its subtree totals by time-forward processing.

A node is a distinct sequence of leading turns. Its key is a sum of hashes of (place, role, text), so prefixes
of one conversation are running sums and nodes are groups with map-side aggregation, however many
conversations share them. Subtree totals flow from leaves to the root:

* The trie is cut into shards. A node is *light* if its members have at most ``shard_rows`` turns from it
  on; the topmost light node of a path and all below it are one shard. The heavy nodes above form
  shards of ``band`` levels under one node each.
* A task sorts the nodes of its shards by reverse level order (Spark's external sort) and streams over them. Each node
  takes the totals sent to it from a priority queue in the same order, adds its own and sends the result to its
  parent. The queue holds at most two levels and writes sorted runs to an unnamed file of its task when it grows.
* Totals of shard roots go to their parents in other shards as rows, summed per parent before they are
  exchanged: light shards first, then the heavy ones. Where heavy shards hang below each other, their roots form a
  condensed trie that the same pass solves, and the heavy shards run once more with what it found.

The digest of the members that end at a node is read in order: chunks of ids are joined where they were sorted, and one
task per node hashes its chunks as a stream.

Defined results: rows without ``conv_id`` belong to no conversation and are left out; NULL roles and texts are empty;
turns are ordered NULL first, turns of one number by role and digest of the text; repeated rows are turns of their own;
an empty table has no node; very long texts enter as a digest and a length; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import broadcast_if_small, kept
from panelworks.llm.conversations import ROWS_PER_TASK, longest, numbered, running_sums

#: A conversation takes over first turns, fewer than HEADS, of the one at the next lower multiple of GROUP.
GROUP, HEADS = 100, 6
#: Levels of a shard of heavy nodes, messages of a queue that stay in memory, bytes of a chunk of ids.
BAND, QUEUED, CHUNK = 4096, 200_000, 65_536


def turns_of(conversations: DataFrame, limit: int = ROWS_PER_TASK) -> DataFrame:
    """(conv_id, pos, digest, chars) of every turn, ``pos`` from 1."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        role.alias("role"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.length(text).cast("long").alias("chars"),
    )
    return numbered(rows, "conv_id", ["turn", "role", "digest"], limit).select("conv_id", "pos", "digest", "chars")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, chars) of every rebuilt turn, ``depth`` from 1."""
    h = F.crc32(F.col("conv_id").cast("string")) % HEADS
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    heads = kept(turns.where((F.col("pos") < HEADS) & (F.col("conv_id") % GROUP == 0)).withColumnRenamed("conv_id", "base"))
    takers = turns.where("pos = 1").select("conv_id", h.alias("h"), base.alias("base"))
    # a head meets the conversations of its hundred
    taken = takers.join(heads, "base").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "digest", "chars")
    lengths = heads.groupBy("base").agg(F.max("pos").alias("head_turns"))
    own = turns.withColumns({"h": h, "base": base}).where("pos > h").join(broadcast_if_small(lengths), "base", "left")
    depth = F.col("pos") - F.col("h") + F.least("h", F.coalesce("head_turns", F.lit(0)))
    return taken.union(own.select("conv_id", depth.cast("int").alias("depth"), "digest", "chars"))


def _key(depth: Column, one: Column, two: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", depth.cast("string"), one.cast("string"), two.cast("string"))))


def paths(turns: DataFrame, limit: int = ROWS_PER_TASK) -> DataFrame:
    """(conv_id, depth, key, parent, chars, rest) of every node on every conversation's path, the root included;
    ``rest`` counts the nodes of the path from this one on."""
    rows = kept(rebuilt(turns))
    number = lambda *c: F.xxhash64(*c).cast("decimal(20,0)")
    own = {"one": number(F.lit(1), "depth", "digest"), "two": number("digest", F.lit(2), "depth")}
    summed = running_sums(rows, "conv_id", "depth", own, "turns", longest(rows, "conv_id") > limit)
    before = _key(F.col("depth") - 1, F.col("one") - own["one"], F.col("two") - own["two"])
    below = summed.select(
        "conv_id",
        "depth",
        _key(F.col("depth"), F.col("one"), F.col("two")).alias("key"),
        before.alias("parent"),
        "chars",
        (F.col("turns") - F.col("depth") + 1).alias("rest"),
    )
    lengths = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    everyone = turns.where("pos = 1").select("conv_id").join(lengths, "conv_id", "left")
    zero = F.lit(0).cast("decimal(30,0)")
    roots = everyone.select(
        "conv_id",
        F.lit(0).alias("depth"),
        _key(F.lit(0), zero, zero).alias("key"),
        F.lit(None).cast("binary").alias("parent"),
        F.lit(0).cast("long").alias("chars"),
        (F.coalesce("turns", F.lit(0)) + 1).alias("rest"),
    )
    return below.union(roots)


class SpillingQueue:
    """A priority queue of tuples; beyond ``most`` entries its content goes to a file as one sorted run."""

    BLOCK = 1024

    def __init__(self, most: int = QUEUED):
        self.most, self.heap, self.runs, self.file = most, [], [], None

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.most:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.heap.sort()
        places = []
        self.file.seek(0, 2)
        for at in range(0, len(self.heap), self.BLOCK):
            places.append(self.file.tell())
            pickle.dump(self.heap[at : at + self.BLOCK], self.file)
        self.heap = []
        run = self._read(places)
        heapq.heappush(self.runs, (next(run), len(places), id(run), run))

    def _read(self, places: list[int]) -> Iterator[tuple]:
        for place in places:
            self.file.seek(place)
            yield from pickle.load(self.file)

    def first(self) -> tuple | None:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            top, n, name, run = self.runs[0]
            following = next(run, None)
            if following is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (following, n, name, run))
            return top
        return heapq.heappop(self.heap)

    def __len__(self) -> int:
        return len(self.heap) + len(self.runs)


_TOTALS = "key binary, parent binary, inside boolean, n_children long, n_leaves long, saved_tokens long"
_FIELDS = ["shard", "depth", "key", "node", "parent", "inside", "n_children", "n_leaves", "saved_tokens"]


def _stream(queued: int):
    def forward(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, queue = None, SpillingQueue(queued)
        children = leaves = saved = 0
        for batch in batches:
            out = []
            for own, depth, key, node, parent, inside, n_children, n_leaves, n_saved in zip(
                *[batch.column(c).to_pylist() for c in _FIELDS]
            ):
                if own != shard:
                    if len(queue):
                        raise RuntimeError("a node was sent totals but is not in its shard")
                    shard, children, leaves, saved = own, 0, 0, 0
                children, leaves, saved = children + n_children, leaves + n_leaves, saved + n_saved
                if not node:  # a total from another shard; its node follows
                    continue
                while (top := queue.first()) is not None and top[0] == -depth and top[1] == key:
                    queue.pop()
                    children, leaves, saved = children + 1, leaves + top[2], saved + top[3]
                leaves = leaves if children else 1
                out.append((key, parent, inside, children, leaves, saved))
                if inside:
                    queue.push((1 - depth, parent, leaves, saved))
                children = leaves = saved = 0
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.binary(), pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
            names = [c.split()[0] for c in _TOTALS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=names)

    return forward


def time_forward(nodes: DataFrame, messages: DataFrame | None = None, queued: int = QUEUED) -> DataFrame:
    """Totals of every node over its own shard and the ``messages`` (key, n_children, n_leaves, saved_tokens).

    ``nodes``: (shard, depth, key, parent, inside, own), ``inside`` telling whether the parent is in the same shard.
    """
    zero = F.lit(0).cast("long")
    rows = nodes.select(
        "shard", "depth", "key", F.lit(True).alias("node"), "parent", "inside",
        zero.alias("n_children"), zero.alias("n_leaves"), F.col("own").alias("saved_tokens"),
    )
    if messages is not None:
        summed = messages.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
        sent = nodes.select("shard", "depth", "key").join(summed, "key")
        rows = rows.union(
            sent.select(
                "shard", "depth", "key", F.lit(False).alias("node"), F.lit(None).cast("binary").alias("parent"),
                F.lit(False).alias("inside"), "n_children", "n_leaves", "saved_tokens",
            )
        )
    n = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(n, "shard").sortWithinPartitions("shard", F.desc("depth"), "key", "node")
    return dealt.mapInArrow(_stream(queued), _TOTALS)


def _sent(totals: DataFrame) -> DataFrame:
    """What the roots of shards send to their parents."""
    roots = totals.where("NOT inside AND parent IS NOT NULL")
    return roots.select(F.col("parent").alias("key"), F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens")


def _heavy_totals(nodes: DataFrame, starts: DataFrame, messages: DataFrame, band: int, queued: int) -> DataFrame:
    """Totals of the heavy nodes (conv_id, depth, key, parent, own), given what the light shards send."""
    level = F.floor(F.col("depth") / band).cast("int")
    top = starts.select("conv_id", F.floor(F.col("depth") / band).cast("int").alias("level"), F.col("key").alias("shard"))
    placed = kept(
        nodes.withColumn("level", level)
        .join(top, ["conv_id", "level"])
        .withColumn("inside", (F.col("depth") % band != 0))
        .select("shard", "level", "depth", "key", "parent", "inside", "own")
    )
    first = time_forward(placed, messages, queued)
    if not placed.where("level > 0").limit(1).count():
        return first
    # heavy shards hang below each other: solve the trie of their roots, then run them with what hangs below
    roots = kept(first).where("NOT inside").select("key", "parent", "n_leaves", "saved_tokens")
    above = placed.select(F.col("key").alias("parent"), F.col("shard").alias("up"))
    levels = placed.where("NOT inside").select("key", "level")
    # a node without children in its own shard counted itself as a leaf, though shards hang below it
    hung = roots.where("parent IS NOT NULL").select(F.col("parent").alias("key")).distinct()
    bare = kept(first).where("n_children = 0").join(hung, "key", "left_semi").select(F.col("key").alias("parent"))
    bare = bare.join(above, "parent").groupBy("up").agg(F.count(F.lit(1)).alias("bare")).withColumnRenamed("up", "key")
    condensed = roots.join(levels, "key").join(above, "parent", "left").join(bare, "key", "left")
    solved = condensed.select(
        F.lit(b"top").alias("shard"),
        F.col("level").alias("depth"),
        "key",
        F.col("up").alias("parent"),
        F.col("up").isNotNull().alias("inside"),
        F.col("saved_tokens").alias("own"),
        (F.col("n_leaves") - F.coalesce("bare", F.lit(0))).alias("own_leaves"),
    )
    solved = kept(solved)
    loads = solved.select("key", F.lit(1).cast("long").alias("n_children"), F.col("own_leaves").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    found = time_forward(solved, loads, queued).select("key", "n_leaves", "saved_tokens")
    hanging = roots.where("parent IS NOT NULL").select("key", "parent").join(found, "key")
    hanging = hanging.select(F.col("parent").alias("key"), F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens")
    return time_forward(placed, messages.union(hanging), queued)


def ends_digests(ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(key, ends_sha256) over the ascending ids of each key's (key, conv_id) rows."""

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, size = None, 0, [], 0
        for batch in batches:
            out = []
            for own, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
                if own != key or size > chunk:
                    if ids:
                        out.append((key, first, ",".join(ids)))
                    key, first, ids, size = own, conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            yield chunks(out)
        yield chunks([(key, first, ",".join(ids))] if ids else [])

    def chunks(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [[]] * 3
        kinds = (pa.binary(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=["key", "first", "ids"])

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for own, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if own != key:
                    if state is not None:
                        out.append((key, state.hexdigest()))
                    key, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield digests(out)
        yield digests([(key, state.hexdigest())] if state is not None else [])

    def digests(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [[]] * 2
        return pa.RecordBatch.from_arrays([pa.array(columns[0], type=pa.binary()), pa.array(columns[1], type=pa.string())], names=["key", "ends_sha256"])

    n = max(1, int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = ends.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    parts = placed.mapInArrow(joined, "key binary, first long, ids string")
    return parts.repartition(n, "key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key binary, ends_sha256 string")


def prefix_trie(
    conversations: DataFrame,
    shard_rows: int | None = None,
    band: int = BAND,
    queued: int = QUEUED,
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``shard_rows`` bounds the turns under a light node; by default a fourth of a task's share of all turns.
    """
    rows = kept(paths(kept(turns_of(conversations, limit)), limit))
    if shard_rows is None:
        tasks = max(1, int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        shard_rows = max(64, min(ROWS_PER_TASK, rows.count() // (4 * tasks)))
    weights = rows.groupBy("key").agg(F.sum("rest").alias("weight"))
    heavy = kept(weights.where(F.col("weight") > shard_rows).select("key", F.lit(True).alias("heavy")))
    marked = rows.join(broadcast_if_small(heavy), "key", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    ends = marked.groupBy("conv_id").agg(
        F.max_by("key", "depth").alias("end"), F.min_by(F.when(~F.col("heavy"), F.col("key")), F.when(~F.col("heavy"), F.col("depth"))).alias("shard")
    )
    ends = kept(ends)
    nodes = marked.join(ends.select("conv_id", "shard"), "conv_id").groupBy("key").agg(
        F.min("conv_id").alias("conv_id"),
        F.max("depth").alias("depth"),
        F.max("parent").alias("parent"),
        F.count(F.lit(1)).alias("n_convs"),
        F.max("chars").alias("chars"),
        F.max("heavy").alias("heavy"),
        F.max("shard").alias("shard"),  # one and the same for all members of a light node
    )
    nodes = kept(nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("chars")))
    light = nodes.where("NOT heavy").select(
        "shard", "depth", "key", "parent", (F.col("key") != F.col("shard")).alias("inside"), "own"
    )
    below = kept(time_forward(light, None, queued))
    starts = rows.where(F.col("depth") % band == 0).select("conv_id", "depth", "key")
    above = _heavy_totals(nodes.where("heavy").select("conv_id", "depth", "key", "parent", "own"), starts, _sent(below), band, queued)
    totals = below.union(above).select("key", "n_children", "n_leaves", "saved_tokens")
    digests = ends_digests(ends.select(F.col("end").alias("key"), "conv_id"))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    found = nodes.join(totals, "key").join(digests, "key", "left").join(parents, "parent", "left")
    return found.select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )
