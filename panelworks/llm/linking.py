"""Links between members of shared buckets without the pairs of a group.

A bucket is a set of keys of which any two may be linked (a band of MinHash
values, a line segment). In each round the members of a bucket meet one leader;
linked members become one component. While buckets hold members of different
components, further rounds take other leaders; once few enough pairs of
different components are left, or after ``MAX_ROUNDS`` rounds, all of them are
tested, block against block. So every pair that shares a bucket is tested or already connected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelworks.llm.common import kept, stored

MAX_ROUNDS = 2


def shared_buckets(buckets: DataFrame) -> DataFrame:
    """(bucket, key) rows of the buckets with at least two rows."""
    same = Window.partitionBy("bucket")
    return buckets.withColumn("_n", F.count(F.lit(1)).over(same)).where("_n > 1").drop("_n")


def components(links: DataFrame) -> DataFrame:
    """(key, component): smallest reachable key, by alternating large and small stars."""
    edges = kept(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = kept(small.where("u <> v").distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    found = edges.select(F.col("u").alias("key"), F.col("v").alias("component"))
    return kept(found.union(found.select("component", "component")).distinct())


def _placed(members: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        return members.withColumn("component", F.col("key"))
    placed = members.join(found, "key", "left")
    return placed.withColumn("component", F.coalesce("component", "key"))


def _leader_pairs(placed: DataFrame, turn: int) -> DataFrame:
    """Each member of a bucket with its leader of this turn, where their components differ."""
    draw = F.struct(F.xxhash64("key", F.lit(turn)).alias("draw"), "key", "component")
    leaders = placed.groupBy("bucket").agg(
        F.min(draw).alias("leader"), (F.min("component") != F.max("component")).alias("open")
    )
    met = placed.join(leaders.where("open"), "bucket").where("component <> leader.component")
    return met.select(F.greatest("key", "leader.key").alias("a"), F.least("key", "leader.key").alias("b")).distinct()


def _open_pairs(placed: DataFrame) -> int:
    """How many pairs of different components share a bucket (pairs in several buckets count again)."""
    sizes = placed.groupBy("bucket", "component").count()
    per_bucket = sizes.groupBy("bucket").agg(F.sum("count").alias("n"), F.sum(F.col("count") ** 2).alias("inside"))
    return int(per_bucket.agg(F.sum((F.col("n") ** 2 - F.col("inside")) / 2)).first()[0] or 0)


def connected(
    members: DataFrame, link: Callable[[DataFrame], DataFrame], link_all: Callable[[DataFrame], DataFrame]
) -> DataFrame | None:
    """(key, component) of linked keys, or None where no bucket is shared.

    ``members`` holds (bucket, key), materialised; ``link`` keeps the pairs (a, b) that are linked; ``link_all`` gives the
    linked pairs among all of different components in a bucket of (bucket, key, component).
    """
    found, links, turn = None, None, 0
    bound = 4 * members.count()
    while True:
        placed = _placed(members, found)
        rest = _open_pairs(placed)
        if not rest:
            return found
        last = turn > 0 and (rest <= bound or turn >= MAX_ROUNDS)
        new = kept(link_all(stored(placed)) if last else link(_leader_pairs(placed, turn)))
        links = new if links is None else links.union(new)
        found = components(links)
        if last:
            return found
        turn += 1
