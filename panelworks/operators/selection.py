"""Deduplication, finalists, alpha scores and factor sets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelworks.operators.ranking import ordinal_rank
from panelworks.session import stored

# Fixed values.
DUPLICATE_CORRELATION = 0.995
MIN_CELLS = 10
MAX_FINALISTS = 3
POLICY = "promotion_gate_v2"


def _pair_sums(names: Sequence[str], centre: Sequence[float]):
    """Sums over the cells two candidates share, for every pair, per batch; values are taken from their ``centre``."""
    upper = np.triu_indices(len(names), 1)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = None
        for batch in batches:
            x = batch.to_numpy(dtype=float) - np.asarray(centre)
            seen = np.isfinite(x)
            x = np.where(seen, x, 0.0)
            v = seen.astype(float)
            parts = np.stack([v.T @ v, x.T @ v, v.T @ x, (x * x).T @ v, v.T @ (x * x), x.T @ x])
            totals = parts if totals is None else totals + parts
        if totals is not None:
            cells = totals[:, upper[0], upper[1]]
            frame = pd.DataFrame(cells.T, columns=["n", "sx", "sy", "sxx", "syy", "sxy"])
            frame.insert(0, "right", np.asarray(names, dtype=object)[upper[1]])
            frame.insert(0, "left", np.asarray(names, dtype=object)[upper[0]])
            yield frame

    return sums


def candidate_correlations(values: DataFrame, names: Sequence[str]) -> DataFrame:
    """Correlation of every candidate pair over their shared cells.

    ``values`` is long (``factor_id, symbol, d, value``). Each cell becomes one
    row with a column per candidate, and a task reduces its rows to six small
    matrices, so the cells are never repeated per pair. The number of candidates
    is limited by the search budget.
    """
    return cell_correlations(candidate_cells(values, names), names)


def candidate_cells(values: DataFrame, names: Sequence[str]) -> DataFrame:
    """One stored row per ``symbol, d`` with a column per candidate, numbered in the order of the names."""
    ordered = sorted(names)
    number = F.array_position(F.array(*[F.lit(n) for n in ordered]), F.col("factor_id")).cast("int")
    places = list(range(1, len(ordered) + 1))
    wide = values.withColumn("_i", number).groupBy("symbol", "d").pivot("_i", places).agg(F.first("value"))
    return stored(wide.select(*[F.col(str(i)) for i in places]))


def cell_counts(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    """(factor_id, cells) of the candidates that have any."""
    counts = cells.agg(*[F.count(c).alias(c) for c in cells.columns])  # one row
    pairs = F.array(*[F.struct(F.lit(n).alias("factor_id"), F.col(c).alias("cells")) for n, c in zip(sorted(names), cells.columns)])
    return counts.select(F.explode(pairs).alias("c")).select("c.*").where(F.col("cells") > 0)


def cell_correlations(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    """``candidate_correlations`` from the rows of ``candidate_cells``."""
    means = cells.agg(*[F.avg(c).alias(c) for c in cells.columns]).first()  # one number per candidate
    centre = [0.0 if m is None else m for m in means]
    schema = "left string, right string, n double, sx double, sy double, sxx double, syy double, sxy double"
    sums = cells.mapInPandas(_pair_sums(sorted(names), centre), schema)
    total = sums.groupBy("left", "right").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    vx, vy = F.col("sxx") - F.col("sx") ** 2 / n, F.col("syy") - F.col("sy") ** 2 / n
    usable = (n >= MIN_CELLS) & (vx > 0) & (vy > 0)
    return total.where(n > 0).select(
        "left", "right", n.cast("long").alias("cells"), F.when(usable, cov / F.sqrt(vx * vy)).alias("correlation")
    )


def correlation_dedupe(
    candidates: DataFrame, correlations: DataFrame, threshold: float = DUPLICATE_CORRELATION
) -> DataFrame:
    """Greedy pass by fitness: a candidate near-identical to a retained one is rejected.

    ``candidates`` holds ``factor_id, seq, fitness``. The fold runs over one array
    with an entry per candidate (bounded by the search budget).
    """
    order = F.row_number().over(Window.orderBy(F.col("fitness").desc_nulls_last(), "seq"))
    placed = candidates.select("factor_id", order.alias("place"))
    close = correlations.where(F.abs("correlation") >= threshold)
    both = close.select("left", "right").union(close.select("right", "left")).toDF("factor_id", "other")
    others = placed.select(F.col("factor_id").alias("other"), F.col("place").alias("other_place"))
    linked = (
        placed.join(both, "factor_id", "left")
        .join(others, "other", "left")
        .groupBy("factor_id", "place")
        .agg(F.sort_array(F.collect_list(F.when(F.col("other_place") < F.col("place"), F.col("other_place")))).alias("near"))
    )
    lines = linked.agg(F.sort_array(F.collect_list(F.struct("place", "factor_id", "near"))).alias("lines"))
    state = F.struct(
        F.array().cast("array<int>").alias("kept"), F.array().cast("array<struct<place:int,twin:int>>").alias("out")
    )

    def step(acc, line):
        twin = F.array_min(F.array_intersect(line["near"], acc["kept"]))
        kept = F.when(twin.isNull(), F.array_append(acc["kept"], line["place"])).otherwise(acc["kept"])
        entry = F.struct(line["place"].alias("place"), twin.alias("twin"))
        return F.struct(kept.alias("kept"), F.array_append(acc["out"], entry).alias("out"))

    folded = lines.select(F.explode(F.aggregate("lines", state, step, lambda acc: acc["out"])).alias("o"))
    twins = placed.select(F.col("place").alias("twin"), F.col("factor_id").alias("representative"))
    return (
        folded.select("o.place", "o.twin")
        .join(placed, "place")
        .join(twins, "twin", "left")
        .select("factor_id", "place", F.col("twin").isNull().alias("retained"), "representative")
    )


def select_finalists(candidates: DataFrame, count: int = 1) -> DataFrame:
    """Best candidates by gate, fitness, window pass ratio and hash; at most three."""
    count = min(count if count >= 1 else 1, MAX_FINALISTS)
    order = [
        F.coalesce("gate_passed", F.lit(False)).desc(),
        F.col("fitness").desc_nulls_last(),
        F.coalesce("window_pass_ratio", F.lit(0.0)).desc(),
        F.col("candidate_hash").desc(),
    ]
    best = candidates.orderBy(*order).limit(count)  # at most three rows
    return best.withColumn("selection_rank", F.row_number().over(Window.orderBy(*order)))


def alpha_scores(values: DataFrame, last_day: int, n_symbols: int) -> DataFrame:
    """Equal-weight mean of the last day's ordinal ranks, with the evidence behind it.

    ``coverage`` is the share of computable factors that value the symbol and
    ``confidence`` lowers it for a small universe.
    """
    latest = values.where((F.col("d") == last_day) & F.col("value").isNotNull())
    sizes = latest.groupBy("factor_id").agg(F.count(F.lit(1)).alias("_n"))  # one row per factor
    ranked = ordinal_rank(latest, ["factor_id"], ["value", "symbol"], "_k", n_symbols).join(
        F.broadcast(sizes), "factor_id"
    )
    ranked = ranked.withColumn("share", F.col("_k") / F.col("_n"))
    factors = sizes.agg(F.count(F.lit(1)).alias("_factors"))
    scored = (
        ranked.crossJoin(F.broadcast(factors))  # one row
        .groupBy("symbol", "_factors")
        .agg(
            F.avg("share").alias("score"),
            F.count(F.lit(1)).alias("_valued"),
            F.sort_array(
                F.collect_list(F.struct("factor_id", (F.col("share") / F.col("_factors")).alias("contribution")))
            ).alias("contributions"),
        )
    )
    placed = ordinal_rank(
        scored.withColumns({"_down": -F.col("score"), "_all": F.lit(0)}), ["_all"], ["_down", "symbol"], "rank", n_symbols
    )
    universe = scored.agg(F.count(F.lit(1)).alias("_symbols"))  # one row
    coverage = F.col("_valued") / F.col("_factors")
    return placed.crossJoin(F.broadcast(universe)).select(
        "symbol",
        "score",
        F.col("rank").cast("long").alias("rank"),
        coverage.alias("coverage"),
        (coverage * (1 - 1 / F.greatest("_symbols", F.lit(1)))).alias("confidence"),
        "contributions",
    )


def active_factors(factors: DataFrame, limit: int = 20) -> DataFrame:
    """Active factors, newest first (a top-n report)."""
    return factors.where(F.col("status") == "ACTIVE").orderBy(F.desc("updated_at"), "factor_id").limit(limit)


def upsert_latest(stored: DataFrame, incoming: DataFrame, key: str = "candidate_hash") -> DataFrame:
    """Definitions by hash: the stored row keeps its identity, the newest one its state."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    others = [c for c in stored.columns if c not in (key, "status", "metrics", "updated_at")]
    newest = F.struct("_new", "updated_at")
    return both.groupBy(key).agg(
        *[F.min_by(c, newest).alias(c) for c in others],
        *[F.max_by(c, newest).alias(c) for c in ("status", "metrics", "updated_at") if c in stored.columns],
    )


def supersede_sets(sets: DataFrame) -> DataFrame:
    """Only the newest factor set of a scope stays active."""
    later = F.lead("created_at").over(Window.partitionBy("scope").orderBy("created_at", "factor_set_id"))
    return sets.withColumn("status", F.when(later.isNotNull(), "SUPERSEDED").otherwise("ACTIVE"))


def equal_weight_set(factors: DataFrame, scope: str, policy: str = POLICY) -> DataFrame:
    """Equal-weight factor set per scope with a content-derived identity.

    Members are gathered into one row; a set holds at most a few hundred factors.
    """
    members = factors.groupBy(scope).agg(F.sort_array(F.collect_list(F.struct("factor_id", "version"))).alias("m"))
    weight = F.round(1 / F.size("m"), 8)
    parts = members.select(
        scope,
        F.transform("m", lambda x: x["factor_id"]).alias("factor_ids"),
        F.transform("m", lambda x: x["version"]).alias("factor_versions"),
        F.transform("m", lambda x: weight).alias("weights"),
    )
    body = F.to_json(F.struct("factor_ids", "factor_versions", "weights", F.lit(policy).alias("promotion_policy_version")))
    digest = F.sha2(body, 256)
    return parts.withColumns(
        {
            "factor_set_id": F.concat(F.lit("fs-"), F.substring(digest, 1, 16)),
            "factor_set_version": F.concat(F.lit("factor-set-"), F.substring(digest, 1, 12)),
        }
    )
