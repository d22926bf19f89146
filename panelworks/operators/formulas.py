"""Formulas as data: validity, lookback, hashing, mutation, evaluation.

A formula is an array of tokens in postfix order. ``factor_values`` turns all
formulas of a batch into columns of one plan: a sub-formula that several
formulas share is computed once, per-symbol windows of all formulas share one
exchange, and the closing cross-section step runs on the long table.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.functions.elementwise import BINARY, ELEMENTWISE, TERNARY, UNARY, finite
from panelworks.functions.rolling import SYMBOL_GRID, TS_BINARY, TS_UNARY, Grid
from panelworks.operators.ranking import ordinal_rank, with_group_stats

# The formula vocabulary.
FEATURES = (
    "open",
    "high",
    "low",
    "close",
    "volume",
    "amount",
    "turnover",
    "vwap",
    "ret",
    "event_heat",
    "theme_sentiment",
    "video_bullish_claim_count",
    "video_bearish_claim_count",
    "verified_catalyst_count",
    "verified_risk_count",
    "content_attention_score",
    "author_attention_score",
    "cross_video_consensus",
    "cross_video_disagreement",
)
WINDOWS = (3, 4, 5, 8, 10, 15, 20, 30, 60, 120)
CROSS_SECTION = ("cs_rank", "cs_zscore", "cs_demean")
MAX_TOKENS = 16
FUTURE_MARKERS = ("lead", "future_return", "negative_delay", "centered_rolling")
MUTATIONS = {"ts_mean_5": "ts_mean_10", "ts_mean_10": "ts_mean_20", "ts_delay_3": "ts_delay_5"}
# Fixed value: a cross-section deviation below this is treated as flat.
FLAT = 1e-12
#: From this many cells a day, days are dealt to as many tasks as this, one or two to each.
DAY_CELLS, DAY_TASKS = 250_000, 512

WINDOWED = {**TS_UNARY, **TS_BINARY}
_WINDOWED_TOKEN = re.compile(r"^(" + "|".join(WINDOWED) + r")_(\d+)$")


def windowed_token(token: str) -> tuple[str, int] | None:
    """Split ``ts_mean_5`` into its name and window; None for any other token."""
    found = _WINDOWED_TOKEN.match(token)
    if found is None or int(found[2]) not in WINDOWS:
        return None
    return found[1], int(found[2])


def vocabulary() -> list[str]:
    windowed = [f"{name}_{w}" for name in WINDOWED for w in WINDOWS]
    return [*FEATURES, *windowed, *CROSS_SECTION, *ELEMENTWISE]


# --- formula tables: one row per candidate, ``rpn array<string>`` -------------------


def is_valid(rpn: Column) -> Column:
    """All tokens known, at least one token."""
    known = F.forall(rpn, lambda t: t.isin(*vocabulary()))
    return F.coalesce((F.size(rpn) > 0) & known, F.lit(False))


def looks_ahead(rpn: Column) -> Column:
    return F.exists(rpn, lambda t: t.rlike("|".join(FUTURE_MARKERS)))


def candidate_hash(rpn: Column) -> Column:
    return F.sha2(F.array_join(rpn, " "), 256)


def lookback_depth(rpn: Column) -> Column:
    """Days of history the formula's value at one day depends on.

    The fold keeps the depths of the operands seen so far, newest first; -1
    marks a formula that is unknown, looks ahead or does not reduce to one value.
    """
    pattern = "^(" + "|".join(WINDOWED) + ")_([0-9]+)$"

    def step(stack: Column, token: Column) -> Column:
        name = F.regexp_extract(token, pattern, 1)
        days = F.regexp_extract(token, pattern, 2)
        window = F.when(days != "", days.cast("int")).otherwise(0)
        arity = (
            F.when(token.isin(*FEATURES), 0)
            .when(name.isin(*TS_UNARY) & window.isin(*WINDOWS), 1)
            .when(name.isin(*TS_BINARY) & window.isin(*WINDOWS), 2)
            .when(token.isin(*UNARY, *CROSS_SECTION), 1)
            .when(token.isin(*BINARY), 2)
            .when(token.isin(*TERNARY), 3)
        )
        extra = F.when(name.isin("ts_delay", "ts_delta"), window).when(name != "", window - 1).otherwise(0)
        deepest = F.array_max(F.slice(stack, 1, F.greatest(arity, F.lit(1))))
        grown = F.concat(
            F.array(F.when(arity == 0, 1).otherwise(deepest + extra)),
            F.slice(stack, arity + 1, F.size(stack) + 1),
        )
        broken = arity.isNull() | (F.size(stack) < arity) | F.exists(stack, lambda v: v < 0)
        return F.when(broken, F.array(F.lit(-1))).otherwise(grown)

    final = F.aggregate(rpn, F.array().cast("array<int>"), step)
    depth = F.when(F.size(final) == 1, F.greatest(F.element_at(final, 1), F.lit(-1))).otherwise(-1)
    return F.when(looks_ahead(rpn), F.lit(-1)).otherwise(depth)


def canonical_candidates(candidates: DataFrame, budget: int) -> DataFrame:
    """Valid candidates, first of each hash by ``seq``, at most ``budget`` of them.

    ``candidates`` needs ``seq`` and ``rpn``. The budget is part of the contract.
    """
    valid = candidates.where(is_valid(F.col("rpn"))).withColumn("candidate_hash", candidate_hash(F.col("rpn")))
    others = [name for name in valid.columns if name not in ("candidate_hash", "seq")]
    first = valid.groupBy("candidate_hash").agg(
        F.min("seq").alias("seq"), *[F.min_by(name, "seq").alias(name) for name in others]
    )
    return first.orderBy("seq").limit(budget)


def mutate(rpn: Column) -> Column:
    """First replaceable token swapped; else ``neg`` before a closing rank; else NULL."""
    keys = F.array(*[F.lit(k) for k in MUTATIONS])
    table = F.create_map(*[F.lit(v) for pair in MUTATIONS.items() for v in pair])
    hits = F.filter(F.transform(rpn, lambda t, i: F.when(F.array_contains(keys, t), i)), lambda i: i.isNotNull())
    at = F.try_element_at(hits, F.lit(1))
    swapped = F.transform(rpn, lambda t, i: F.when(i == at, F.try_element_at(table, t)).otherwise(t))
    negated = F.concat(F.slice(rpn, 1, F.size(rpn) - 1), F.array(F.lit("neg"), F.lit("cs_rank")))
    return F.when(at.isNotNull(), swapped).when(F.try_element_at(rpn, F.lit(-1)) == "cs_rank", negated)


def mutated_candidates(candidates: DataFrame, reason: str, generation: int) -> DataFrame:
    """Next-round candidates with their lineage; rows without a mutation drop out."""
    return (
        candidates.withColumn("parent_candidate_hash", candidate_hash(F.col("rpn")))
        .withColumn("rpn", mutate(F.col("rpn")))
        .where(F.col("rpn").isNotNull())
        .withColumns(
            {
                "name": F.concat("name", F.lit(f"_r{generation}")),
                "hypothesis": F.concat(F.lit(f"mutation after {reason}: "), F.coalesce("hypothesis", F.lit(""))),
                "candidate_hash": candidate_hash(F.col("rpn")),
                "generation_round": F.lit(generation),
            }
        )
    )


def round_feedback(evaluated: DataFrame) -> DataFrame:
    """One row on a finished round: best fitness, verdict, whether hashes repeat."""
    best = F.max(F.coalesce("fitness", F.lit(0.0)))
    return evaluated.agg(
        F.coalesce(best, F.lit(0.0)).alias("quality"),
        F.when(F.count(F.lit(1)) == 0, "EMPTY_ROUND")
        .when(best <= 0, "LOW_FITNESS")
        .otherwise("IMPROVING")
        .alias("reason"),
        (F.count_distinct("candidate_hash") != F.count(F.lit(1))).alias("duplicates"),
    )


# --- evaluation ----------------------------------------------------------------------


@dataclass(frozen=True)
class Term:
    """One sub-formula: its token text, its step in the plan and how to build it."""

    key: str
    level: int
    kind: str  # feature | cell | window | section
    op: str = ""
    args: tuple[str, ...] = ()
    window: int = 0


def reduce_formula(rpn: Sequence[str], features: Iterable[str]) -> list[Term] | None:
    """Sub-formulas of one formula in build order; None when it cannot be computed."""
    have = set(features)
    if not 0 < len(rpn) <= MAX_TOKENS:
        return None
    open_terms: list[Term] = []
    built: dict[str, Term] = {}
    for token in rpn:
        named = windowed_token(token)
        if token in FEATURES:
            if token not in have:
                return None
            term = Term(token, 0, "feature")
        else:
            if named:
                kind, op, window, arity = "window", named[0], named[1], 2 if named[0] in TS_BINARY else 1
            elif token in CROSS_SECTION:
                kind, op, window, arity = "section", token, 0, 1
            elif token in ELEMENTWISE:
                kind, op, window, arity = "cell", token, 0, ELEMENTWISE[token][0]
            else:
                return None
            if len(open_terms) < arity:
                return None
            args = open_terms[-arity:]
            del open_terms[-arity:]
            key = " ".join([*(a.key for a in args), token])
            term = Term(key, 1 + max(a.level for a in args), kind, op, tuple(a.key for a in args), window)
        built.setdefault(term.key, term)
        open_terms.append(term)
    if len(open_terms) != 1:
        return None
    return sorted(built.values(), key=lambda t: t.level)


def computable(formulas: Mapping[str, Sequence[str]], features: Iterable[str]) -> dict[str, list[Term]]:
    have = list(features)
    reduced = {name: reduce_formula(rpn, have) for name, rpn in formulas.items()}
    return {name: terms for name, terms in reduced.items() if terms is not None}


def _section(df: DataFrame, op: str, source: str, out: str, keys: Sequence[str], tie: str, group_rows: int) -> DataFrame:
    """A cross-section operator on a wide table."""
    if op == "cs_rank":
        # missing values rank after all present ones and are blanked again
        missing = F.col(source).isNull()
        df = with_group_stats(df.withColumn("_gone", missing), keys, {"_n": F.count(source)}, group_rows)
        df = ordinal_rank(df, keys, ["_gone", source, tie], "_k", group_rows)
        return df.withColumn(out, F.when(~missing, F.col("_k") / F.col("_n"))).drop("_gone", "_n", "_k")
    df = with_group_stats(df, keys, {"_mean": F.avg(source), "_dev": F.stddev_pop(source)}, group_rows)
    centred = F.col(source) - F.col("_mean")
    value = centred if op == "cs_demean" else F.when(F.col("_dev") >= FLAT, centred / F.col("_dev"))
    return df.withColumn(out, value).drop("_mean", "_dev")


def formula_columns(
    panel: DataFrame,
    terms: Iterable[Term],
    group_rows: int,
    grid: Grid = SYMBOL_GRID,
    keys: Sequence[str] = ("d",),
    tie: str = "symbol",
) -> tuple[DataFrame, dict[str, str]]:
    """Add one column per distinct sub-formula; returns the table and key -> column."""
    unique = {t.key: t for t in terms}
    name = {key: key if t.kind == "feature" else f"t{i}" for i, (key, t) in enumerate(sorted(unique.items()))}
    df = panel
    for level in range(1, 1 + max((t.level for t in unique.values()), default=0)):
        here = [t for t in unique.values() if t.level == level]
        made = {}
        for t in here:
            operands = [F.col(name[a]) for a in t.args]
            if t.kind == "cell":
                made[name[t.key]] = ELEMENTWISE[t.op][1](*operands)
            elif t.kind == "window":
                made[name[t.key]] = WINDOWED[t.op](*operands, t.window, grid)
        df = df.withColumns(made)
        unsafe = {"add", "sub", "mul", "div", "signedpower", "ts_sum", "ts_std", "ts_cov", "ts_delta"}
        guarded = [name[t.key] for t in here if t.op in unsafe]
        df = df.withColumns({column: finite(F.col(column)) for column in guarded})
        for t in here:
            if t.kind == "section":
                df = _section(df, t.op, name[t.args[0]], name[t.key], keys, tie, group_rows)
    return df, name


def factor_values(
    panel: DataFrame,
    formulas: Mapping[str, Sequence[str]],
    group_rows: int,
    keep: Sequence[str] = (),
    by_day: bool = True,
) -> DataFrame:
    """All formulas over the panel, long: ``factor_id, symbol, d, slot, value, sort_value, *keep``.

    ``slot`` numbers the (factor, day) groups; ``sort_value`` orders a day like
    ``value`` does and keeps the sort of the closing rank usable for later ranks.

    Rows with a missing value are left out; a factor without rows is one that
    cannot be computed. ``group_rows`` bounds the symbols of one day. Without ``by_day`` the cells stay where the
    panel's rows are, for totals that are added in the tasks first.
    """
    usable = computable(formulas, panel.columns)
    plans = {}
    for factor_id, terms in usable.items():
        root = max(terms, key=lambda t: t.level)
        closing = root.op if root.kind == "section" else ""
        inner = terms[:-1] if closing else terms
        plans[factor_id] = (closing, root.args[0] if closing else root.key, inner)
    wide, name = formula_columns(panel, [t for *_, inner in plans.values() for t in inner], group_rows)
    if not plans:
        zero = [F.lit(0).cast("long").alias("slot"), F.lit(0.0).alias("value"), F.lit(0.0).alias("sort_value")]
        return panel.select(F.lit("").alias("factor_id"), "symbol", "d", *zero, *keep).where(F.lit(False))
    if by_day:
        # The wide rows are dealt by day, eight bytes a cell, and become cells only inside the tasks: every
        # later group has the day among its keys, so no cell is exchanged.
        tasks = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        if group_rows * len(plans) > DAY_CELLS:
            tasks = max(tasks, DAY_TASKS)
        needed = [name[key] for _, key, _ in plans.values()]
        wide = wide.select(*dict.fromkeys(["symbol", "d", *keep, *needed])).repartition(tasks, "d")
    # A long "slot" numbers (factor, day): sorting and grouping by it is much
    # cheaper than by a name and a day.
    names = F.array(*[F.lit(factor_id) for factor_id in plans])
    kinds = F.array(*[F.lit(closing) for closing, *_ in plans.values()])
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).cast("long").alias("i"), F.col(name[key]).cast("double").alias("raw"))
                for i, (_, key, _) in enumerate(plans.values())
            ]
        )
    )
    slot = F.shiftleft(F.col("cell.i"), 32) + F.col("d")
    long = (
        wide.select("symbol", "d", *keep, cells.alias("cell"))
        .select("d", slot.alias("slot"), "symbol", F.col("cell.raw").alias("raw"), *keep)
        .where(F.col("raw").isNotNull())
    )
    number = F.shiftright("slot", 32).cast("int")
    closings = {closing for closing, *_ in plans.values()}
    value = F.col("raw")
    key = ["d", "slot"]
    if closings != {""}:
        stats = {"_n": F.count(F.lit(1))} if "cs_rank" in closings else {}
        if closings & {"cs_zscore", "cs_demean"}:
            stats |= {"_mean": F.avg("raw"), "_dev": F.stddev_pop("raw")}
        long = with_group_stats(long, key, stats, group_rows, order=["raw", "symbol"])
        if "cs_rank" in closings:
            long = ordinal_rank(long, key, ["raw", "symbol"], "_k", group_rows)
        for column in {"_n", "_mean", "_dev", "_k"} - set(long.columns):
            long = long.withColumn(column, F.lit(None).cast("double"))
        centred = F.col("raw") - F.col("_mean")
        closing = kinds[number]
        value = (
            F.when(closing == "cs_rank", F.col("_k") / F.col("_n"))
            .when(closing == "cs_demean", centred)
            .when(closing == "cs_zscore", F.when(F.col("_dev") >= FLAT, centred / F.col("_dev")))
            .otherwise(F.col("raw"))
        )
        if closings == {"cs_rank"}:
            value = F.col("_k") / F.col("_n")
    ordered = closings <= {"", "cs_rank"}
    made = long.select(
        names[number].alias("factor_id"),
        "symbol",
        "d",
        "slot",
        value.alias("value"),
        (F.col("raw") if ordered else value).alias("sort_value"),
        *keep,
    )
    return made if ordered else made.where(F.col("value").isNotNull())
