"""Content signals: eligibility, point-in-time visibility, panel features."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.functions.scalar import normalize_symbol

# Fixed values of the signal contract.
BULLISH, BEARISH = "BULLISH", "BEARISH"
VERIFIED = "EXTERNALLY_VERIFIED"
TRUTHS = ("EXTERNALLY_VERIFIED", "VERIFIED")
CATALYST_KINDS = ("FACT", "POLICY_FACT", "FINANCIAL_METRIC", "CAUSAL_THESIS")
RISK_KINDS = ("RISK_CONDITION",)
CLOCK_OFFSET = "8 hours"  # signals are compared on the UTC+8 clock
CUTOFF = "9 hours 25 minutes"
LOOKBACK_DAYS = 5
CONTENT_FEATURES = (
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
# Scores that a signal may carry, and the sums that fold up from signals.
SCORES = ("content_attention_score", "cross_video_consensus", "cross_video_disagreement")
SUMS = (
    "signals",
    *[f"n_{c}" for c in ("bull", "bear", "catalyst", "risk")],
    *[f"{part}_{c}" for part in ("sum", "has") for c in SCORES],
)
# Signals that one task folds (their days are some times as many rows), and tasks that may share one video of one day.
SIGNALS_PER_TASK, SALTS = 100_000, 16


@dataclass(frozen=True)
class SignalQuery:
    """As-of clocks and requirements of one point-in-time request."""

    business_as_of: datetime
    knowledge_as_of: datetime
    availability_as_of: datetime
    producer_commit: str
    min_support: int = 1
    allow_proxy: bool = False


def with_rejections(signals: DataFrame, query: SignalQuery) -> DataFrame:
    """Add ``reasons`` (why a signal is not admitted) and ``eligible``."""
    c = F.col
    quality = c("source_availability_quality")
    business = F.lit(query.business_as_of)
    rules = [
        (c("source_available_at") > F.lit(query.availability_as_of), "source_available_after_availability_cutoff"),
        (c("available_from") > F.lit(query.availability_as_of), "available_from_after_availability_cutoff"),
        (c("knowledge_projection_at") > F.lit(query.knowledge_as_of), "knowledge_projection_after_knowledge_cutoff"),
        (c("lifecycle_as_of") > F.lit(query.knowledge_as_of), "lifecycle_after_knowledge_cutoff"),
        (
            (c("occurrence_at") > business) | (c("business_as_of") > business),
            "business_temporal_binding_after_business_cutoff",
        ),
        (quality == "UNKNOWN", "unknown_source_availability"),
        ((quality == "PROXY") & F.lit(not query.allow_proxy), "proxy_source_not_allowed"),
        (~F.coalesce(F.upper("truth_status").isin(*TRUTHS), F.lit(False)), "unknown_truth_status"),
        (c("support_count").isNull() | (c("support_count") < query.min_support), "insufficient_or_unknown_support"),
        (~c("producer_commit").eqNullSafe(query.producer_commit), "producer_commit_mismatch"),
    ]
    reasons = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for rule, name in rules]))
    return signals.withColumn("reasons", reasons).withColumn("eligible", F.size("reasons") == 0)


def subject_symbols(signals: DataFrame, universe: DataFrame) -> DataFrame:
    """One row per signal and universe symbol it names in any identifying field.

    ``universe`` holds distinct canonical ``symbol`` values. The join is an equi
    join whose small side the planner finds by size.
    """
    named = [F.col(c) for c in ("symbol", "subject_key", "subject") if c in signals.columns]
    resolved = F.array_distinct(F.array_compact(F.array(*[normalize_symbol(c.cast("string")) for c in named])))
    exploded = signals.withColumn("_symbol", F.explode(resolved)).drop("symbol")
    return exploded.withColumnRenamed("_symbol", "symbol").join(universe, "symbol", "left_semi")


def visible_cells(signals: DataFrame, days: DataFrame, lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """Repeat each signal on the trading days that may see it (column ``d``).

    A day sees a signal made available by 09:25 of that day and at most
    ``lookback`` calendar days earlier. The candidate dates are listed per signal
    and matched by equality, so no range join is needed.
    """
    shown = _with_span(signals, lookback)
    candidates = shown.withColumn("trading_date", F.explode(F.sequence("_from", "_to"))).drop("_from", "_to")
    return candidates.join(F.broadcast(days.select("trading_date", "d")), "trading_date")  # calendar rows


def _with_span(signals: DataFrame, lookback: int) -> DataFrame:
    """Signals that any day may see, with the first and last date (``_from``, ``_to``) that may."""
    local = F.col("available_from") + F.expr(f"INTERVAL {CLOCK_OFFSET}")
    first = local.cast("date")
    review = F.upper(F.col("review_status")) if "review_status" in signals.columns else F.lit(None).cast("string")
    open_signals = signals.where(F.col("available_from").isNotNull() & (F.coalesce(review, F.lit("")) != "REJECTED"))
    cutoff = first.cast("timestamp_ntz") + F.expr(f"INTERVAL {CUTOFF}")
    late = (local.cast("timestamp_ntz") > cutoff).cast("int")
    spans = open_signals.withColumns({"_from": F.date_add(first, late), "_to": F.date_add(first, lookback)})
    return spans.where(F.col("_from") <= F.col("_to"))


def _text(name: str, df: DataFrame) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def _tagged(rows: DataFrame, *keys: str) -> DataFrame:
    """What the features need of each row, beside its keys."""
    scores = {name: (F.col(name).cast("double") if name in rows.columns else F.lit(None).cast("double")) for name in SCORES}
    sentiment = F.upper(_text("sentiment", rows))
    kind = F.upper(F.coalesce(F.nullif(_text("knowledge_kind", rows), F.lit("")), _text("kind", rows)))
    verified = F.upper(_text("truth_status", rows)) == VERIFIED
    bull, bear = sentiment == BULLISH, sentiment == BEARISH
    source = F.nullif(_text("source_video_id", rows), F.lit(""))
    video = F.coalesce(
        source, F.nullif(_text("knowledge_uid", rows), F.lit("")), F.nullif(_text("signal_id", rows), F.lit("")), F.lit("")
    )
    subject = F.coalesce(F.nullif(_text("subject_key", rows), F.lit("")), _text("subject", rows))
    return rows.select(
        *keys,
        subject.alias("subject"),
        video.alias("video"),
        source.isNotNull().alias("sourced"),
        bull.alias("bull"),
        bear.alias("bear"),
        (verified & bull & kind.isin(*CATALYST_KINDS)).alias("catalyst"),
        (verified & (kind.isin(*RISK_KINDS) | bear)).alias("risk"),
        *[scores[name].alias(name) for name in SCORES],
    )


def _first_fold(tagged: DataFrame, *keys: str) -> DataFrame:
    return tagged.groupBy(*keys, "subject", "video").agg(
        F.count(F.lit(1)).alias("signals"),
        F.max("sourced").alias("sourced"),
        *[F.count_if(c).alias(f"n_{c}") for c in ("bull", "bear", "catalyst", "risk")],
        *[F.sum(c).alias(f"sum_{c}") for c in SCORES],
        *[F.count(c).alias(f"has_{c}") for c in SCORES],
    )


def _fold(parts: DataFrame, *keys: str) -> DataFrame:
    return parts.groupBy(*keys).agg(F.max("sourced").alias("sourced"), *[F.sum(c).alias(c) for c in SUMS])


def visible_features(signals: DataFrame, days: DataFrame, n_signals: int, lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """``content_features`` of ``visible_cells``, without repeating every signal on its days.

    Signals that the same days see fold into one row first, and days are listed after that. ``n_signals`` is a bound on
    the rows; a task holds ``SIGNALS_PER_TASK`` of them, whatever their number. Rows of one video meet in as many tasks as
    there are salts, so that not even a single cell with all signals is one task's work.
    """
    tasks = max(int(signals.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_signals / SIGNALS_PER_TASK))
    salt = F.xxhash64(*[F.col(c) for c in ("signal_id", "knowledge_uid", "available_from") if c in signals.columns])
    spans = _with_span(signals, lookback).withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int"))
    span = ["symbol", "_from", "_to", "_salt"]
    tagged = _tagged(spans, *span).repartition(tasks, "symbol", "video", "_from", "_salt")
    seen = _first_fold(tagged, *span).drop("_salt").repartition(tasks, "symbol", "video")
    dated = seen.withColumn("trading_date", F.explode(F.sequence("_from", "_to")))
    cells = dated.join(F.broadcast(days.select("trading_date", "d")), "trading_date")  # calendar rows
    return _features(_fold(cells, "symbol", "d", "subject", "video"))


def content_features(cells: DataFrame) -> DataFrame:
    """Panel features per ``symbol, d`` from the signals visible there.

    Everything folds up from one pre-aggregate per (cell, subject, video), so a
    cell that holds a large share of all signals is reduced before any shuffle
    by cell.
    """
    return _features(_first_fold(_tagged(cells, "symbol", "d"), "symbol", "d"))


def _features(parts: DataFrame) -> DataFrame:
    """Features per cell from one row per (cell, subject, video).

    Each row counts for its video (no subject) and for its subject, so that both kinds fold in one pass.
    A source is its own video: a cell has as many sources as it has videos with one.
    """
    cell = ["symbol", "d"]
    subjects = F.array(F.lit(None).cast("string"), F.when(F.col("n_bull") + F.col("n_bear") > 0, F.nullif("subject", F.lit(""))))
    both = F.transform(subjects, lambda s, i: F.struct((i == 0).alias("whole"), s.alias("subject")))
    kept = F.filter(both, lambda k: k["whole"] | k["subject"].isNotNull())
    kinds = parts.withColumn("_kind", F.explode(kept)).drop("subject").select("*", "_kind.*").drop("_kind")
    per_video = _fold(kinds, *cell, "video", "whole", "subject")
    bull, bear = F.col("n_bull") > 0, F.col("n_bear") > 0
    lean = F.when(bull & ~bear, 1).when(bear & ~bull, -1).otherwise(0)
    groups = per_video.groupBy(*cell, "whole", "subject").agg(
        F.count(F.lit(1)).alias("videos"),
        F.count_if("sourced").alias("heat"),
        F.sum(lean).alias("theme"),
        *[F.sum(c).alias(c) for c in SUMS],
    )
    whole, shared = F.col("whole"), ~F.col("whole") & (F.col("videos") >= 2)

    def total(name: str) -> Column:
        return F.max(F.when(whole, F.col(name)))  # one such row per cell

    def count(name: str) -> Column:
        return total(name).cast("double").alias(name)

    def mean(name: str) -> Column:
        return F.when(total(f"has_{name}") > 0, total(f"sum_{name}") / total(f"has_{name}"))

    zero = F.lit(0.0)
    attention = F.coalesce(mean("content_attention_score"), total("signals") / F.greatest(total("heat"), F.lit(1)))
    consensus = F.coalesce(F.sum(F.when(shared, lean)).cast("double"), zero)
    disagreement = F.count_if(shared & bull & bear).cast("double")
    features = groups.groupBy(*cell).agg(
        count("heat").alias("event_heat"),
        count("theme").alias("theme_sentiment"),
        count("n_bull").alias("video_bullish_claim_count"),
        count("n_bear").alias("video_bearish_claim_count"),
        count("n_catalyst").alias("verified_catalyst_count"),
        count("n_risk").alias("verified_risk_count"),
        attention.alias("content_attention_score"),
        attention.alias("author_attention_score"),
        mean("cross_video_consensus").alias("given_consensus"),
        mean("cross_video_disagreement").alias("given_disagreement"),
        consensus.alias("consensus"),
        disagreement.alias("disagreement"),
    )
    given = F.col("given_consensus").isNotNull() | F.col("given_disagreement").isNotNull()

    def chosen(name: str) -> Column:
        return F.when(given, F.coalesce(f"given_{name}", zero)).otherwise(F.col(name)).alias(f"cross_video_{name}")

    return features.select(*cell, *CONTENT_FEATURES[:8], chosen("consensus"), chosen("disagreement"))


def with_content(panel: DataFrame, features: DataFrame) -> DataFrame:
    """Dense panel with the content features; a cell without signals holds 0."""
    joined = panel.join(features, ["symbol", "d"], "left")
    return joined.withColumns({name: F.coalesce(name, F.lit(0.0)) for name in CONTENT_FEATURES})
