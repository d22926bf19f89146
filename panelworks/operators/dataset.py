"""Leakage-safe splits, window samples and their materialisation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.functions.rolling import Rolling
from panelworks.operators.evaluate import spaced_days
from panelworks.operators.ranking import ordinal_rank

# Fixed values of the sample contract.
WINDOW_ROWS = 128
STRIDE = 5
MIN_LISTING_DAYS = 160
MIN_QUALITY = 0.80
GAP_DAYS = 40


@dataclass(frozen=True)
class TimeSplit:
    """Train / valid / test date ranges (inclusive) with a gap between them."""

    train: tuple[date, date]
    valid: tuple[date, date]
    test: tuple[date, date]
    gap_days: int = GAP_DAYS

    def __post_init__(self) -> None:
        ordered = [self.train, self.valid, self.test]
        for start, end in ordered:
            if end < start:
                raise ValueError("a split range ends before it starts")
        for (_, end), (start, _) in zip(ordered, ordered[1:], strict=False):
            if start <= end:
                raise ValueError("split ranges overlap")
            if (start - end).days < self.gap_days:
                raise ValueError(f"split gap is smaller than {self.gap_days} days")

    def ranges(self) -> dict[str, tuple[date, date]]:
        return {"train": self.train, "valid": self.valid, "test": self.test}


def split_of(day: Column, split: TimeSplit) -> Column:
    """Name of the range that holds a date, NULL in the gaps."""
    named = F.lit(None).cast("string")
    for name, (start, end) in split.ranges().items():
        named = F.when(day.between(F.lit(start), F.lit(end)), name).otherwise(named)
    return named


def split_conflicts(samples: DataFrame) -> DataFrame:
    """(symbol, as_of) keys that sit in more than one split; ``test`` means ``time_test``."""
    name = F.when(F.col("split") == "test", "time_test").otherwise(F.col("split"))
    splits = samples.groupBy("symbol", "as_of").agg(F.sort_array(F.collect_set(name)).alias("splits"))
    return splits.where(F.size("splits") > 1)


def _tuple_text(fields: Sequence[str]) -> Column:
    """A key tuple in the text form used inside the split hash: (), ('a',), ('a', 'b')."""
    quoted = [F.concat(F.lit("'"), F.coalesce(F.col(f).cast("string"), F.lit("UNKNOWN")), F.lit("'")) for f in fields]
    inner = F.concat_ws(", ", *quoted) if quoted else F.lit("")
    return F.concat(F.lit("("), inner, F.lit(",)" if len(fields) == 1 else ")"))


def symbol_holdout(
    symbols: DataFrame, strata: Sequence[str], n_symbols: int, ratio: float = 0.2, seed: int = 42
) -> DataFrame:
    """Reproducible symbol-disjoint holdout: ``symbol, stratum, is_holdout``.

    Inside each stratum symbols are ordered by a seeded hash and the first
    share is held out; a stratum always keeps at least one training symbol.
    """
    ratio = min(max(ratio, 0.0), 0.95)
    first = [F.first(name, ignorenulls=True).alias(name) for name in strata]
    unique = symbols.groupBy("symbol").agg(F.count(F.lit(1)).alias("_rows"), *first)
    text = F.col("symbol").cast("string")
    keyed = unique.withColumn("stratum", _tuple_text(strata)).withColumns(
        {
            "_hash": F.sha2(F.concat_ws(":", F.lit(str(seed)), "stratum", text), 256),
            "_plain": F.sha2(F.concat_ws(":", F.lit(str(seed)), text), 256),
        }
    )
    ranked = ordinal_rank(keyed, ["stratum"], ["_hash", "symbol"], "_k", n_symbols)
    sizes = keyed.groupBy("stratum").agg(F.count(F.lit(1)).alias("_n"))
    wanted = F.bround(F.col("_n") * ratio).cast("int")
    if ratio > 0:
        wanted = F.when(F.col("_n") >= 5, F.greatest(wanted, F.lit(1))).otherwise(wanted)
    wanted = F.least(wanted, F.greatest(F.col("_n") - 1, F.lit(0)))
    marked = ranked.join(sizes, "stratum").withColumn("is_holdout", F.col("_k") <= wanted)
    # one row: the symbol to hold out when every stratum is too small
    fallback = marked.agg(
        F.when(
            F.lit(ratio > 0) & (F.count(F.lit(1)) >= 2) & ~F.bool_or("is_holdout"), F.min("_plain")
        ).alias("_pick")
    )
    picked = F.coalesce(F.col("_plain") == F.col("_pick"), F.lit(False))
    return marked.crossJoin(F.broadcast(fallback)).select(
        "symbol", "stratum", (F.col("is_holdout") | picked).alias("is_holdout")
    )


def hashed_symbols(symbols: DataFrame, limit: int, seed: int = 42) -> DataFrame:
    """First ``limit`` symbols in seeded hash order (a sampling rule)."""
    text = F.concat(F.lit(f"{seed}:"), F.col("symbol").cast("string"))
    return symbols.select("symbol").distinct().orderBy(F.sha2(text, 256)).limit(limit)


def symbol_list_hash(symbols: DataFrame) -> DataFrame:
    """Order-free hash of the distinct symbols: 60-bit parts of their hashes are summed, for universes of any size."""
    unique = symbols.select(F.sha2(F.col("symbol").cast("string"), 256).alias("digest")).distinct()
    parts = [F.conv(F.substring("digest", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(3)]
    sums = unique.agg(
        F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(p), F.lit(0)).cast("string").alias(f"p{i}") for i, p in enumerate(parts)]
    )
    return sums.select("n", F.sha2(F.concat_ws(":", "n", "p0", "p1", "p2"), 256).alias("symbols_hash"))


def eligible_samples(
    rows: DataFrame,
    split: TimeSplit,
    window: int = WINDOW_ROWS,
    stride: int = STRIDE,
    min_listing: int = MIN_LISTING_DAYS,
    min_quality: float = MIN_QUALITY,
) -> DataFrame:
    """Sample ends per symbol and split, at least ``stride`` rows apart.

    ``rows`` holds ``symbol, trading_date, listing_days, quality_mask``; row
    positions follow the date. A window may not reach before its split. Only
    row positions are folded per symbol, so the state is bounded by the calendar.
    """
    w = Rolling()
    placed = rows.withColumns(
        {
            "position": F.row_number().over(w.ordered) - 1,
            "quality_ratio": w.mean(F.col("quality_mask"), window, 1),
            "split": split_of(F.col("trading_date"), split),
        }
    ).where(F.col("split").isNotNull())
    first = F.min("position").over(Window.partitionBy("symbol", "split"))
    usable = placed.withColumn("_first", first).where(
        (F.col("position") - F.col("_first") >= window - 1)
        & (F.col("listing_days") >= min_listing)
        & (F.col("quality_mask") > 0)
        & (F.col("quality_ratio") >= min_quality)
    )
    record = F.struct("position", F.col("trading_date").alias("as_of"), "quality_ratio")
    series = usable.groupBy("symbol", "split").agg(F.sort_array(F.collect_list(record)).alias("ends"))
    kept = spaced_days(F.transform("ends", lambda e: e["position"]), stride, F.lit(-stride))
    chosen = series.withColumn("kept", kept).withColumn(
        "end", F.explode(F.filter("ends", lambda e: F.array_contains("kept", e["position"])))
    )
    return chosen.select(
        "symbol",
        (F.col("end.position") - window + 1).alias("start_index"),
        F.col("end.position").alias("end_index"),
        F.col("end.as_of").alias("as_of"),
        "split",
        F.col("end.quality_ratio").alias("quality_ratio"),
    )


def assign_roles(samples: DataFrame, holdout: DataFrame) -> DataFrame:
    """Final split names: holdout symbols serve only as instrument or double tests."""
    names = (
        F.when(~F.col("is_holdout") & (F.col("split") == "test"), "time_test")
        .when(~F.col("is_holdout"), F.col("split"))
        .when(F.col("split") == "valid", "instrument_test")
        .when(F.col("split") == "test", "double_oos")
    )
    joined = samples.join(holdout.select("symbol", "is_holdout"), "symbol")
    return joined.withColumn("split", names).where(F.col("split").isNotNull()).drop("is_holdout")


def evenly_spaced(index: Column, total: Column, wanted: int) -> Column:
    """Whether a 0-based row index is one of ``wanted`` evenly spaced positions.

    The positions are the truncated points of an even grid from 0 to total-1;
    the test inverts the grid, so no index table is joined.
    """
    if wanted <= 1:
        return index == 0
    step = (total - 1).cast("double") / (wanted - 1)
    guess = F.floor(index / step)
    hits = [
        (F.floor((guess + k) * step) == index) & (guess + k >= 0) & (guess + k < wanted - 1) for k in (-1, 0, 1)
    ]
    return (total <= wanted) | hits[0] | hits[1] | hits[2] | (index == total - 1)


def chronological_parts(rows: DataFrame, order: str, share: float = 0.8, *, n_rows: int) -> DataFrame:
    """Mark the first ``share`` of all rows by ``order`` as train, the rest as test."""
    total = rows.agg(F.count(F.lit(1)).alias("_n"))
    ranked = ordinal_rank(rows.withColumn("_all", F.lit(0)), ["_all"], [order], "_k", n_rows)
    cut = F.least(F.greatest(F.lit(1), F.floor(F.col("_n") * share)), F.greatest(F.lit(1), F.col("_n") - 1))
    marked = ranked.crossJoin(F.broadcast(total))  # one row
    return marked.withColumn("part", F.when(F.col("_k") <= cut, "train").otherwise("test")).drop("_k", "_n", "_all")


def window_arrays(rows: DataFrame, samples: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Samples with their window as an array of feature rows.

    A symbol's series is gathered once (bounded by the calendar) and every
    sample takes a slice of it, so overlapping windows are never recomputed.
    """
    record = F.struct("trading_date", F.array(*[F.col(c).cast("float") for c in columns]).alias("v"))
    series = rows.groupBy("symbol").agg(F.sort_array(F.collect_list(record)).alias("series"))
    values = F.transform("series", lambda r: r["v"])
    length = F.col("end_index") - F.col("start_index") + 1
    return samples.join(series, "symbol").withColumn("window", F.slice(values, F.col("start_index") + 1, length)).drop("series")
