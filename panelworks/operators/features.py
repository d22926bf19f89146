"""Causal model inputs: 36 continuous and 15 state columns per bar row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.functions.elementwise import finite
from panelworks.functions.frames import Frame, positioned, with_frames
from panelworks.functions.scalar import clip
from panelworks.operators.quantiles import exact_quantiles

# Fixed value: keeps ratios over a zero range finite.
EPS = 1e-8
# Column names in their published order.
CONTINUOUS = (
    "ret_1",
    "ret_3",
    "ret_5",
    "ret_10",
    "open_prev_close",
    "high_prev_close",
    "low_prev_close",
    "close_prev_close",
    "intraday_range_prev_close",
    "intraday_body_prev_close",
    "body_ratio",
    "upper_shadow_ratio",
    "lower_shadow_ratio",
    "range_position",
    "gap_ratio",
    "log1p_volume",
    "volume_ratio_5",
    "volume_ratio_10",
    "volume_ratio_20",
    "volume_ratio_60",
    "volume_zscore_20",
    "volume_zscore_60",
    "volume_change_1",
    "volume_change_5",
    "amount_ratio_5",
    "amount_ratio_20",
    "turnover",
    "turnover_ratio_5",
    "turnover_ratio_20",
    "turnover_zscore_20",
    "true_range_close",
    "atr14_close",
    "realized_vol_5",
    "realized_vol_20",
    "realized_vol_60",
    "range_atr14",
)
STATES = (
    "is_suspended",
    "is_st",
    "is_star_st",
    "is_delisting",
    "is_limit_up",
    "is_limit_down",
    "st_observed",
    "suspension_observed",
    "limit_observed",
    "delisting_observed",
    "turnover_observed",
    "price_observed",
    "volume_observed",
    "listing_days_norm",
    "quality_mask",
)
FEATURES = CONTINUOUS + STATES


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def true_range(previous_close: Column, side: str = "") -> Column:
    """Largest of the day's range and its two gaps; missing parts are skipped."""
    high, low = F.col(f"{side}high"), F.col(f"{side}low")
    return F.greatest(F.abs(high - low), F.abs(high - previous_close), F.abs(low - previous_close))


def build_features(bars: DataFrame, by: Sequence[str] = ("symbol",), keep: Sequence[str] = ()) -> DataFrame:
    """``*by, trading_date``, the columns to ``keep`` and the 51 feature columns.

    All windows share one partitioning and ordering, so the plan has a single
    exchange and sort; bars that keep ``_row``, their position, from an earlier builder need none. A bar without turnover
    stays; its flag tells.
    """
    return _built(bars, by, keep, ("",), STATES)


def paired_features(bars: DataFrame, sides: Sequence[str], by: Sequence[str] = ("symbol",)) -> DataFrame:
    """The continuous features of several forms of the same bars side by side; ``sides`` prefix the names of each form's columns."""
    return _built(bars, by, (), sides, ())


def _built(bars: DataFrame, by: Sequence[str], keep: Sequence[str], sides: Sequence[str], states: Sequence[str]) -> DataFrame:
    parts = [_parts(set(bars.columns), side) for side in sides]

    def merged(step: int) -> dict:
        return {f"{side}{name}": made for side, part in zip(sides, parts) for name, made in part[step].items()}

    base = bars.withColumns(merged(0)).withColumns(merged(1))
    base = base if "_row" in bars.columns else positioned(base, by, "trading_date", "_row")
    rolled = with_frames(with_frames(base, "_row", merged(2)).withColumns(merged(3)), "_row", merged(4))
    values, flags = merged(5), merged(6)
    names = [f"{side}{name}" for side in sides for name in CONTINUOUS]
    made = rolled.select(
        *by,
        "trading_date",
        *keep,
        *[values[name].alias(name) for name in names],
        *[F.coalesce(flags[name], F.lit(0.0)).alias(name) for name in states],
    )
    return made.select(*by, "trading_date", *keep, *[finite(F.col(name)).alias(name) for name in names], *states)


def _parts(given: set[str], side: str) -> tuple[dict, ...]:
    """Base columns, their derived ones, frames, what follows from them, frames of that, continuous features and states."""

    def c(name: str) -> Column:
        return F.col(f"{side}{name}")

    def optional(name: str) -> Column:
        return c(name).cast("double") if f"{side}{name}" in given else F.lit(None).cast("double")

    def flag(value: str, name: str) -> Column:
        if f"{side}{name}" in given:
            return F.coalesce(c(name).cast("double"), F.lit(0.0))
        return optional(value).isNotNull().cast("double")

    def frames(wanted: dict[str, tuple[str, str, int]]) -> dict[str, Frame]:
        return {name: Frame(kind, f"{side}{column}", rows) for name, (kind, column, rows) in wanted.items()}

    present = c("open").isNotNull() & c("high").isNotNull() & c("low").isNotNull() & c("close").isNotNull()
    base = {n: c(n).cast("double") for n in ("open", "high", "low", "close", "volume", "amount")}
    derived = {
        "_turn": F.coalesce(optional("turnover"), F.lit(0.0)),
        "_lv": F.log1p(clip(c("volume"), 0.0, float("inf"))),
        "_range": clip(c("high") - c("low"), 0.0, float("inf")),
        "_present": present,
    }
    first = frames(
        {
            "_pc": ("lag", "close", 1),
            **{f"_close_{k}": ("lag", "close", k) for k in (3, 5, 10)},
            **{f"_volume_{k}": ("lag", "volume", k) for k in (1, 5)},
            **{f"_vm{n}": ("mean", "volume", n) for n in (5, 10, 20, 60)},
            **{f"_am{n}": ("mean", "amount", n) for n in (5, 20)},
            **{f"_tm{n}": ("mean", "_turn", n) for n in (5, 20)},
            **{f"_lm{n}": ("mean", "_lv", n) for n in (20, 60)},
            **{f"_ls{n}": ("std", "_lv", n) for n in (20, 60)},
            "_ts20": ("std", "_turn", 20),
        }
    )

    def change(value: str, base: str) -> Column:
        return ratio(c(value), c(base)) - 1

    def zscore(value: str, mean: str, deviation: str) -> Column:
        return F.when(c(deviation) != 0, (c(value) - c(mean)) / (c(deviation) + EPS))

    changes = {
        "_tr": true_range(c("_pc"), side),
        "ret_1": change("close", "_pc"),
        **{f"ret_{k}": change("close", f"_close_{k}") for k in (3, 5, 10)},
        **{f"volume_change_{k}": change("volume", f"_volume_{k}") for k in (1, 5)},
        **{f"volume_zscore_{n}": zscore("_lv", f"_lm{n}", f"_ls{n}") for n in (20, 60)},
        "turnover_zscore_20": zscore("_turn", "_tm20", "_ts20"),
    }
    second = frames({"_atr": ("mean", "_tr", 14), **{f"realized_vol_{n}": ("std", "ret_1", n) for n in (5, 20, 60)}})
    pc, high, low, open_, close = c("_pc"), c("high"), c("low"), c("open"), c("close")
    top, bottom, span = F.greatest(open_, close), F.least(open_, close), c("_range") + EPS
    observed = {
        "turnover_observed": flag("turnover", "turnover_observed"),
        "price_observed": flag("close", "price_observed") * c("_present").cast("double"),
        "volume_observed": flag("volume", "volume_observed") * c("volume").isNotNull().cast("double"),
    }
    suspended = (
        optional("is_suspended")
        if f"{side}is_suspended" in given
        else (F.coalesce(c("volume") <= 0, F.lit(False)) | ~c("_present")).cast("double")
    )
    consistent = c("_present") & c("volume").isNotNull() & (high >= top) & (low <= bottom) & (high >= low)
    quality = F.coalesce(consistent, F.lit(False)).cast("double")
    values = {
        **{f"ret_{k}": c(f"ret_{k}") for k in (1, 3, 5, 10)},
        "open_prev_close": ratio(open_, pc) - 1,
        "high_prev_close": ratio(high, pc) - 1,
        "low_prev_close": ratio(low, pc) - 1,
        "close_prev_close": ratio(close, pc) - 1,
        "intraday_range_prev_close": ratio(c("_range"), pc),
        "intraday_body_prev_close": ratio(close - open_, pc),
        "body_ratio": F.abs(close - open_) / span,
        "upper_shadow_ratio": (high - top) / span,
        "lower_shadow_ratio": (bottom - low) / span,
        "range_position": (close - low) / span,
        "gap_ratio": ratio(open_ - pc, pc),
        "log1p_volume": c("_lv"),
        **{f"volume_ratio_{n}": ratio(c("volume"), c(f"_vm{n}")) for n in (5, 10, 20, 60)},
        **{name: c(name) for name in ("volume_zscore_20", "volume_zscore_60", "volume_change_1", "volume_change_5")},
        **{f"amount_ratio_{n}": ratio(c("amount"), c(f"_am{n}")) for n in (5, 20)},
        "turnover": c("_turn"),
        **{f"turnover_ratio_{n}": ratio(c("_turn"), c(f"_tm{n}")) for n in (5, 20)},
        "turnover_zscore_20": c("turnover_zscore_20"),
        "true_range_close": ratio(c("_tr"), close),
        "atr14_close": ratio(c("_atr"), close),
        **{f"realized_vol_{n}": c(f"realized_vol_{n}") for n in (5, 20, 60)},
        "range_atr14": ratio(c("_range"), c("_atr")),
    }
    states = {
        "is_suspended": suspended,
        **{name: optional(name) for name in ("is_st", "is_star_st", "is_delisting", "is_limit_up", "is_limit_down")},
        "st_observed": flag("is_st", "st_observed"),
        "suspension_observed": flag("is_suspended", "suspension_observed"),
        "limit_observed": flag("is_limit_up", "limit_observed"),
        "delisting_observed": flag("is_delisting", "delisting_observed"),
        **observed,
        "listing_days_norm": clip(optional("listing_days") / 252.0, 0.0, 20.0),
        "quality_mask": F.coalesce(optional("quality_mask"), quality),
    }
    return base, derived, first, changes, second, values, states


# Features that a usable row may miss.
OPTIONAL = (
    "volume_zscore_20",
    "volume_zscore_60",
    "turnover",
    "turnover_ratio_5",
    "turnover_ratio_20",
    "turnover_zscore_20",
)


def seal_quality(features: DataFrame, optional: Sequence[str] = OPTIONAL) -> DataFrame:
    """Clear ``quality_mask`` on rows that miss a required continuous feature."""
    complete = F.lit(True)
    for name in CONTINUOUS:
        if name not in optional:
            complete = complete & F.col(name).isNotNull()
    return features.withColumn("quality_mask", F.col("quality_mask") * complete.cast("double"))


def fit_scaler(rows: DataFrame, columns: Sequence[str] = CONTINUOUS, floor: float = 1e-6, kept: bool = False) -> DataFrame:
    """Median and robust scale per column, one row: ``<name>_median, <name>_scale``.

    Quartiles are exact. A column without data gets 0 and 1. ``kept`` rows are part of a stored table and not stored again.
    """
    quartiles = exact_quantiles(rows, columns, (0.25, 0.5, 0.75), kept=kept)
    cells = {}
    for name in columns:
        low, middle, high = quartiles[name]
        spread = 0.0 if middle is None else (high - low) / 1.349
        cells[f"{name}_median"] = 0.0 if middle is None else middle
        cells[f"{name}_scale"] = spread if spread > floor else 1.0
    return rows.sparkSession.createDataFrame([tuple(cells.values())], ", ".join(f"{c} double" for c in cells))


def apply_scaler(features: DataFrame, scaler: DataFrame, columns: Sequence[str] = CONTINUOUS, limit: float = 8.0) -> DataFrame:
    """Centre, scale, replace missing by 0 and clip; the scaler is one row."""
    joined = features.crossJoin(F.broadcast(scaler))
    scaled = {
        name: clip(F.coalesce((F.col(name) - F.col(f"{name}_median")) / F.col(f"{name}_scale"), F.lit(0.0)), -limit, limit)
        for name in columns
    }
    return joined.withColumns(scaled).drop(*scaler.columns)
