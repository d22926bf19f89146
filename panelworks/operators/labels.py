"""Weak labels: 61 causal columns per bar row; NULL marks an unavailable label."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.functions.frames import Frame, positioned, with_frames
from panelworks.functions.scalar import unit_clip
from panelworks.operators.features import EPS, true_range

# Label names by group, in their published order.
MOVING_AVERAGE = (
    "ma5_slope",
    "ma10_slope",
    "ma20_slope",
    "ma30_slope",
    "ma60_slope",
    "ma120_slope",
    "close_ma5_distance",
    "close_ma20_distance",
    "close_ma60_distance",
    "close_ma120_distance",
    "bull_alignment_score",
    "bear_alignment_score",
    "ma_trend_strength",
    "compression_score",
    "ma_expansion_score",
    "bull_cross_5_20",
    "bear_cross_5_20",
    "bull_cross_10_20",
    "bear_cross_10_20",
    "bull_cross_20_60",
    "bear_cross_20_60",
    "days_since_bull_cross_5_20",
    "days_since_bear_cross_5_20",
    "days_since_bull_cross_20_60",
    "days_since_bear_cross_20_60",
)
BOLLINGER = (
    "percent_b",
    "boll_zscore",
    "bandwidth",
    "bandwidth_delta_5",
    "bandwidth_delta_20",
    "squeeze_score",
    "boll_expansion_score",
    "upper_break_strength",
    "lower_break_strength",
    "bandwidth_percentile",
)
PRIMITIVES = (
    "trend_direction",
    "wyckoff_trend_strength",
    "trading_range_score",
    "range_position",
    "support_distance",
    "resistance_distance",
    "breakout_strength",
    "breakdown_strength",
    "false_breakout_score",
    "volume_expansion",
    "volume_contraction",
    "effort_result_score",
    "effort_result_divergence",
    "demand_pressure_proxy",
    "supply_pressure_proxy",
)
PHASES = ("accumulation_like", "markup", "distribution_like", "markdown", "transition")
EVENTS = ("sc_score", "bc_score", "spring_score", "upthrust_score", "sos_score", "sow_score")
LABELS = MOVING_AVERAGE + BOLLINGER + PRIMITIVES + PHASES + EVENTS
GROUPS = {
    "ma": MOVING_AVERAGE,
    "bollinger": BOLLINGER,
    "wyckoff_primitives": PRIMITIVES,
    "phase": PHASES,
    "events": EVENTS,
}
AUXILIARY = ("volume_expansion", "volume_contraction", "demand_pressure_proxy", "supply_pressure_proxy")
SPANS = (5, 10, 20, 30, 60, 120)
CROSSES = ((5, 20), (10, 20), (20, 60))
MEMORY = 120


def task_type(name: str) -> str:
    if name in PHASES:
        return "soft_distribution"
    event = name in EVENTS or name.startswith(("bull_cross_", "bear_cross_"))
    return "binary_event" if event else "regression"


def _truth(condition: Column) -> Column:
    """1.0 / 0.0 where an unknown comparison counts as false."""
    return F.coalesce(condition, F.lit(False)).cast("double")


def _row_deviation(df: DataFrame, values: Sequence[Column], out: str) -> DataFrame:
    """Population deviation across columns, skipping missing ones."""
    zero = F.lit(0.0)
    n = sum((v.isNotNull().cast("int") for v in values), F.lit(0))
    df = df.withColumns({f"{out}{i}": v for i, v in enumerate(values)}).withColumn("_n", n)
    held = [F.col(f"{out}{i}") for i in range(len(values))]
    total = sum((F.coalesce(v, zero) for v in held), zero)
    df = df.withColumn("_m", F.when(F.col("_n") > 0, total / F.col("_n")))
    gaps = [F.coalesce(v - F.col("_m"), zero) for v in held]
    squares = sum((g * g for g in gaps), zero)
    return df.withColumn(out, F.when(F.col("_n") > 0, F.sqrt(squares / F.col("_n"))))


def build_labels(bars: DataFrame, by: Sequence[str] = ("symbol",), keep: Sequence[str] = (), names: Sequence[str] = LABELS) -> DataFrame:
    """``*by, trading_date``, the columns to ``keep`` and the 61 labels (or those named).

    One exchange serves every window; bars that keep ``_row``, their position, from an earlier builder need none.
    """
    c, given = F.col, set(bars.columns)
    observed = (c("turnover_observed") > 0) if "turnover_observed" in given else c("turnover").isNotNull()
    taken = ("high", "low", "close", "volume", "turnover")
    carried = [n for n in keep if n != "_row"] + [n for n in ("_row",) if n in given]
    df = bars.select(
        *by, "trading_date", *carried, *[c(n).cast("double").alias(n) for n in taken], F.coalesce(observed, F.lit(False)).alias("_seen")
    )
    df = with_frames(
        df if "_row" in given else positioned(df, by, "trading_date", "_row"),
        "_row",
        {
            "_pc": Frame("lag", "close", 1),
            "_c20": Frame("lag", "close", 20),
            **{f"_ma{n}": Frame("mean", "close", n) for n in SPANS},
            "_sd": Frame("std", "close", 20),
            "_rh": Frame("max", "high", 40, 20, back=1),
            "_rl": Frame("min", "low", 40, 20, back=1),
            "_vm": Frame("mean", "volume", 20, 5),
        },
    )
    df = df.withColumns(
        {
            "_ret": F.coalesce(F.when(c("_pc") != 0, c("close") / c("_pc") - 1), F.lit(0.0)),
            "_t20": F.when(c("_c20") != 0, c("close") / c("_c20") - 1),
            "_v20": c("volume") / (c("_vm") + EPS),
            "_tr": true_range(c("_pc")),
            "_tl": F.when(c("_seen"), c("turnover")),
            "_bw": 4 * c("_sd") / (F.abs("_ma20") + EPS),
            **{f"_c{a}_{b}": c(f"_ma{a}") - c(f"_ma{b}") for a, b in CROSSES},
        }
    ).withColumn("_move", F.abs("_ret"))
    df = with_frames(
        df,
        "_row",
        {
            "_atr": Frame("mean", "_tr", 14, 1),
            "_sr1": Frame("std", "_ret", 20, 1),
            "_sr5": Frame("std", "_ret", 20, 5),
            "_path": Frame("sum", "_move", 20, 5),
            "_tm": Frame("mean", "_tl", 20, 5),
            "_bw5": Frame("lag", "_bw", 5),
            "_bw20": Frame("lag", "_bw", 20),
            "bandwidth_percentile": Frame("percentile", "_bw", MEMORY),
            **{f"_b{a}_{b}": Frame("lag", f"_c{a}_{b}", 1) for a, b in CROSSES},
            **{f"_ma{n}_5": Frame("lag", f"_ma{n}", 5) for n in SPANS},
        },
    )
    crosses: dict[str, Column] = {}
    for a, b in CROSSES:
        now, before = c(f"_c{a}_{b}"), c(f"_b{a}_{b}")
        known = now.isNotNull() & before.isNotNull()
        crosses[f"bull_cross_{a}_{b}"] = F.when(known, ((now > 0) & (before <= 0)).cast("double"))
        crosses[f"bear_cross_{a}_{b}"] = F.when(known, ((now < 0) & (before >= 0)).cast("double"))
    df = df.withColumns(
        {
            **{f"ma{n}_slope": F.when(c(f"_ma{n}_5") != 0, c(f"_ma{n}") / c(f"_ma{n}_5") - 1) for n in SPANS},
            **crosses,
            "bandwidth_delta_5": c("_bw") - c("_bw5"),
            "bandwidth_delta_20": c("_bw") - c("_bw20"),
            "_a": F.when(c("_atr") != 0, c("_atr")) + EPS,
        }
    )
    marked = [f"{kind}_cross_{a}_{b}" for kind in ("bull", "bear") for a, b in ((5, 20), (20, 60))]
    marked = [cross for cross in marked if f"days_since_{cross}" in names]
    if marked:
        df = with_frames(df, "_row", {f"_days_{cross}": Frame("since", cross, MEMORY) for cross in marked})
    for cross in marked:
        since = c(f"_days_{cross}") / float(MEMORY)
        df = df.withColumn(f"days_since_{cross}", F.when(c(cross).isNotNull(), since))
    close, high, low, atr, ret = c("close"), c("high"), c("low"), c("_a"), c("_ret")
    rh, rl, v20, t20 = c("_rh"), c("_rl"), c("_v20"), c("_t20")
    upper, lower = c("_ma20") + 2 * c("_sd"), c("_ma20") - 2 * c("_sd")
    ordered = [("_ma5", "_ma10"), ("_ma10", "_ma20"), ("_ma20", "_ma60")]
    root = math.sqrt(20)
    df = _row_deviation(df, [c(f"_ma{n}") / F.when(close != 0, close) for n in (5, 10, 20, 60)], "_comp")
    df = df.withColumns(
        {
            **{f"close_ma{n}_distance": close / (c(f"_ma{n}") + EPS) - 1 for n in (5, 20, 60, 120)},
            "bull_alignment_score": sum((_truth(c(a) > c(b)) for a, b in ordered), F.lit(0.0)) / 3.0,
            "bear_alignment_score": sum((_truth(c(a) < c(b)) for a, b in ordered), F.lit(0.0)) / 3.0,
            "ma_trend_strength": unit_clip(F.abs(t20) / (c("_sr1") * root + EPS)),
            "percent_b": (close - lower) / (upper - lower + EPS),
            "boll_zscore": (close - c("_ma20")) / (c("_sd") + EPS),
            "bandwidth": c("_bw"),
            "squeeze_score": 1.0 - c("bandwidth_percentile"),
            "boll_expansion_score": unit_clip(c("bandwidth_delta_5") / 0.05),
            "upper_break_strength": unit_clip((close - upper) / atr),
            "lower_break_strength": unit_clip((lower - close) / atr),
            "trend_direction": F.tanh(t20 * 8),
            "wyckoff_trend_strength": unit_clip(F.abs(t20) / (c("_sr5") * root + EPS)),
            "trading_range_score": unit_clip(1.0 - F.abs(t20) / (c("_path") + EPS)),
            "range_position": unit_clip((close - rl) / (rh - rl + EPS)),
            "support_distance": unit_clip((close - rl) / atr / 5.0),
            "resistance_distance": unit_clip((rh - close) / atr / 5.0),
            "breakout_strength": unit_clip((close - rh) / atr),
            "breakdown_strength": unit_clip((rl - close) / atr),
            "_fake_up": _truth((high > rh) & (close < rh)),
            "_fake_down": _truth((low < rl) & (close > rl)),
            "volume_expansion": unit_clip((v20 - 1.0) / 2.0),
            "volume_contraction": unit_clip((1.0 - v20) / 0.8),
            "_effort": (v20 + c("_tl") / (c("_tm") + EPS)) / 2.0,
            "_result": F.abs(ret) + c("_tr") / (close + EPS),
            "_pos": (close - low) / (high - low + EPS),
        }
    )
    push = 0.25 * F.tanh(ret * 10)
    df = df.withColumns(
        {
            "compression_score": unit_clip(1.0 - c("_comp") / 0.08),
            "ma_expansion_score": unit_clip(c("_comp") / 0.08),
            "false_breakout_score": unit_clip(c("_fake_up") + c("_fake_down")),
            "effort_result_score": F.when(c("_seen"), unit_clip(c("_effort") / (c("_result") + 0.02))),
            "effort_result_divergence": F.when(c("_seen"), F.tanh((c("_effort") - 1.0) - c("_result") * 10)),
            "demand_pressure_proxy": unit_clip(0.5 + push + 0.2 * (c("_pos") - 0.5) + 0.1 * c("volume_expansion")),
            "supply_pressure_proxy": unit_clip(0.5 - push + 0.2 * (0.5 - c("_pos")) + 0.1 * c("volume_expansion")),
        }
    )
    calm = 0.3 * (1 - c("wyckoff_trend_strength"))
    demand, supply = c("demand_pressure_proxy"), c("supply_pressure_proxy")
    ranging, up, down = c("trading_range_score"), unit_clip(c("trend_direction")), unit_clip(-c("trend_direction"))
    scores = {
        "accumulation_like": 1.2 * ranging + 0.8 * demand + calm,
        "markup": 1.2 * up + 0.8 * c("bull_alignment_score") + 0.3 * demand,
        "distribution_like": 1.2 * ranging + 0.8 * supply + calm,
        "markdown": 1.2 * down + 0.8 * c("bear_alignment_score") + 0.3 * supply,
        "transition": 1.0 - ranging * 0.5 - c("wyckoff_trend_strength") * 0.5,
    }
    df = df.withColumns({f"_s_{name}": score for name, score in scores.items()})
    scored = [c(f"_s_{name}") for name in PHASES]
    complete = F.lit(True)
    for score in scored:
        complete = complete & score.isNotNull()
    df = df.withColumn("_top", F.when(complete, F.greatest(*scored)))
    df = df.withColumns({f"_e_{name}": F.exp(F.greatest(c(f"_s_{name}") - c("_top"), F.lit(-30.0))) for name in PHASES})
    total = sum((c(f"_e_{name}") for name in PHASES), F.lit(0.0)) + EPS
    held = _truth(ranging > 0.25)
    trend = 1 - c("wyckoff_trend_strength") * 0.25
    volume = c("volume_expansion")
    made = {
        **{name: F.when(c("_top").isNotNull(), c(f"_e_{name}") / total) for name in PHASES},
        "sc_score": unit_clip((c("breakdown_strength") * 0.4 + volume * 0.3 + supply * 0.3) * trend),
        "bc_score": unit_clip((c("breakout_strength") * 0.4 + volume * 0.3 + demand * 0.3) * trend),
        "spring_score": unit_clip(c("_fake_down") * held * (0.5 + 0.5 * demand)),
        "upthrust_score": unit_clip(c("_fake_up") * held * (0.5 + 0.5 * supply)),
        "sos_score": unit_clip(c("breakout_strength") * 0.45 + demand * 0.35 + volume * 0.2),
        "sow_score": unit_clip(c("breakdown_strength") * 0.45 + supply * 0.35 + volume * 0.2),
    }
    return df.select(*by, "trading_date", *keep, *[(made[name] if name in made else c(name)).alias(name) for name in names])


def with_validity(labels: DataFrame) -> DataFrame:
    """Sink form: values with missing ones as 0, and one ``valid_`` flag per label."""
    keys = [name for name in labels.columns if name not in LABELS]
    return labels.select(
        *keys,
        *[F.coalesce(name, F.lit(0.0)).alias(name) for name in LABELS],
        *[F.col(name).isNotNull().alias(f"valid_{name}") for name in LABELS],
    )
