"""Named seed formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelworks.operators.formulas import vocabulary

# Name | hypothesis | formula.
SEED_TEXT = """
reversal_3d | short reversal | close close ts_delay_3 div neg cs_rank
reversal_10d | medium reversal | ret ts_sum_10 neg cs_rank
momentum_20d | price momentum | close close ts_delay_20 div cs_rank
volume_price_corr_10d | price volume divergence | close volume ts_corr_10 neg cs_rank
amount_surge_20d | crowded amount surge | amount amount ts_mean_20 div neg cs_rank
turnover_surge_5_20 | turnover crowding | turnover ts_mean_5 turnover ts_mean_20 div neg cs_rank
volatility_ratio_5_20 | volatility expansion | ret ts_std_5 ret ts_std_20 div neg cs_rank
vwap_deviation | vwap reversal | close vwap div neg cs_rank
intraday_position | intraday strength | close low sub high low sub div cs_rank
ma_momentum_5_20 | moving average momentum | close ts_mean_5 close ts_mean_20 div cs_rank
low_volatility | low volatility | ret ts_std_20 neg cs_rank
content_sentiment | verified content sentiment | theme_sentiment ts_sum_5 cs_rank
reversal_5d | five day reversal | close close ts_delay_5 div neg cs_rank
reversal_20d | twenty day reversal | ret ts_sum_20 neg cs_rank
ret_rank_reversal_10d | rank reversal | ret ts_rank_10 neg cs_rank
close_breakout_20d | breakout momentum | close high ts_max_20 div cs_rank
close_breakdown_20d | low repair | close low ts_min_20 div neg cs_rank
days_since_high_20d | near high | high ts_argmax_20 neg cs_rank
days_since_low_20d | near low | low ts_argmin_20 neg cs_rank
bias_20d | moving average bias | close close ts_mean_20 div neg cs_rank
ret_momentum_20d | return momentum | ret ts_mean_20 cs_rank
vwap_momentum_5d | vwap momentum | vwap ts_delta_5 cs_rank
return_volume_corr_10d | return volume correlation | ret volume ts_corr_10 neg cs_rank
volume_surge_5_20 | volume crowding | volume ts_mean_5 volume ts_mean_20 div neg cs_rank
volume_dryup_5_20 | volume dryup | volume ts_mean_5 volume ts_mean_20 div cs_rank
amount_delta_5d | amount change | amount ts_delta_5 cs_rank
amount_efficiency_10d | amount efficiency | ret ts_mean_10 amount ts_mean_10 div cs_rank
price_volume_cov_10d | price volume covariance | close volume ts_cov_10 neg cs_rank
volatility_contraction_20_60 | volatility contraction | ret ts_std_20 ret ts_std_60 div neg cs_rank
amplitude_low_5d | low amplitude | high low sub close div ts_mean_5 neg cs_rank
amplitude_stability_5d | amplitude stability | high low div ts_std_5 neg cs_rank
amplitude_ratio_5_20 | amplitude ratio | high low div ts_mean_5 high low div ts_mean_20 div neg cs_rank
price_range_width_20d | range width | high ts_max_20 low ts_min_20 sub close ts_mean_20 div neg cs_rank
vwap_deviation_stability_10d | vwap stability | close vwap div ts_std_10 neg cs_rank
lower_shadow_support_5d | lower shadow support | open close min low sub close div ts_mean_5 cs_rank
upper_shadow_pressure_5d | upper shadow pressure | high open close max sub close div ts_mean_5 neg cs_rank
turnover_mean_20d | low turnover | turnover ts_mean_20 neg cs_rank
turnover_volatility_20d | turnover stability | turnover ts_std_20 neg cs_rank
high_volume_reversal_5d | high volume reversal | ret ts_mean_5 volume ts_mean_5 volume ts_mean_20 div mul neg cs_rank
low_volatility_reversal_5d | low vol reversal | ret ts_mean_5 ret ts_std_20 neg mul neg cs_rank
high_volatility_reversal_5d | high vol reversal | ret ts_mean_5 ret ts_std_20 mul neg cs_rank
volume_conditioned_momentum_10d | volume conditioned momentum | ret ts_mean_10 volume ts_mean_5 volume ts_mean_20 div neg mul cs_rank
content_consensus | content consensus | cross_video_consensus ts_mean_5 cs_rank
content_attention | content attention | content_attention_score ts_mean_5 cs_rank
"""


def seed_rows() -> list[tuple[str, str, list[str]]]:
    """(name, hypothesis, tokens); entries with an unknown token are dropped."""
    known = set(vocabulary())
    parsed = [[part.strip() for part in line.split("|")] for line in SEED_TEXT.strip().splitlines()]
    rows = [(name, hypothesis, formula.split()) for name, hypothesis, formula in parsed]
    return [row for row in rows if row[2] and set(row[2]) <= known]


def seed_formulas() -> dict[str, list[str]]:
    return {name: rpn for name, _, rpn in seed_rows()}


def seed_table(spark: SparkSession) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(seed_rows())]
    return spark.createDataFrame(rows, "seq int, name string, hypothesis string, rpn array<string>")
