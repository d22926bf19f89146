"""Block bootstraps against resampling one value at a time."""

import hashlib
import math

import numpy as np
import pytest

from panelworks.operators import bootstrap


def uniforms(seed, series, iteration, block):
    digest = hashlib.md5(":".join(map(str, (seed, *([] if series is None else [series]), iteration, block))).encode()).hexdigest()
    return int(digest[:13], 16) / 2**52, int(digest[13:26], 16) / 2**52


def moving(seed, series, iteration, n, length):
    places = []
    for j in range(math.ceil(n / length)):
        start = math.floor(uniforms(seed, series, iteration, j)[0] * (n - length + 1))
        places += range(start, start + length)
    return places[:n]


def stationary(seed, series, iteration, n, expected):
    places, j = [], 0
    while len(places) < n:
        start, size = uniforms(seed, series, iteration, j)
        size = math.floor(math.log(1 - size) / math.log(1 - 1 / expected)) + 1
        places += [(math.floor(start * n) + k) % n for k in range(size)]
        j += 1
    return places[:n]


@pytest.mark.parametrize("draw, boot", [(moving, bootstrap.moving_block_bootstrap), (stationary, bootstrap.stationary_bootstrap)])
def test_equals_plain_resampling_in_any_chunk(spark, monkeypatch, draw, boot):
    monkeypatch.setattr(bootstrap, "CHUNK", 7)
    rng = np.random.default_rng(1)
    series = {None: rng.normal(size=23), "a": rng.normal(size=40), "long": rng.normal(size=301)}
    rows = [(k, i, float(v), float(v * v)) for k, values in series.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "series_id string, position int, value double, companion double")
    names = {**bootstrap.STATISTICS, "largest": lambda x, y: (x + y).max(axis=1)}
    got = {(r.series_id, r.statistic): r for r in boot(df, 5.0 if draw is stationary else 5, 20, seed=3, statistics=names).collect()}
    assert len(got) == len(series) * len(names)
    for k, x in series.items():
        y = x * x
        samples = [draw(3, k, i, len(x), 5) for i in range(20)]
        plain = {
            "mean": [x[s].mean() for s in samples],
            "sharpe": [x[s].mean() / x[s].std(ddof=1) for s in samples],
            "hit_rate": [(x[s] > 0).mean() for s in samples],
            "correlation": [np.corrcoef(x[s], y[s])[0, 1] for s in samples],
            "median": [np.median(x[s]) for s in samples],
            "largest": [(x[s] + y[s]).max() for s in samples],
        }
        for name, values in plain.items():
            row = got[k, name]
            assert row.iterations == 20
            assert [row.ci_lower, row.ci_upper] == pytest.approx(list(np.quantile(values, [0.025, 0.975])), abs=1e-9)


def test_flat_series_has_no_ratio(spark):
    df = spark.createDataFrame([("flat", i, 1.0) for i in range(12)] + [("one", 0, 2.0)], "series_id string, position int, value double")
    got = {(r.series_id, r.statistic): r for r in bootstrap.moving_block_bootstrap(df, 4, 10, statistics=["mean", "sharpe", "correlation"]).collect()}
    assert got["flat", "mean"].ci_lower == 1.0 and got["flat", "mean"].iterations == 10
    for name in ("sharpe", "correlation"):
        assert got["flat", name].point_estimate is None and got["flat", name].ci_upper is None and got["flat", name].iterations == 0
    assert got["one", "mean"].point_estimate == 2.0 and got["one", "mean"].ci_lower is None and got["one", "sharpe"].point_estimate is None
