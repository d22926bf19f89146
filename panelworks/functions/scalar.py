"""Scalar helpers: clipping, normal distribution, symbols, versions, dates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholders that do not count as a version.
UNKNOWN_VERSIONS = ("", "UNKNOWN", "NONE", "NULL", "N/A", "NA")


def clip(x: Column, low: float, high: float) -> Column:
    """Limit ``x`` to [low, high]; NULL stays NULL (bare greatest/least skip it)."""
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def unit_clip(x: Column) -> Column:
    return clip(x, 0.0, 1.0)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def erfc(x: Column) -> Column:
    """Complementary error function (Spark has no built-in).

    Below 2.5 the Maclaurin-type series ``erf(a) = 2/sqrt(pi) e^{-a^2} sum
    2^k a^{2k+1}/(2k+1)!!`` (all terms positive); above it the continued
    fraction of the Mills ratio evaluated from its tail.
    """
    a = F.abs(x)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(a.cast("double").alias("term"), a.cast("double").alias("total")),
        lambda acc, k: F.struct(
            (acc["term"] * 2 * a * a / (2 * k + 1)).alias("term"),
            (acc["total"] + acc["term"] * 2 * a * a / (2 * k + 1)).alias("total"),
        ),
        lambda acc: 1 - 2 / math.sqrt(math.pi) * F.exp(-a * a) * acc["total"],
    )
    tail = F.aggregate(
        F.sequence(F.lit(60), F.lit(1), F.lit(-1)),
        F.lit(0.0),
        lambda acc, k: (k / 2) / (a + acc),
        lambda acc: F.exp(-a * a) / math.sqrt(math.pi) / (a + acc),
    )
    upper = F.when(a <= 2.5, series).otherwise(tail)
    return F.when(x >= 0, upper).when(x < 0, 2 - upper)


def erf(x: Column) -> Column:
    return 1 - erfc(x)


def normal_cdf(z: Column) -> Column:
    return 0.5 * erfc(-z / math.sqrt(2.0))


def is_known_version(value: Column) -> Column:
    return F.coalesce(~F.upper(F.trim(value)).isin(*UNKNOWN_VERSIONS), F.lit(False))


def normalize_symbol(value: Column) -> Column:
    """Canonical ``CN.A.dddddd`` / ``HK.ddddd`` / ``US.X`` identifier, else NULL."""
    raw = F.upper(F.trim(value))
    mainland = F.regexp_extract(raw, r"^(?:CN\.A\.)?([0-9]{6})(?:\.(?:SH|SZ|BJ))?$", 1)
    hong_kong = F.regexp_extract(raw, r"^(?:HK\.)?([0-9]{1,5})(?:\.HK)?$", 1)
    return (
        F.when(mainland != "", F.concat(F.lit("CN.A."), mainland))
        .when(hong_kong != "", F.concat(F.lit("HK."), F.lpad(hong_kong, 5, "0")))
        .when(raw.startswith("US."), raw)
        .when(raw.rlike(r"^[A-Z][A-Z0-9.\-]{0,15}$"), F.concat(F.lit("US."), raw))
    )


def symbol_exchange(value: Column) -> Column:
    return F.split_part(normalize_symbol(value), F.lit("."), F.lit(1))


def symbol_local_code(value: Column) -> Column:
    return F.split_part(normalize_symbol(value), F.lit("."), F.lit(-1))


def compact_date(value: Column) -> Column:
    """Date from ``yyyyMMdd`` text that may carry ``.0`` or lost zeros; bad -> NULL."""
    text = F.regexp_replace(value.cast("string"), r"\.0$", "")
    return F.when(F.length(text) <= 8, F.try_to_timestamp(F.lpad(text, 8, "0"), F.lit("yyyyMMdd")).cast("date"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two equal-length arrays; 0 when either one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = l2_norm(a) * l2_norm(b)
    return F.when(norms > 1e-12, dot / norms).otherwise(0.0)


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
