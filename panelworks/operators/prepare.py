"""Bar preparation, validation and identity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")


def _all_present() -> Column:
    present = F.lit(True)
    for name in PRICES:
        present = present & F.col(name).isNotNull()
    return present


def with_state_flags(bars: DataFrame, status_known: bool = True) -> DataFrame:
    """Suspension, observation and listing-age columns of prepared bars."""
    zero = F.lit(0.0)
    suspended = F.coalesce(F.col("volume") <= 0, F.lit(False)) | F.col("close").isNull()
    age = F.row_number().over(Window.partitionBy("symbol").orderBy("trading_date"))
    return bars.withColumns(
        {
            "is_suspended": suspended.cast("double"),
            "is_star_st": zero,
            "is_delisting": zero,
            "is_limit_up": zero,
            "is_limit_down": zero,
            "st_observed": F.lit(1.0 if status_known else 0.0),
            "suspension_observed": F.lit(1.0),
            "limit_observed": zero,
            "delisting_observed": zero,
            "price_observed": _all_present().cast("double"),
            "volume_observed": F.col("volume").isNotNull().cast("double"),
            "listing_days": age,
        }
    )


def quality_violations(bars: DataFrame) -> DataFrame:
    """Rows that break a price or quantity rule, with the names of the rules."""
    present = _all_present()
    suspended = F.col("is_suspended") > 0

    def broken(rule: Column) -> Column:
        return ~F.coalesce(rule, F.lit(False))

    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    rules = [
        (broken(suspended | present), "price_missing"),
        (present & broken(F.col("high") >= top), "high_below_body"),
        (present & broken(F.col("low") <= bottom), "low_above_body"),
        (present & broken(F.col("high") >= F.col("low")), "high_below_low"),
        *[(broken(F.col(name) >= 0), f"{name}_negative") for name in ("volume", "amount", "turnover")],
    ]
    reasons = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for rule, name in rules]))
    return bars.withColumn("violations", reasons).where(F.size("violations") > 0)


def snapshot_report(bars: DataFrame) -> DataFrame:
    """One row of validation counts; a valid snapshot has zeros in every ``bad_`` column."""
    active = ~(F.coalesce(F.col("volume") <= 0, F.lit(False)) | F.col("close").isNull())
    keys = bars.groupBy("symbol", "trading_date").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(active & F.col(c).isNull()).alias(f"bad_{c}") for c in PRICES],
        *[F.count_if(F.col(c).isNull()).alias(f"bad_{c}") for c in ("volume", "amount", "turnover")],
    )
    return keys.agg(
        F.sum("n").alias("row_count"),
        F.min("trading_date").alias("min_date"),
        F.max("trading_date").alias("max_date"),
        F.count_if(F.col("n") > 1).alias("bad_duplicate_keys"),
        *[F.sum(f"bad_{c}").alias(f"bad_{c}") for c in (*PRICES, "volume", "amount", "turnover")],
    )


def content_digest(df: DataFrame, by: str = "symbol") -> DataFrame:
    """Order-free digest of a table: rows per key, then keys.

    Row digests are summed as three 60-bit parts per key, so neither level
    gathers rows; the digest of a key hashes its sums.
    """
    parts = _digest_parts(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256))
    keyed = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *_sum_parts(parts))
    digest = F.sha2(F.concat_ws(":", F.col(by).cast("string"), "n", "p0", "p1", "p2"), 256)
    whole = keyed.withColumn("_digest", digest)
    totals = whole.agg(F.sum("n").alias("row_count"), *_sum_parts(_digest_parts(F.col("_digest"))))
    return totals.select("row_count", F.sha2(F.concat_ws(":", "row_count", "p0", "p1", "p2"), 256).alias("digest"))


def _digest_parts(digest: Column) -> list[Column]:
    return [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(3)]


def _sum_parts(parts: list[Column]) -> list[Column]:
    return [F.sum(p).cast("string").alias(f"p{i}") for i, p in enumerate(parts)]


def range_check(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Per symbol: whether its bars cover a requested date range."""
    spans = bars.groupBy("symbol").agg(F.min("trading_date").alias("first_date"), F.max("trading_date").alias("last_date"))
    inside = (F.col("first_date") <= F.lit(start).cast("date")) & (F.col("last_date") >= F.lit(end).cast("date"))
    return spans.withColumn("covered", inside)


def request_check(requests: DataFrame, manifests: DataFrame) -> DataFrame:
    """Whether each request may use the snapshot it names; the first rule that it breaks is its outcome.

    ``requests``: ``request_id, snapshot_id, start, end, expected_manifest_hash, expected_ref_hash, as_of`` (NULL: not
    asked for); ``manifests``: ``snapshot_id, first_date, last_date, manifest_hash, ref_hash, available_from``, one row each.
    """
    joined = requests.join(manifests, "snapshot_id", "left")
    inside = (F.col("start") <= F.col("end")) & (F.col("start") >= F.col("first_date")) & (F.col("end") <= F.col("last_date"))

    def differs(wanted: str, found: str) -> Column:
        return F.col(wanted).isNotNull() & ~F.col(wanted).eqNullSafe(F.col(found))

    late = F.col("as_of").isNotNull() & ~F.coalesce(F.col("available_from") <= F.col("as_of"), F.lit(False))
    outcome = (
        F.when(F.col("first_date").isNull(), "SNAPSHOT_MISSING")
        .when(~F.coalesce(inside, F.lit(False)), "RANGE_OUTSIDE_SNAPSHOT")
        .when(differs("expected_manifest_hash", "manifest_hash"), "MANIFEST_HASH_MISMATCH")
        .when(differs("expected_ref_hash", "ref_hash"), "REF_HASH_MISMATCH")
        .when(late, "NOT_AVAILABLE_AT_CUTOFF")
        .otherwise("VALID")
    )
    return joined.select("request_id", "snapshot_id", outcome.alias("outcome"))


def scale_prices(bars: DataFrame, factor: float) -> DataFrame:
    return bars.withColumns({name: F.col(name) * factor for name in (*PRICES, "amount")})


def normal_draw(key: Column, name: str, seed: int) -> Column:
    """Standard normal number that depends on a row's key alone (Box-Muller on two halves of an MD5)."""
    digest = F.md5(F.concat_ws("|", key, F.lit(name), F.lit(seed)))
    one, two = (F.conv(F.substring(digest, at, 8), 16, 10).cast("double") for at in (1, 9))
    scale = float(1 << 32)
    return F.sqrt(-2 * F.log((one + 1) / scale)) * F.cos(2 * math.pi * two / scale)


def add_price_noise(bars: DataFrame, scale: float = 0.00075, seed: int = 42) -> DataFrame:
    """Multiplicative noise on the prices, the same wherever a row is processed; high and low keep enclosing the body."""
    key = F.concat_ws("|", F.col("symbol").cast("string"), F.col("trading_date").cast("string"))
    noise = {name: normal_draw(key, name, seed) * scale for name in PRICES}
    noisy = bars.withColumns({f"_n_{k}": v for k, v in noise.items()})
    noisy = noisy.withColumns({name: F.col(name) * (1 + F.col(f"_n_{name}")) for name in PRICES})
    noisy = noisy.withColumn("amount", F.col("amount") * (1 + F.col("_n_close"))).drop(*[f"_n_{k}" for k in PRICES])
    return noisy.withColumns(
        {"high": F.greatest("high", "open", "close"), "low": F.least("low", "open", "close")}
    )
