"""Point-in-time joins, content features, bar preparation and formula tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.functions import scalar
from panelworks.operators import asof, content, grid, prepare, seeds
from panelworks.operators import formulas as fm
from panelworks.plans import inputs
from panelworks.plans.formula_sql import formula_ctes
from panelworks.plans.inputs import with_bars
from panelworks.plans.registry import query, rounded
from panelworks.sources.bars import payload_rows

# --- bars with facts ---------------------------------------------------------------------------


@query(
    "asof_turnover",
    with_bars("SELECT symbol, trading_date, volume, turnover, turnover_observed FROM tbars"),
)
def asof_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = inputs.bars_with_turnover(spark, sf_dir)
    return bars.select("symbol", "trading_date", "volume", "turnover", "turnover_observed")


def prepared_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with turnover, a status join and state flags."""
    returned = inputs.table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    status = returned.groupBy(
        F.col("l_suppkey").alias("symbol"), F.date_trunc("week", "l_shipdate").cast("date").alias("trading_date")
    ).agg((F.count(F.lit(1)) >= 2).alias("is_st_history"))
    return prepare.with_state_flags(asof.attach_status(inputs.bars_with_turnover(spark, sf_dir), status))


PREPARED_SQL = """, status AS (SELECT l_suppkey AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS trading_date, count(*) >= 2 AS st
  FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
prep AS (SELECT b.*, CAST(CASE WHEN s.st THEN 1 ELSE 0 END AS DOUBLE) AS is_st, CAST(CASE WHEN volume <= 0 OR close IS NULL THEN 1 ELSE 0 END AS DOUBLE) AS is_suspended,
  CAST(row_number() OVER (PARTITION BY b.symbol ORDER BY b.trading_date) AS INTEGER) AS listing_days
  FROM tbars b LEFT JOIN status s ON s.symbol = b.symbol AND s.trading_date = b.trading_date)
"""


@query(
    "prepared_bars",
    with_bars(
        PREPARED_SQL
        + "SELECT symbol, trading_date, is_st, is_suspended, CAST(1.0 AS DOUBLE) AS price_observed, listing_days, turnover_observed FROM prep"
    ),
)
def prepared_bars_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared_bars(spark, sf_dir).select(
        "symbol", "trading_date", "is_st", "is_suspended", "price_observed", "listing_days", "turnover_observed"
    )


@query(
    "quality_violations",
    with_bars(
        """, q AS (SELECT symbol, trading_date, open * 1.5 AS open, high, low, close, volume - 5 AS volume FROM bars)
SELECT symbol, trading_date, list_filter([CASE WHEN high < greatest(open, close) THEN 'high_below_body' END,
 CASE WHEN low > least(open, close) THEN 'low_above_body' END, CASE WHEN high < low THEN 'high_below_low' END,
 CASE WHEN volume < 0 THEN 'volume_negative' END], lambda x: x IS NOT NULL) AS violations
FROM q WHERE high < greatest(open, close) OR low > least(open, close) OR high < low OR volume < 0"""
    ),
)
def quality_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules on bars that were damaged on purpose."""
    damaged = inputs.bars_with_turnover(spark, sf_dir).withColumns(
        {"open": F.col("open") * 1.5, "volume": F.col("volume") - 5, "is_suspended": F.lit(0.0)}
    )
    return prepare.quality_violations(damaged).select("symbol", "trading_date", "violations")


@query(
    "snapshot_report",
    with_bars(
        """, twice AS (SELECT * FROM tbars UNION ALL SELECT * FROM tbars WHERE symbol = 1)
SELECT CAST(count(*) AS BIGINT) AS row_count, min(trading_date) AS min_date, max(trading_date) AS max_date,
 (SELECT count(*) FROM tbars WHERE symbol = 1) AS bad_duplicate_keys, 0::BIGINT AS bad_open, 0::BIGINT AS bad_high, 0::BIGINT AS bad_low, 0::BIGINT AS bad_close,
 0::BIGINT AS bad_volume, 0::BIGINT AS bad_amount, 0::BIGINT AS bad_turnover FROM twice"""
    ),
)
def snapshot_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = inputs.bars_with_turnover(spark, sf_dir)
    return prepare.snapshot_report(bars.unionByName(bars.where(F.col("symbol") == 1)))


@query(
    "market_payload",
    with_bars(
        "SELECT CAST(symbol AS VARCHAR) AS symbol, trading_date, open, high, low, close, volume, round(amount, 2) AS amount FROM bars"
    ),
)
def market_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars packed into one nested JSON document per symbol and read back."""
    names = ("open", "high", "low", "close", "volume", "amount")
    cells = F.sort_array(F.collect_list(F.struct(F.col("trading_date").cast("string").alias("t"), *names)))
    packed = inputs.bars(spark, sf_dir).groupBy("symbol").agg(cells.alias("cells"))  # one calendar per symbol
    # a field of an array of structs is an array; the matrix has one row, this symbol
    matrix = [F.array(F.col(f"cells.{n}")).alias(n) for n in names]
    body = F.to_json(
        F.struct(
            F.array(F.col("symbol").cast("string")).alias("symbols"),
            F.col("cells.t").alias("dates"),
            F.struct(*matrix).alias("bars"),
        )
    )
    rows = payload_rows(packed.select(body.alias("body"))).drop("turnover")
    return rows.withColumn("amount", F.round("amount", 2))


@query("snapshot_digest")
def snapshot_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.content_digest(inputs.bars(spark, sf_dir))


@query(
    "snapshot_range_check",
    with_bars(
        "SELECT symbol, min(trading_date) AS first_date, max(trading_date) AS last_date,"
        " min(trading_date) <= DATE '1995-02-01' AND max(trading_date) >= DATE '2001-10-15' AS covered FROM bars GROUP BY symbol"
    ),
)
def snapshot_range_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.range_check(inputs.bars(spark, sf_dir), "1995-02-01", "2001-10-15")


@query(
    "price_scale",
    with_bars("SELECT symbol, trading_date, open * 10 AS open, high * 10 AS high, low * 10 AS low, close * 10 AS close, volume FROM bars"),
)
def price_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = prepare.scale_prices(inputs.bars(spark, sf_dir), 10.0)
    return scaled.select("symbol", "trading_date", "open", "high", "low", "close", "volume")


def _noised(name: str) -> str:
    key = f"md5(concat_ws('|', CAST(symbol AS VARCHAR), CAST(trading_date AS VARCHAR), '{name}', '42'))"
    one, two = (f"CAST(CAST('0x' || substr({key}, {at}, 8) AS UBIGINT) AS DOUBLE)" for at in (1, 9))
    draw = f"sqrt(-2 * ln(({one} + 1) / 4294967296)) * cos(2 * pi() * {two} / 4294967296)"
    return f"1 + 0.00075 * ({draw})"


@query(
    "price_noise",
    with_bars(
        "SELECT symbol, trading_date, round(o, 6) AS open, round(greatest(h, o, c), 6) AS high, round(least(l, o, c), 6) AS low, round(c, 6) AS close, round(a, 4) AS amount FROM (SELECT symbol, trading_date, "
        + ", ".join(f"{n} * ({_noised(n)}) AS {n[0]}" for n in ("open", "high", "low", "close"))
        + f", amount * ({_noised('close')}) AS a FROM bars)"
    ),
)
def price_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = prepare.add_price_noise(inputs.bars(spark, sf_dir))
    return rounded(noisy.select("symbol", "trading_date", "open", "high", "low", "close", "amount"), 6, amount=4)


@query(
    "symbol_normalization",
    """WITH raw AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN lpad(CAST(o_custkey AS VARCHAR), 6, '6') || '.sh' WHEN 1 THEN ' ' || CAST(o_custkey AS VARCHAR) || '.hk'
   WHEN 2 THEN 'us.' || lower(o_orderpriority) WHEN 3 THEN 'A' || CAST(o_custkey AS VARCHAR) WHEN 4 THEN '#' || CAST(o_custkey AS VARCHAR) ELSE 'cn.a.' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') END AS v FROM orders),
u AS (SELECT o_orderkey, v, upper(trim(v)) AS r FROM raw),
n AS (SELECT o_orderkey, CASE WHEN regexp_full_match(r, '(CN\\.A\\.)?[0-9]{6}(\\.(SH|SZ|BJ))?') THEN 'CN.A.' || regexp_extract(r, '([0-9]{6})', 1)
  WHEN regexp_full_match(r, '(HK\\.)?[0-9]{1,5}(\\.HK)?') THEN 'HK.' || lpad(regexp_extract(r, '([0-9]{1,5})', 1), 5, '0')
  WHEN starts_with(r, 'US.') THEN r WHEN regexp_full_match(r, '[A-Z][A-Z0-9.\\-]{0,15}') THEN 'US.' || r END AS symbol FROM u)
SELECT o_orderkey, symbol, split_part(symbol, '.', 1) AS exchange, split_part(symbol, '.', -1) AS local_code FROM n""",
)
def symbol_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = F.col("o_custkey").cast("string")
    kind = F.col("o_orderkey") % 6
    raw = (
        F.when(kind == 0, F.concat(F.lpad(customer, 6, "6"), F.lit(".sh")))
        .when(kind == 1, F.concat(F.lit(" "), customer, F.lit(".hk")))
        .when(kind == 2, F.concat(F.lit("us."), F.lower("o_orderpriority")))
        .when(kind == 3, F.concat(F.lit("A"), customer))
        .when(kind == 4, F.concat(F.lit("#"), customer))
        .otherwise(F.concat(F.lit("cn.a."), F.lpad(customer, 6, "0")))
    )
    orders = inputs.table(spark, sf_dir, "orders").withColumn("raw", raw)
    return orders.select(
        "o_orderkey",
        scalar.normalize_symbol(F.col("raw")).alias("symbol"),
        scalar.symbol_exchange(F.col("raw")).alias("exchange"),
        scalar.symbol_local_code(F.col("raw")).alias("local_code"),
    )


@query(
    "compact_dates",
    """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' WHEN o_orderkey % 5 = 0 THEN '19971340' ELSE strftime(o_orderdate, '%Y%m%d') || CASE WHEN o_orderkey % 2 = 0 THEN '.0' ELSE '' END END AS v FROM orders)
SELECT o_orderkey, CAST(try_strptime(lpad(regexp_replace(v, '\\.0$', ''), 8, '0'), '%Y%m%d') AS DATE) AS parsed FROM t""",
)
def compact_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.when(F.col("o_orderkey") % 2 == 0, ".0").otherwise(""))
    value = F.when(F.col("o_orderkey") % 7 == 0, "n/a").when(F.col("o_orderkey") % 5 == 0, "19971340").otherwise(text)
    return inputs.table(spark, sf_dir, "orders").select("o_orderkey", scalar.compact_date(value).alias("parsed"))


@query(
    "known_versions",
    """SELECT doc_id, NOT upper(trim(v)) IN ('', 'UNKNOWN', 'NONE', 'NULL', 'N/A', 'NA') AS known FROM
 (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' na ' WHEN 1 THEN 'unknown' WHEN 2 THEN '' ELSE source END AS v FROM documents)""",
)
def known_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % 4
    value = F.when(kind == 0, " na ").when(kind == 1, "unknown").when(kind == 2, "").otherwise(F.col("source"))
    return inputs.table(spark, sf_dir, "documents").select("doc_id", scalar.is_known_version(value).alias("known"))


# --- signals -------------------------------------------------------------------------------------


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    event, kind = F.col("event_id"), F.col("event_type")
    return inputs.table(spark, sf_dir, "events").select(
        event.cast("string").alias("signal_id"),
        F.col("user_id").cast("string").alias("symbol"),
        F.concat(F.lit("HK."), (F.col("user_id") % 40).cast("string")).alias("subject_key"),
        F.col("event_type").alias("subject"),
        F.col("ts").cast("timestamp_ntz").alias("available_from"),
        F.when(kind.isin("purchase", "signup"), "BULLISH").when(kind == "error", "BEARISH").otherwise("NEUTRAL").alias("sentiment"),
        F.when(kind == "error", "RISK_CONDITION").otherwise("FACT").alias("knowledge_kind"),
        F.when(event % 3 == 0, "EXTERNALLY_VERIFIED").otherwise("CLAIMED").alias("truth_status"),
        F.get_json_object("props", "$.k").alias("source_video_id"),
        F.when(event % 5 == 0, F.col("value")).alias("content_attention_score"),
        F.when(event % 17 == 0, "REJECTED").alias("review_status"),
    )


def signal_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = inputs.table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("trading_date"))
    return grid.calendar(events)


def signal_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = inputs.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("u")).distinct()
    return users.select(scalar.normalize_symbol(F.col("u")).alias("symbol"))


def signal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = content.subject_symbols(signals(spark, sf_dir), signal_universe(spark, sf_dir))
    # a signal names its own symbol and at most one other
    return content.visible_features(named, signal_calendar(spark, sf_dir), 2 * inputs.event_rows(sf_dir))


SIGNALS_SQL = """WITH cal AS (SELECT trading_date, CAST(row_number() OVER (ORDER BY trading_date) - 1 AS INTEGER) AS d FROM (SELECT DISTINCT CAST(ts AS DATE) AS trading_date FROM events)),
sig AS (SELECT event_id, event_type, value, ts + INTERVAL 8 HOUR AS loc, 'HK.' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS s1, 'HK.' || lpad(CAST(user_id % 40 AS VARCHAR), 5, '0') AS s2,
  'HK.' || CAST(user_id % 40 AS VARCHAR) AS subject, props->>'$.k' AS video FROM events WHERE event_id % 17 <> 0),
uni AS (SELECT DISTINCT 'HK.' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS symbol FROM events),
named AS (SELECT s1 AS symbol, * FROM sig UNION ALL SELECT s2, * FROM sig WHERE s2 <> s1),
vis AS (SELECT n.*, cal.d FROM named n SEMI JOIN uni USING (symbol), cal
  WHERE n.loc <= cal.trading_date + INTERVAL '9 hours 25 minutes' AND date_diff('day', CAST(n.loc AS DATE), cal.trading_date) BETWEEN 0 AND 5),
tag AS (SELECT *, event_type IN ('purchase', 'signup') AS bull, event_type = 'error' AS bear, event_id % 3 = 0 AS ver, CASE WHEN event_id % 5 = 0 THEN value END AS att FROM vis),
tot AS (SELECT symbol, d, count(DISTINCT video) AS heat, count(*) FILTER (WHERE bull) AS nb, count(*) FILTER (WHERE bear) AS nr,
  count(*) FILTER (WHERE ver AND bull) AS cat, count(*) FILTER (WHERE ver AND bear) AS risk, coalesce(avg(att), count(*) / CAST(greatest(count(DISTINCT video), 1) AS DOUBLE)) AS att FROM tag GROUP BY 1, 2),
th AS (SELECT symbol, d, sum(CASE WHEN NOT r THEN 1 WHEN NOT b THEN -1 ELSE 0 END) AS theme FROM
  (SELECT symbol, d, video, bool_or(bull) AS b, bool_or(bear) AS r FROM tag WHERE bull OR bear GROUP BY 1, 2, 3) GROUP BY 1, 2),
su AS (SELECT symbol, d, sum(CASE WHEN NOT r THEN 1 WHEN NOT b THEN -1 ELSE 0 END) AS con, count(*) FILTER (WHERE r AND b) AS dis FROM
  (SELECT symbol, d, subject, count(DISTINCT video) AS v, bool_or(bull) AS b, bool_or(bear) AS r FROM tag WHERE bull OR bear GROUP BY 1, 2, 3) WHERE v >= 2 GROUP BY 1, 2),
feat AS (SELECT tot.symbol, tot.d, CAST(heat AS DOUBLE) AS event_heat, CAST(coalesce(theme, 0) AS DOUBLE) AS theme_sentiment, CAST(nb AS DOUBLE) AS video_bullish_claim_count,
  CAST(nr AS DOUBLE) AS video_bearish_claim_count, CAST(cat AS DOUBLE) AS verified_catalyst_count, CAST(risk AS DOUBLE) AS verified_risk_count,
  att AS content_attention_score, att AS author_attention_score, CAST(coalesce(con, 0) AS DOUBLE) AS cross_video_consensus, CAST(coalesce(dis, 0) AS DOUBLE) AS cross_video_disagreement
  FROM tot LEFT JOIN th USING (symbol, d) LEFT JOIN su USING (symbol, d))
"""


@query("signal_visibility", SIGNALS_SQL + "SELECT CAST(event_id AS VARCHAR) AS signal_id, symbol, d FROM vis")
def signal_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = content.subject_symbols(signals(spark, sf_dir), signal_universe(spark, sf_dir))
    return content.visible_cells(named, signal_calendar(spark, sf_dir)).select("signal_id", "symbol", "d")


@query(
    "content_features",
    SIGNALS_SQL
    + "SELECT * REPLACE (round(content_attention_score, 6) AS content_attention_score, round(author_attention_score, 6) AS author_attention_score) FROM feat",
)
def content_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signal_features(spark, sf_dir))


_CONTENT_SEEDS = {k: v for k, v in seeds.seed_formulas().items() if k.startswith("content_")}


@query(
    "content_factors",
    SIGNALS_SQL
    + """, panel AS (SELECT u.symbol, cal.d, coalesce(f.theme_sentiment, 0.0) AS theme_sentiment, coalesce(f.content_attention_score, 0.0) AS content_attention_score,
  coalesce(f.cross_video_consensus, 0.0) AS cross_video_consensus FROM (SELECT DISTINCT symbol FROM feat) u CROSS JOIN cal LEFT JOIN feat f ON f.symbol = u.symbol AND f.d = cal.d)
"""
    + formula_ctes(_CONTENT_SEEDS, columns=content.CONTENT_FEATURES, keep="")
    + "SELECT factor_id, d, count(*) AS n, round(avg(raw), 5) + 0.0 AS raw_mean FROM fv GROUP BY 1, 2",
)
def content_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = signal_calendar(spark, sf_dir)
    features = signal_features(spark, sf_dir).join(F.broadcast(days.select("d", "trading_date")), "d").drop("d")
    dense = grid.dense_panel(features, days, extra=content.CONTENT_FEATURES)
    panel = dense.withColumns({name: F.coalesce(name, F.lit(0.0)) for name in content.CONTENT_FEATURES})
    values = fm.factor_values(panel, _CONTENT_SEEDS, group_rows=inputs.users(sf_dir))
    return rounded(
        values.groupBy("factor_id", "d").agg(F.count(F.lit(1)).alias("n"), F.avg("sort_value").alias("raw_mean")), 5
    )


_CLOCK = datetime(2024, 1, 20)
_QUERY = content.SignalQuery(_CLOCK, _CLOCK, datetime(2024, 1, 22), "c1", min_support=2)


@query(
    "signal_eligibility",
    """WITH s AS (SELECT event_id, ts, CASE event_id % 4 WHEN 0 THEN 'PROXY' WHEN 1 THEN 'UNKNOWN' ELSE 'VERIFIED' END AS q, event_id % 3 = 0 AS ver,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 5 END AS sup, CASE WHEN event_id % 13 = 0 THEN 'c2' ELSE 'c1' END AS pc FROM events),
r AS (SELECT event_id, list_filter([
 CASE WHEN ts > TIMESTAMP '2024-01-22' THEN 'source_available_after_availability_cutoff' END,
 CASE WHEN ts + INTERVAL 1 HOUR > TIMESTAMP '2024-01-22' THEN 'available_from_after_availability_cutoff' END,
 CASE WHEN ts > TIMESTAMP '2024-01-20' THEN 'knowledge_projection_after_knowledge_cutoff' END,
 CASE WHEN ts > TIMESTAMP '2024-01-20' THEN 'lifecycle_after_knowledge_cutoff' END,
 CASE WHEN ts - INTERVAL 1 DAY > TIMESTAMP '2024-01-20' THEN 'business_temporal_binding_after_business_cutoff' END,
 CASE WHEN q = 'UNKNOWN' THEN 'unknown_source_availability' END, CASE WHEN q = 'PROXY' THEN 'proxy_source_not_allowed' END,
 CASE WHEN NOT ver THEN 'unknown_truth_status' END, CASE WHEN sup IS NULL OR sup < 2 THEN 'insufficient_or_unknown_support' END,
 CASE WHEN pc <> 'c1' THEN 'producer_commit_mismatch' END], lambda x: x IS NOT NULL) AS reasons FROM s)
SELECT CAST(event_id AS VARCHAR) AS signal_id, reasons, len(reasons) = 0 AS eligible FROM r""",
)
def signal_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    event, ts = F.col("event_id"), F.col("ts")
    shaped = inputs.table(spark, sf_dir, "events").select(
        event.cast("string").alias("signal_id"),
        ts.alias("source_available_at"),
        (ts + F.expr("INTERVAL 1 HOUR")).alias("available_from"),
        ts.alias("knowledge_projection_at"),
        ts.alias("lifecycle_as_of"),
        (ts - F.expr("INTERVAL 1 DAY")).alias("occurrence_at"),
        (ts - F.expr("INTERVAL 1 DAY")).alias("business_as_of"),
        F.when(event % 4 == 0, "PROXY").when(event % 4 == 1, "UNKNOWN").otherwise("VERIFIED").alias("source_availability_quality"),
        F.when(event % 3 == 0, "externally_verified").otherwise("CLAIMED").alias("truth_status"),
        F.when(event % 11 != 0, event % 5).alias("support_count"),
        F.when(event % 13 == 0, "c2").otherwise("c1").alias("producer_commit"),
    )
    return content.with_rejections(shaped, _QUERY).select("signal_id", "reasons", "eligible")


# --- formula tables --------------------------------------------------------------------------------


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates derived from the parts table: a field, a window and a shape per part."""
    part = inputs.table(spark, sf_dir, "part")
    field = F.element_at(F.array(*[F.lit(x) for x in ("close", "volume", "ret", "vwap", "price")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    window = F.element_at(F.array(*[F.lit(x) for x in (3, 5, 10, 20, 7)]), (F.col("p_size") % 5 + 1).cast("int")).cast("string")
    op = F.element_at(F.array(*[F.lit(x) for x in ("ts_mean_", "ts_std_", "ts_delay_", "ts_sum_")]), (F.col("p_size") % 4 + 1).cast("int"))
    tokens = F.array(field, F.concat(op, window), F.lit("neg"), F.lit("cs_rank"))
    pair = F.array(field, field, F.concat(op, window), F.lit("div"), F.lit("cs_rank"))
    rpn = F.when(F.col("p_partkey") % 3 == 0, pair).when(F.col("p_partkey") % 11 == 0, F.array(field, F.lit("div"))).otherwise(tokens)
    return part.select(
        F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"), F.col("p_type").alias("hypothesis"), rpn.alias("rpn")
    )


CANDIDATES_SQL = """WITH c AS (SELECT p_partkey AS seq, p_name AS name, ['close', 'volume', 'ret', 'vwap', 'price'][p_partkey % 5 + 1] AS f,
  ['ts_mean_', 'ts_std_', 'ts_delay_', 'ts_sum_'][p_size % 4 + 1] || CAST([3, 5, 10, 20, 7][p_size % 5 + 1] AS VARCHAR) AS op, [3, 5, 10, 20, 7][p_size % 5 + 1] AS w, p_size % 4 AS o FROM part),
cand AS (SELECT *, CASE WHEN seq % 3 = 0 THEN [f, f, op, 'div', 'cs_rank'] WHEN seq % 11 = 0 THEN [f, 'div'] ELSE [f, op, 'neg', 'cs_rank'] END AS rpn, f <> 'price' AND (w <> 7 OR (seq % 3 <> 0 AND seq % 11 = 0)) AS valid FROM c)
"""


@query(
    "formula_checks",
    CANDIDATES_SQL
    + """SELECT seq, valid, FALSE AS looks_ahead, CAST(CASE WHEN NOT valid OR (seq % 3 <> 0 AND seq % 11 = 0) THEN -1 WHEN o = 2 THEN 1 + w ELSE w END AS INTEGER) AS lookback,
 sha256(array_to_string(rpn, ' ')) AS candidate_hash FROM cand""",
)
def formula_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rpn = F.col("rpn")
    return candidates(spark, sf_dir).select(
        "seq",
        fm.is_valid(rpn).alias("valid"),
        fm.looks_ahead(rpn).alias("looks_ahead"),
        fm.lookback_depth(rpn).alias("lookback"),
        fm.candidate_hash(rpn).alias("candidate_hash"),
    )


@query(
    "canonical_candidates",
    CANDIDATES_SQL
    + """SELECT min(seq) AS seq, sha256(array_to_string(rpn, ' ')) AS candidate_hash FROM cand WHERE valid GROUP BY rpn ORDER BY 1 LIMIT 30""",
)
def canonical_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm.canonical_candidates(candidates(spark, sf_dir), 30).select("seq", "candidate_hash")


@query(
    "mutated_candidates",
    CANDIDATES_SQL
    + """, m AS (SELECT seq, name, CASE WHEN seq % 3 <> 0 AND seq % 11 = 0 THEN NULL
   WHEN op = 'ts_mean_5' THEN list_transform(rpn, lambda t: CASE WHEN t = 'ts_mean_5' THEN 'ts_mean_10' ELSE t END)
   WHEN op = 'ts_mean_10' THEN list_transform(rpn, lambda t: CASE WHEN t = 'ts_mean_10' THEN 'ts_mean_20' ELSE t END)
   WHEN op = 'ts_delay_3' THEN list_transform(rpn, lambda t: CASE WHEN t = 'ts_delay_3' THEN 'ts_delay_5' ELSE t END)
   ELSE list_concat(rpn[1:len(rpn) - 1], ['neg', 'cs_rank']) END AS rpn FROM cand)
SELECT seq, name || '_r2' AS name, array_to_string(rpn, ' ') AS formula FROM m WHERE rpn IS NOT NULL""",
)
def mutated_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fm.mutated_candidates(candidates(spark, sf_dir), "LOW_FITNESS", 2)
    return made.select("seq", "name", F.array_join("rpn", " ").alias("formula"))


@query(
    "round_feedback",
    CANDIDATES_SQL
    + """SELECT round(max(fitness), 6) AS quality, CASE WHEN max(fitness) <= 0 THEN 'LOW_FITNESS' ELSE 'IMPROVING' END AS reason, count(DISTINCT h) <> count(*) AS duplicates
FROM (SELECT array_to_string(rpn, ' ') AS h, coalesce((p_retailprice - 1500) / 1000, 0) AS fitness FROM cand JOIN part ON p_partkey = seq)""",
)
def round_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = inputs.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("seq"), ((F.col("p_retailprice") - 1500) / 1000).alias("fitness")
    )
    rated = candidates(spark, sf_dir).join(price, "seq").withColumn("candidate_hash", fm.candidate_hash(F.col("rpn")))
    return rounded(fm.round_feedback(rated))


@query(
    "snapshot_request_check",
    """WITH m AS (SELECT o_custkey AS s, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b, md5(CAST(o_custkey AS VARCHAR)) AS mh, md5('r' || CAST(o_custkey AS VARCHAR)) AS rh, max(CAST(o_orderdate AS DATE)) + INTERVAL 30 DAY AS av FROM orders WHERE o_custkey % 10 <> 0 GROUP BY 1),
r AS (SELECT o_orderkey AS k, o_custkey AS s, CAST(o_orderdate AS DATE) - CAST(CASE WHEN o_orderkey % 4 = 0 THEN 900 ELSE 0 END AS INTEGER) AS x, CAST(o_orderdate AS DATE) AS y, CASE WHEN o_orderkey % 3 <> 0 THEN md5(CAST(o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS VARCHAR)) END AS mw,
  CASE WHEN o_orderkey % 2 = 0 THEN md5('r' || CAST(o_custkey + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS VARCHAR)) END AS rw, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) + INTERVAL 400 DAY END AS cutoff FROM orders)
SELECT k AS request_id, s AS snapshot_id, CASE WHEN a IS NULL THEN 'SNAPSHOT_MISSING' WHEN x > y OR x < a OR y > b THEN 'RANGE_OUTSIDE_SNAPSHOT' WHEN mw IS NOT NULL AND mw <> mh THEN 'MANIFEST_HASH_MISMATCH'
 WHEN rw IS NOT NULL AND rw <> rh THEN 'REF_HASH_MISMATCH' WHEN cutoff IS NOT NULL AND av > cutoff THEN 'NOT_AVAILABLE_AT_CUTOFF' ELSE 'VALID' END AS outcome FROM r LEFT JOIN m USING (s)""",
)
def snapshot_request_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = inputs.table(spark, sf_dir, "orders")
    k, snapshot, day = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate").cast("date")

    def digest(lead: str, key: Column) -> Column:
        return F.md5(F.concat(F.lit(lead), key.cast("string")))

    manifests = orders.where(snapshot % 10 != 0).groupBy(snapshot.alias("snapshot_id")).agg(
        F.min(day).alias("first_date"), F.max(day).alias("last_date"), F.date_add(F.max(day), 30).alias("available_from")
    )
    manifests = manifests.withColumns({"manifest_hash": digest("", F.col("snapshot_id")), "ref_hash": digest("r", F.col("snapshot_id"))})
    other = {n: snapshot + F.when(k % n == 0, 1).otherwise(0) for n in (7, 11)}
    requests = orders.select(
        k.alias("request_id"),
        snapshot.alias("snapshot_id"),
        F.date_sub(day, F.when(k % 4 == 0, 900).otherwise(0)).alias("start"),
        day.alias("end"),
        F.when(k % 3 != 0, digest("", other[7])).alias("expected_manifest_hash"),
        F.when(k % 2 == 0, digest("r", other[11])).alias("expected_ref_hash"),
        F.when(k % 5 != 0, F.date_add(day, 400)).alias("as_of"),
    )
    return prepare.request_check(requests, manifests)
