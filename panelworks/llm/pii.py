"""Personal data: high-recall span generators, boosted trees and calibrated thresholds, without Python in the tasks.

Certain generators give the base spans (email, ip, card, phone) by their patterns
and checks. Recall generators propose further, overlapping spans: disguised
addresses, numbers in any grouping and account numbers. A span is described
by its format (digits, groups, separators, checksum, ...) and its context (the words and characters
around it). All features are small integers, so a corpus collapses to counts per
feature combination, by partial aggregation over all documents; gradient-boosted
trees of depth two are fitted to those counts on the driver and become column expressions.

There are no labels for personal data. Base spans and their usual disguises
(no country code, other separators, a written-out "at") are the positive examples;
numbers that fail every check are the negative ones. Log-loss boosting on whole counts
keeps scores calibrated, and the threshold is the lowest score at which the
corpus-wide precision on the examples reaches ``PRECISION``. Selected spans that overlap a
base span, or a better selected span, are left out.

Defined results: NULL and empty texts have no spans; repeated rows give repeated results;
without examples of both kinds no span is added. Every pattern is written with possessive
parts, so that its work is linear in the text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.llm.common import kept, whole_text

BASE = ("email", "ip", "card", "phone")
ADDED = ("disguised_email", "number", "account")
KINDS = BASE + ADDED
LOCAL = "[A-Za-z0-9._%+-]"
#: Pattern and a cheap condition without which it cannot match.
GENERATORS = {
    # a match begins where a run of its characters begins, or where the last match ended
    "email": (rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", ""),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    "disguised_email": (
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:[\[({]\x20?(?:at|@)\x20?[\])}]|@)\x20?[A-Za-z0-9-]{1,63}+"
        r"(?:\x20?(?:[\[({]\x20?(?:dot|\.)\x20?[\])}]|\.)\x20?[A-Za-z0-9-]{1,63}+){1,5}+",
        "",
    ),
    "number": (r"(?<![0-9A-Za-z+])[+(]{0,2}+[0-9](?:[\x20().\-/]{0,2}+[0-9]){6,24}+(?![0-9A-Za-z])", ""),
    "account": (r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3}+)?(?![A-Za-z0-9])", ""),
}
NEEDS_DIGIT = ("ip", "card", "phone", "number", "account")
BEFORE, AFTER = 24, 8
PRECISION = 0.9
ROUNDS, RATE, LEAST_WEIGHT = 60, 0.3, 1.0
# Words that announce personal data.
ANNOUNCE = (
    ("phone|tel|call|fax|mobile|cell", 1),
    ("card|visa|mastercard|credit|debit", 2),
    (r"\bip\b|host|server|addr", 3),
    ("mail|contact|write", 4),
    ("iban|account|acct|konto|ssn|passport", 5),
)


def matches(text: Column, kind: str) -> Column:
    """Matches of a generator with the code points since the match before and the text around."""
    pattern, needed = GENERATORS[kind]
    possible = F.lit(True)
    if needed:
        possible &= F.contains(text, F.lit(needed))
    if kind in NEEDS_DIGIT:
        possible &= text.rlike("[0-9]")
    if kind == "disguised_email":
        possible &= text.rlike(r"(?i)[\[({]\x20?(?:at|@)\x20?[\])}]|\x20@|@\x20|[\[({]\x20?dot")
    flags = "(?i)" if kind == "disguised_email" else ""
    between = F.split(text, flags + pattern, -1)
    found = F.regexp_extract_all(text, F.lit(f"{flags}({pattern})"), F.lit(1))

    def described(parts: Column) -> Column:
        gaps = F.transform(parts, lambda p: F.struct(F.length(p).alias("gap"), F.substring(p, -BEFORE, BEFORE).alias("before")))
        after = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.substring(p, 1, AFTER))
        return F.filter(
            F.transform(
                F.arrays_zip(gaps.alias("gaps"), found.alias("found"), after.alias("after")),
                lambda z: F.struct(z["gaps"]["gap"].alias("gap"), z["gaps"]["before"].alias("before"), z["found"].alias("match"), z["after"].alias("after")),
            ),
            lambda z: z["match"].isNotNull(),
        )

    none = F.array().cast("array<struct<gap:int,before:string,match:string,after:string>>")
    return F.when(possible, F.element_at(F.transform(F.array(between), described), 1)).otherwise(none)


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id) of every document, and (row, kind, start, end, match, before, after) of every proposed span."""
    text = whole_text()
    rows = docs.select("doc_id", text).withColumn("row", F.monotonically_increasing_id())
    found = kept(rows.select("row", "doc_id", *[matches(F.col("text"), k).alias(k) for k in GENERATORS]))
    parts = [
        found.select("row", F.lit(k).alias("kind"), F.posexplode(k).alias("at", "m")).select("row", "kind", "at", "m.*")
        for k in GENERATORS
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    upto = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("match")).over(upto)
    placed = every.withColumn("end", end).withColumn("start", F.col("end") - F.length("match"))
    return found.select("row", "doc_id"), placed.drop("gap", "at")


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Does a string of digits pass the Luhn check?"""
    turned = F.split(F.reverse(number), "")
    doubled = F.transform(turned, lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2).otherwise(c.cast("int")))
    total = F.aggregate(doubled, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x))
    return total % 10 == 0


def small_parts(match: Column) -> Column:
    """Four dotted numbers of at most 255."""
    part = "0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return match.rlike(rf"^(?:{part}\.){{3}}{part}$")


def passes(kind: Column, match: Column) -> Column:
    """The checks of the base kinds."""
    number = digits(match)
    n = F.length(number)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", match.rlike("^[0-9.]+$") & _parts_at_most_255(match))
        .when(kind == "card", n.between(13, 19) & F.when(n.between(13, 19), luhn(number)).otherwise(F.lit(False)))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(False)
    )


def _parts_at_most_255(match: Column) -> Column:
    short = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(short, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))


def features(match: Column, before: Column, after: Column, kind: Column) -> dict[str, Column]:
    """Small integers that describe the format and the context of a span."""
    number = digits(match)
    n = F.length(number)
    groups = F.size(F.split(F.regexp_replace(match, "^[^0-9]+|[^0-9]+$", ""), "[^0-9]+"))
    told = F.lower(before)
    announced = F.lit(0)
    for words, value in reversed(ANNOUNCE):
        announced = F.when(told.rlike(f"(?:{words})[^a-z]*$"), value).otherwise(announced)
    separators = F.regexp_replace(match, "[0-9A-Za-z]", "")
    one_kind = F.length(F.regexp_replace(separators, r"^(.)\1*$", "$1")) <= 1
    return {
        "kind": F.array_position(F.array(*map(F.lit, ADDED)), kind).cast("int"),
        "digits": F.least(n, F.lit(20)),
        "groups": F.least(groups, F.lit(6)),
        "separator": F.when(F.length(separators) == 0, 0)
        .when(one_kind, 1 + F.coalesce(F.nullif(F.instr(F.lit(" -./"), F.substring(separators, 1, 1)), F.lit(0)), F.lit(5)))
        .otherwise(7),
        "bracket": match.rlike(r"[()]").cast("int"),
        "plus": match.startswith("+").cast("int"),
        "checksum": F.when(n.between(13, 19), luhn(number).cast("int")).otherwise(2),
        "quad": small_parts(match).cast("int"),
        "announced": announced,
        "money": (before.rlike(r"[$€£#]\x20?$") | after.rlike(r"^\x20?[%$€£]")).cast("int"),
        "varied": F.least(F.size(F.array_distinct(F.split(number, ""))), F.lit(6)),
    }


FEATURES = ("kind", "digits", "groups", "separator", "bracket", "plus", "checksum", "quad", "announced", "money", "varied")


def _disguises(good: DataFrame) -> DataFrame:
    """Base spans as the recall generators may meet them."""
    plain = good.where("kind <> 'email'").select(
        "before", "after", F.lit("number").alias("kind"), F.explode(
            F.array(
                "match",
                F.regexp_replace("match", r"^\+[0-9]{1,3}[\x20.-]?", ""),
                F.when(F.col("kind") != "ip", F.regexp_replace("match", r"[\x20().-]+", "-")),
                F.when(F.col("kind") != "ip", F.regexp_replace("match", r"[\x20().-]+", " ")),
            )
        ).alias("match"),
    )
    written = good.where("kind = 'email'").select(
        "before", "after", F.lit("disguised_email").alias("kind"),
        F.regexp_replace(F.regexp_replace("match", "@", " [at] "), r"\.", " [dot] ").alias("match"),
    )
    return plain.where(F.length(digits(F.col("match"))) >= 7).unionByName(written)


def examples(spans: DataFrame) -> DataFrame:
    """Counts of positive and negative examples for each combination of features."""
    good = spans.where(F.col("kind").isin(*BASE) & F.col("good"))
    ok = F.col("kind").isin(*ADDED) & ~F.col("covered") & (F.col("kind") == "number")
    bad = spans.where(ok).select("before", "after", "kind", "match", F.lit(0).alias("label"))
    every = _disguises(good).withColumn("label", F.lit(1)).unionByName(bad)
    described = every.select("label", *[c.alias(f) for f, c in _features().items()])
    return described.groupBy(*FEATURES).agg(
        F.sum("label").alias("positive"), F.sum(1 - F.col("label")).alias("negative")
    )


def _features() -> dict[str, Column]:
    return features(F.col("match"), F.col("before"), F.col("after"), F.col("kind"))



def boost(rows: list, rounds: int = ROUNDS) -> tuple[float, list]:
    """Gradient-boosted trees of depth two on weighted feature combinations.

    A tree is (feature, cut, left, right), each side (feature, cut, low value, high value):
    a row goes low where its feature is at most the cut.
    """
    if not rows:
        return 0.0, []
    positive = [float(r["positive"]) for r in rows]
    weight = [float(r["positive"] + r["negative"]) for r in rows]
    share = (sum(positive) + 0.5) / (sum(weight) + 1)
    base = math.log(share / (1 - share))
    score = [base] * len(rows)
    values = {f: [int(r[f]) for r in rows] for f in FEATURES}
    trees = []

    def best_cut(members: list[int], g: list[float], h: list[float]) -> tuple:
        total_g, total_h = sum(g[i] for i in members), sum(h[i] for i in members)
        leaf = total_g / (total_h + LEAST_WEIGHT)
        best = (0.0, FEATURES[0], -1, leaf, leaf)
        for f in FEATURES:
            by: dict[int, list[float]] = {}
            for i in members:
                at = by.setdefault(values[f][i], [0.0, 0.0])
                at[0] += g[i]
                at[1] += h[i]
            left_g = left_h = 0.0
            for cut in sorted(by)[:-1]:
                left_g += by[cut][0]
                left_h += by[cut][1]
                right_g, right_h = total_g - left_g, total_h - left_h
                gain = left_g**2 / (left_h + LEAST_WEIGHT) + right_g**2 / (right_h + LEAST_WEIGHT) - total_g**2 / (total_h + LEAST_WEIGHT)
                if gain > best[0] + 1e-9:
                    best = (gain, f, cut, left_g / (left_h + LEAST_WEIGHT), right_g / (right_h + LEAST_WEIGHT))
        return best

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        g = [y - w * q for y, w, q in zip(positive, weight, p)]
        h = [w * q * (1 - q) for w, q in zip(weight, p)]
        every = list(range(len(rows)))
        _, f, cut, _, _ = best_cut(every, g, h)
        sides = []
        for side in (True, False):
            members = [i for i in every if (values[f][i] <= cut) == side]
            _, f2, cut2, low, high = best_cut(members, g, h) if members else (0, f, cut, 0.0, 0.0)
            sides.append((f2, cut2, RATE * low, RATE * high))
            for i in members:
                score[i] += RATE * (low if values[f2][i] <= cut2 else high)
        trees.append((f, cut, *sides))
    return base, trees


def tree_score(base: float, trees: list) -> Column:
    """The log odds of a span as one expression over its features."""
    total = F.lit(base)
    for f, cut, left, right in trees:
        sides = [F.when(F.col(s[0]) <= s[1], F.lit(s[2])).otherwise(F.lit(s[3])) for s in (left, right)]
        total = total + F.when(F.col(f) <= cut, sides[0]).otherwise(sides[1])
    return total


def row_score(row, base: float, trees: list) -> float:
    pick = lambda side: side[2] if row[side[0]] <= side[1] else side[3]
    return base + sum(pick(left if row[f] <= cut else right) for f, cut, left, right in trees)


def threshold(rows: list, base: float, trees: list, precision: float = PRECISION) -> float:
    """The lowest score from which on the examples are positive with the wanted precision."""
    scored = sorted(((row_score(r, base, trees), r["positive"], r["negative"]) for r in rows), reverse=True)
    best, good, bad = math.inf, 0, 0
    for k, (s, positive, negative) in enumerate(scored):
        good, bad = good + positive, bad + negative
        last = k + 1 == len(scored) or scored[k + 1][0] < s
        if last and good >= precision * (good + bad):
            best = s
    return best


def marked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id), and every proposed span with ``good`` (a base span) and ``covered`` (overlaps one)."""
    rows, spans = candidates(docs)
    checked = spans.withColumn("good", passes(F.col("kind"), F.col("match")))
    checked = checked.where(F.col("good") | F.col("kind").isin(*ADDED))
    base = F.col("good")
    ordered = Window.partitionBy("row").orderBy("start", F.col("end").desc(), "kind")
    before, after = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(1, Window.unboundedFollowing)
    reach = F.coalesce(F.max(F.when(base, F.col("end"))).over(before), F.lit(-1))
    ahead = F.min(F.when(base, F.col("start"))).over(after)
    covered = (reach > F.col("start")) | F.coalesce(ahead < F.col("end"), F.lit(False))
    return rows, kept(checked.withColumn("covered", covered))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end), the base spans and all spans, for every row."""
    rows, spans = marked(docs)
    counts = examples(spans).collect()  # one row per combination of bounded features
    base, trees = boost(counts)
    cut = threshold(counts, base, trees)
    both = any(r["positive"] for r in counts) and any(r["negative"] for r in counts)
    scored = spans.where(F.col("kind").isin(*ADDED) & ~F.col("covered")).withColumn("name", F.col("kind"))
    scored = scored.withColumns(_features()).withColumn("score", tree_score(base, trees))
    chosen = scored.where((F.col("score") >= cut) if both and math.isfinite(cut) else F.lit(False))
    # of selected spans that overlap, the better one
    ordered = Window.partitionBy("row").orderBy("start", "end", "name")
    beaten = F.lit(False)
    for side in (F.lag, F.lead):
        other = {c: side(c).over(ordered) for c in ("start", "end", "score", "name")}
        meets = (other["start"] < F.col("end")) & (other["end"] > F.col("start"))
        better = (other["score"] > F.col("score")) | ((other["score"] == F.col("score")) & (other["name"] < F.col("name")))
        beaten = beaten | F.coalesce(meets & better, F.lit(False))
    added = chosen.withColumn("beaten", beaten).where("NOT beaten").select("row", F.col("name").alias("kind"), "start", "end")
    every = spans.where("good").select("row", "kind", "start", "end").unionByName(added)
    span = F.struct("kind", "start", "end")
    grouped = every.groupBy("row").agg(
        F.collect_list(F.when(F.col("kind").isin(*BASE), span)).alias("base"), F.collect_list(span).alias("spans")
    )
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return rows.join(grouped, "row", "left").select(
        "doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans")
    )


def _listed(spans: str) -> Column:
    """``kind:start:end`` by kind as listed and then start, joined by commas."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    keyed = F.transform(spans, lambda s: F.struct(rank(s).alias("rank"), s["start"], s["end"], s["kind"]))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans")
    )
