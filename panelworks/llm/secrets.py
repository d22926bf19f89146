"""Secret scans: certain patterns, and weak candidates only where complementary parts stand together.

A map over whole texts finds the certain spans (``assign``, ``access``, ``hex``)
and weak parts with a role: identifiers, secrets and endpoints. Parts are then
linked per document and scope (a paragraph: lines without an empty line between
them): each part meets the nearest part of every other role before and after it,
as an interval join with at most ``REACH`` code points between the two. A weak
secret is reported if an identifier or an endpoint is in reach, a weak
identifier or an endpoint if a secret is. Certain spans take part as
complementary parts. The nearest part decides whether any is in reach, so the
join needs no pairs and is linear in the parts.

Defined results: NULL and empty texts have no spans; repeated rows give repeated
results; a weak part that overlaps a certain span is not reported again.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.llm.common import batches, kept, whole_text

# The certain kinds, in output order, and their patterns.
CERTAIN = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(?ia:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

LINKED = ("linked_secret", "linked_id", "linked_endpoint")
KINDS = CERTAIN + LINKED
REACH = 400
ROLE_OF = {"assign": "secret", "hex": "secret", "access": "id"}
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
WEAK_ID = re.compile(
    r"(?<![A-Za-z0-9-])(?:[A-Z0-9]{16,32}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})(?![A-Za-z0-9-])"
)
ENDPOINT = re.compile(
    r"(?:https?|wss?|ftp|jdbc:\w+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\s\"'<>]+"
    r"|(?<![\w.-])[a-z0-9-]+(?:\.[a-z0-9-]+)+:[0-9]{2,5}(?![0-9])"
)
EMPTY_LINE = re.compile(r"\n[ \t\r]*\n")


def certain_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that pass, by start and then kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], CERTAIN.index(s[0]), s[2]))


def _random_looking(value: str) -> bool:
    """Mixed characters and a high entropy: words and repeated characters fail."""
    if not (re.search("[0-9]", value) and re.search("[a-z]", value) and re.search("[A-Z]", value)):
        return False
    counts = Counter(value)
    return -sum(c / len(value) * math.log2(c / len(value)) for c in counts.values()) >= 3.5


def weak_parts(text: str, certain: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(role, start, end) of weak parts that overlap no certain span."""
    found = [("secret", *m.span()) for m in WEAK_SECRET.finditer(text) if _random_looking(m.group())]
    for m in WEAK_ID.finditer(text):
        if re.search("[0-9]", m.group()) and re.search("[A-Za-z]", m.group()):
            found.append(("id", *m.span()))
    found += [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    if not found or not certain:
        return found
    # certain spans by start, and how far any of the first ones reaches
    starts, reach = [s for _, s, _ in certain], []
    for _, _, end in certain:
        reach.append(max(end, reach[-1] if reach else 0))
    free = lambda s, e: (k := bisect_right(starts, e - 1)) == 0 or reach[k - 1] <= s
    return [p for p in found if free(p[1], p[2])]


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
PART = pa.struct(
    [("role", pa.string()), ("weak", pa.bool_()), ("scope", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]
)


def _scan(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows):
        keys, spans, parts = [], [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            certain = certain_spans(text)
            weak = weak_parts(text, certain)
            own = []
            if weak:
                gaps = [m.start() for m in EMPTY_LINE.finditer(text)]
                own = [(r, True, bisect_right(gaps, s), s, e) for r, s, e in weak]
                own += [(ROLE_OF[k], False, bisect_right(gaps, s), s, e) for k, s, e in certain]
            keys.append(hashlib.sha1(f"{doc_id}\n{text}".encode()).hexdigest() if own else None)
            spans.append([dict(zip(("kind", "start", "end"), s)) for s in certain])
            parts.append([dict(zip(("role", "weak", "scope", "start", "end"), p)) for p in own])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(keys, type=pa.string()),
                pa.array(spans, type=pa.list_(SPAN)),
                pa.array(parts, type=pa.list_(PART)),
            ],
            names=["doc_id", "text_key", "certain", "parts"],
        )


def linked_parts(found: DataFrame) -> DataFrame:
    """(text_key, linked spans): weak parts with a complementary part in reach of their scope."""
    part = F.explode("parts").alias("p")
    parts = (
        found.where(F.col("text_key").isNotNull())
        .dropDuplicates(["text_key"])
        .select("text_key", part)
        .select("text_key", "p.*")
    )
    # many parts of one text are dealt by scope; a text is already the unit of the scan
    ordered = Window.partitionBy("text_key", "scope").orderBy("start", "end", "role")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    after = ordered.rowsBetween(1, Window.unboundedFollowing)
    near = {}
    for role in ("secret", "id", "endpoint"):
        ends = F.max(F.when(F.col("role") == role, F.col("end"))).over(before)
        starts = F.min(F.when(F.col("role") == role, F.col("start"))).over(after)
        near[role] = (F.coalesce(F.col("start") - ends, F.lit(REACH + 1)) <= REACH) | (
            F.coalesce(starts - F.col("end"), F.lit(REACH + 1)) <= REACH
        )
    joined = parts.withColumns({f"near_{r}": c for r, c in near.items()}).where("weak")
    partner = F.when(F.col("role") == "secret", F.col("near_id") | F.col("near_endpoint")).otherwise(
        F.col("near_secret")
    )
    kind = F.concat(F.lit("linked_"), "role").alias("kind")
    return (
        joined.where(partner)
        .groupBy("text_key")
        .agg(F.collect_set(F.struct(kind, "start", "end")).alias("linked"))
    )


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, certain, spans): certain spans, and all spans with the linked ones, of every row."""
    found = kept(docs.select("doc_id", whole_text()).mapInArrow(_scan, _SCHEMA.format(_id_type(docs))))
    every = found.drop("parts").join(linked_parts(found), "text_key", "left")
    spans = F.concat("certain", F.coalesce("linked", F.array().cast(_SPANS)))
    return every.select("doc_id", "certain", spans.alias("spans"))


_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_SCHEMA = (
    "doc_id {}, text_key string, certain " + _SPANS + ", "
    "parts array<struct<role:string,weak:boolean,scope:bigint,start:bigint,end:bigint>>"
)


def _id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def in_order(spans: str, kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` by start and then kind, joined by commas."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, kinds)), s["kind"])
    keyed = F.transform(spans, lambda s: F.struct(s["start"], rank(s).alias("rank"), s["end"], s["kind"]))
    text = F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(text, ",")


def digests(scanned: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("certain", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in CERTAIN],
        F.sha2(in_order("certain", CERTAIN), 256).alias("base_sha256"),
        in_order("spans", KINDS).alias("spans"),
    )
