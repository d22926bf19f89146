"""Structure repair of conversations: the cheapest edits to well-formed turn sequences, by run-length dynamic programming.

A row's symbol is its role initial (s, u, a or another) and whether it must go or is truncated. The roles of a repaired
conversation read ``(s?(ua)+)?``; an automaton of four states accepts them. Keeping costs 0, a new role 1, deleting 2,
an inserted empty turn 5, and 5 more for a truncated row that stays. So each symbol is a 4 x 4 min-plus matrix, a run of
n equal symbols is its n-th power, put together from cached binary powers, and a conversation is the product of its runs.

A conversation is cut into segments of at most ``SEGMENT`` rows, so a task holds one segment, never a conversation.
Segments are multiplied from the last to the first, which gives the cost to go behind each one; then each
segment's choices are unrolled for every state it may start from (least letter first: D < I < K < R), the states are
followed from the first segment on, and each segment repairs its rows. Only the digest of the repaired
conversation and the audit, which are one value per conversation, meet as a stream of segments in order.

Defined results: a NULL ``conv_id`` or ``turn`` reads as one space in the key of the damage, and rows without ``conv_id``
are one conversation; NULL roles and texts are one space; equal turns are ordered by role, then text digest; repeated rows are rows of
their own, the later ones duplicates; roles that begin with another letter can only be changed or deleted; a conversation
without rows after the damage has zeros, an empty audit and the digest of the empty string; an empty table gives no
row; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import kept
from panelworks.llm.conversations import ROWS_PER_TASK, numbered

SEGMENT = 512
RETYPE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NEVER = 1 << 40
BLANK = "[^\\x20\\x09-\\x0D]"

#: states: nothing yet, after s, after u, after a (the first and the last may end)
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (0, NEVER, NEVER, 0)
#: the role that may be inserted or taken in each state, and where it leads
NEXT = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}


def choices(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state after) of what may be done with a row; symbols are s, u, a, o, in capitals if truncated,
    and x for a row that must go."""
    found = [("D", DELETE, state)]
    if symbol != "x":
        extra = TRUNCATED if symbol.isupper() else 0
        initial = symbol.lower()
        role, after = NEXT[state]
        if initial == role:
            found.append(("K", extra, after))
        elif initial == "s" and state == START:
            found.append(("K", extra, SYSTEM))
        found.append(("R", RETYPE + extra, after))
    return found


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product of matrices (or of a matrix and a column)."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), NEVER)


def _unit() -> np.ndarray:
    return np.where(np.eye(4, dtype=bool), 0, NEVER)


@lru_cache(maxsize=None)
def insertions() -> np.ndarray:
    """Cheapest ways from state to state by inserted turns alone."""
    step = _unit()
    for state, (_, after) in NEXT.items():
        step[state, after] = min(step[state, after], INSERT)
    return product(product(step, step), product(step, step))


@lru_cache(maxsize=None)
def power(symbol: str, exponent: int) -> np.ndarray:
    """The symbol's matrix to the power of 2 ** exponent; insertions may stand before every row."""
    if exponent:
        half = power(symbol, exponent - 1)
        return product(half, half)
    row = np.full((4, 4), NEVER)
    for state in range(4):
        for _, cost, after in choices(symbol, state):
            row[state, after] = min(row[state, after], cost)
    return product(insertions(), row)


def advance(symbols: str) -> np.ndarray:
    """The matrix of a sequence of symbols, run by run."""
    whole = _unit()
    for symbol, run in groupby(symbols):
        n, bit = sum(1 for _ in run), 0
        while n:
            if n & 1:
                whole = product(whole, power(symbol, bit))
            n, bit = n >> 1, bit + 1
    return whole


def last_costs() -> tuple[int, ...]:
    """Cost to go behind the last row."""
    return tuple(product(insertions(), np.array(ENDS)[:, None])[:, 0].tolist())


@lru_cache(maxsize=100_000)
def _before(symbol: str, togo: tuple[int, ...]) -> tuple[tuple[int, ...], int, tuple[tuple[str, int], ...]]:
    """Cost to go before a row, given that behind it, less its least value; and per state the letters that
    come first (insertions, then what happens to the row) with the state after the row."""
    rows = [[(cost + togo[after], letter, after) for letter, cost, after in choices(symbol, state)] for state in range(4)]
    cost = [min(r)[0] for r in rows]
    for _ in range(3):
        cost = [min(c, INSERT + cost[NEXT[s][1]]) for s, c in enumerate(cost)]
    steps = []
    for state in range(4):
        letters, now = "", state
        while True:
            options = [(letter, after) for value, letter, after in rows[now] if value == cost[now]]
            if INSERT + cost[NEXT[now][1]] == cost[now]:
                options.append(("I", NEXT[now][1]))
            letter, after = min(options)
            letters, now = letters + letter, after
            if letter != "I":
                break
        steps.append((letters, now))
    least = min(cost)
    return tuple(c - least for c in cost), least, tuple(steps)


def unroll(symbols: str, togo: Iterable[int]) -> list[tuple[tuple[str, int], ...]]:
    """For every row the letters and the state after it, by the state before it."""
    togo = tuple(int(t) for t in togo)
    least = min(togo)
    now, found = tuple(t - least for t in togo), []
    for symbol in reversed(symbols):
        now, _, steps = _before(symbol, now)
        found.append(steps)
    return found[::-1]


def follow(steps: list[tuple[tuple[str, int], ...]], state: int) -> tuple[list[str], int]:
    """The letters at each row when the first row is met in ``state``, and the state behind the last row."""
    letters = []
    for step in steps:
        own, state = step[state]
        letters.append(own)
    return letters, state


def closing(state: int) -> str:
    """Insertions behind the last row."""
    letters = ""
    while ENDS[state]:
        letters, state = letters + "I", NEXT[state][1]
    return letters


ROLES = {"u": "user", "a": "assistant"}


def repaired(letters: Iterable[str], rows: Iterable[tuple[str, str]], state: int) -> list[str]:
    """``role:text`` of the turns that the letters leave, ``state`` holding before the first."""
    out, own = [], iter(rows)
    for letter in "".join(letters):
        role, after = NEXT[state]
        if letter == "I":
            out.append(f"{ROLES[role]}:")
            state = after
            continue
        is_role, text = next(own)
        if letter == "R":
            out.append(f"{ROLES[role]}:{text}")
            state = after
        elif letter == "K":
            out.append(f"{is_role}:{text}")
            state = SYSTEM if is_role[0] == "s" else after
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text) of the rows after the damage; ``conv`` is the id as text, one space for NULL."""
    space = F.lit(" ")
    conv, turn, role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn", "role", "text"))
    rows = conversations.select(
        conv.alias("conv"), "turn", role.alias("role"), text.alias("text"), (F.crc32(F.concat(conv, F.lit(":"), turn)) % 20).alias("harm")
    )
    changed = rows.where("harm <> 0").select(
        "conv",
        "turn",
        F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("harm") == 3, 2).otherwise(1).alias("times"),
    )
    return changed.select("conv", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "times")).alias("copy"))


def symbols_of(rows: DataFrame, limit: int = ROWS_PER_TASK) -> DataFrame:
    """(conv, pos, turn, role, text, symbol, fault) of the rows in order."""
    marked = rows.withColumn("digest", F.md5("text"))
    # copies of a row need a total order when a conversation is dealt to several tasks
    placed = kept(numbered(marked, "conv", ["turn", "role", "digest", "copy"], limit))
    firsts = placed.groupBy("conv", "role", "digest").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    seen = placed.join(firsts.select("conv", "role", "digest", "first"), ["conv", "role", "digest"], "left")
    last = F.regexp_extract("text", f"({BLANK})[\\x20\\x09-\\x0D]*\\z", 1)
    fault = (
        F.when(~F.col("text").rlike(BLANK), "blank")
        .when(F.col("pos") > F.col("first"), "duplicate")
        .when(~last.isin(".", "!", "?"), "truncated")
    )
    initial = F.substring("role", 1, 1)
    symbol = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    faulty = seen.withColumns({"fault": fault, "initial": initial})
    symbol = (
        F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(symbol)).otherwise(symbol)
    )
    return faulty.withColumn("symbol", symbol).select("conv", "pos", "turn", "role", "text", "initial", "symbol", "fault")


def _sum(condition) -> object:
    return F.count(F.when(condition, 1))


def counts_of(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated) with map-side aggregation."""
    turns = rows.groupBy("conv", "turn").agg(
        *[_sum(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    )
    gaps = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return turns.groupBy("conv").agg(
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")]
    )


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def _table(columns: dict[str, tuple[pa.DataType, list]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, type=k) for k, v in columns.values()], names=list(columns))


def _matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments' matrices and their pairs of roles that may not meet."""
    for batch in batches:
        conv, part, symbols, initials = (batch.column(c).to_pylist() for c in ("conv", "part", "symbols", "initials"))
        yield _table(
            {
                "conv": (pa.string(), conv),
                "part": (pa.int64(), part),
                "symbols": (pa.string(), symbols),
                "matrix": (pa.list_(pa.int64()), [advance(s).ravel().tolist() for s in symbols]),
                "first": (pa.string(), [i[0] for i in initials]),
                "last": (pa.string(), [i[-1] for i in initials]),
                "illegal": (pa.int64(), [illegal_pairs(i) for i in initials]),
            }
        )


def _backward(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments from the last to the first: cost to go behind and before each, and illegal pairs up to the end."""
    conv, togo, follower, illegal = None, None, "", 0
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("togo", "cost", "illegal")}
        for own, matrix, first, last, n in zip(*[batch.column(c).to_pylist() for c in ("conv", "matrix", "first", "last", "illegal")]):
            if own != conv:
                conv, togo, follower, illegal = own, np.array(last_costs()), None, 0
            out["togo"].append(togo.tolist())
            togo = product(np.array(matrix).reshape(4, 4), togo[:, None])[:, 0]
            illegal += n + (illegal_pairs([last, follower]) if follower is not None else 0)
            follower = first
            out["cost"].append(int(togo[START]))
            out["illegal"].append(illegal)
        yield _table(
            {
                "conv": (pa.string(), batch.column("conv")),
                "part": (pa.int64(), batch.column("part")),
                "symbols": (pa.string(), batch.column("symbols")),
                "togo": (pa.list_(pa.int64()), out["togo"]),
                "cost": (pa.int64(), out["cost"]),
                "illegal": (pa.int64(), out["illegal"]),
            }
        )


def _outcomes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state behind each segment, by the state before it."""
    for batch in batches:
        after = []
        for symbols, togo in zip(batch.column("symbols").to_pylist(), batch.column("togo").to_pylist()):
            steps = unroll(symbols, togo)
            after.append([follow(steps, state)[1] for state in range(4)])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(after, type=pa.list_(pa.int32()))], names=[*batch.schema.names, "after"]
        )


def _forward(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments from the first to the last: the state before each."""
    conv, state = None, START
    for batch in batches:
        before = []
        for own, after in zip(batch.column("conv").to_pylist(), batch.column("after").to_pylist()):
            if own != conv:
                conv, state = own, START
            before.append(state)
            state = after[state]
        names = ["conv", "part", "togo", "cost", "illegal"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in names], pa.array(before, type=pa.int32())], names=[*names, "state"]
        )


def _repairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit and the repaired turns of each segment."""
    for batch in batches:
        audits, texts, ends = [], [], []
        for symbols, rows, togo, state in zip(*[batch.column(c).to_pylist() for c in ("symbols", "rows", "togo", "state")]):
            letters, after = follow(unroll(symbols, togo), state)
            audits.append("".join(letters))
            texts.append(repaired(letters, [(r["role"], r["text"]) for r in rows], state))
            ends.append(after)
        yield _table(
            {
                "conv": (pa.string(), batch.column("conv")),
                "part": (pa.int64(), batch.column("part")),
                "cost": (pa.int64(), batch.column("cost")),
                "illegal": (pa.int64(), batch.column("illegal")),
                "audit": (pa.string(), audits),
                "turns": (pa.list_(pa.string()), texts),
                "state": (pa.int32(), ends),
            }
        )


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its segments in order."""
    names = ("conv", "cost", "illegal", "audit", "turns", "state")
    conv, digest, empty, audit, head, state = None, None, True, [], (0, 0), START

    def done() -> tuple:
        tail = closing(state)
        more = repaired(tail, [], state)
        if more:
            digest.update(("" if empty else "\n").encode() + "\n".join(more).encode())
        return (conv, *head, "".join(audit) + tail, digest.hexdigest())

    def table(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [[]] * 5
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return _table(dict(zip(("conv", "cost", "illegal", "audit", "repaired_sha256"), zip(kinds, map(list, columns)))))

    for batch in batches:
        out = []
        for own, cost, illegal, letters, turns, after in zip(*[batch.column(c).to_pylist() for c in names]):
            if own != conv:
                if conv is not None:
                    out.append(done())
                conv, digest, empty, audit, head = own, hashlib.sha256(), True, [], (cost, illegal)
            audit.append(letters)
            for turn in turns:
                digest.update(("" if empty else "\n").encode() + turn.encode())
                empty = False
            state = after
        yield table(out)
    yield table([done()] if conv is not None else [])


def repair_segments(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv, part, cost, illegal, audit, turns, state): each segment's edits and the turns it leaves."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = F.floor((F.col("pos") - 1) / segment).alias("part")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "role", "text", "initial", "symbol")))
    segments = kept(
        rows.groupBy("conv", part)
        .agg(ordered.alias("rows"))
        .select("conv", "part", F.array_join("rows.symbol", "").alias("symbols"), F.col("rows.initial").alias("initials"), "rows")
    )
    matrices = segments.select("conv", "part", "symbols", "initials").mapInArrow(
        _matrices, "conv string, part long, symbols string, matrix array<long>, first string, last string, illegal long"
    )
    backward = matrices.repartition(n, "conv").sortWithinPartitions("conv", F.desc("part"))
    costs = backward.mapInArrow(_backward, "conv string, part long, symbols string, togo array<long>, cost long, illegal long")
    spread = costs.repartition(n, "conv", "part")  # the segments of one conversation unroll side by side
    outcomes = spread.mapInArrow(
        _outcomes, "conv string, part long, symbols string, togo array<long>, cost long, illegal long, after array<int>"
    )
    states = outcomes.repartition(n, "conv").sortWithinPartitions("conv", "part")
    states = states.mapInArrow(_forward, "conv string, part long, togo array<long>, cost long, illegal long, state int")
    texts = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("rows")
    joined = segments.select("conv", "part", "symbols", texts).join(states, ["conv", "part"])
    return joined.mapInArrow(
        _repairs, "conv string, part long, cost long, illegal long, audit string, turns array<string>, state int"
    )


def repair(conversations: DataFrame, segment: int = SEGMENT, limit: int = ROWS_PER_TASK) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = kept(symbols_of(damaged(conversations), limit))
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = repair_segments(rows, segment).repartition(n, "conv").sortWithinPartitions("conv", "part")
    found = parts.mapInArrow(_digests, "conv string, cost long, illegal long, audit string, repaired_sha256 string")
    everyone = conversations.select("conv_id").distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    whole = everyone.join(counts_of(rows), "conv", "left").join(found, "conv", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return whole.select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256")
    )
