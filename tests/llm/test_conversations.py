"""Conversation trie and structure repair against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from panelworks.llm import prefix_trie, repair

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def some_conversations(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), *range(100, 100 + n), *range(1003, 1010), -5, 700]:
        first = rng.choice([None, 0, 3])
        for t in range(rng.choice([1, 1, 2, 3, 4, 7, 9])):
            turn = None if first is None and t == 0 else (first or 0) + t
            role = rng.choice(["user", "assistant", None, "system"]) if rng.random() < 0.2 else ["user", "assistant"][t % 2]
            text = rng.choice(["Yes.", "No", "", None, "Why?", "Ünï 😀."])
            rows.append((c, turn, role, text))
    rng.shuffle(rows)
    return rows


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, r, hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), (r, x)))
    turns = {c: [v[-1] for v in sorted(vs)] for c, vs in own.items()}
    full = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        full[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, path in full.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[q] for q in children[p])
    return {
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
         sha(",".join(map(str, sorted(c for c in m if full[c] == p)))))
        for p, m in members.items()
    }


@pytest.mark.parametrize(
    "options",
    [{}, {"shard_rows": 8, "band": 2, "queued": 2}, {"shard_rows": 1, "band": 3}, {"limit": 3}, {"shard_rows": 10**9}],
)
def test_trie_equals_brute_force(spark, options):
    rows = some_conversations(1)
    if "limit" in options:
        rows = rows + [(40, t, "user", f"turn {t % 7}") for t in range(40)]
    frame = spark.createDataFrame([(None, 1, "user", "x"), *rows], SCHEMA).selectExpr("*", "'k' AS key", "1 AS depth", "2 AS shard")
    got = [tuple(r) for r in prefix_trie.prefix_trie(frame, **options).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_trie(rows)


def test_trie_of_odd_tables(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    copies = [(c, t, "user", "the same") for c in range(1, 300) for t in range(3)] * 2
    got = {tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(copies, SCHEMA), shard_rows=16).collect()}
    assert got == brute_trie(copies)


def test_queue_spills_in_order():
    rng = random.Random(3)
    queue, items = prefix_trie.SpillingQueue(50), [(rng.randrange(100), i) for i in range(6000)]
    out = []
    for item in items:
        queue.push(item)
        if rng.random() < 0.1:
            out.append(queue.pop())
    while len(queue):
        out.append(queue.pop())
    assert sorted(out) == sorted(items) and queue.file is not None
    tail = out[-3000:]
    assert tail == sorted(tail)


def brute_repair(rows):
    """Every row's edits by Dijkstra's search over (row, state), cheapest and then least audit first."""
    import heapq
    import re

    convs, after = {}, defaultdict(list)
    for c, t, r, x in rows:
        convs.setdefault(c, None)
        show = lambda v: " " if v is None else str(v)
        harm = zlib.crc32(f"{show(c)}:{show(t)}".encode()) % 20
        r, x = show(r), show(x)
        if harm == 0:
            continue
        x = "" if harm == 1 else re.sub("[.!?]", "", x) if harm == 2 else x
        r = "user" if harm == 4 else r
        after[c] += [(t is not None, t or 0, r, hashlib.md5(x.encode()).hexdigest(), x, t)] * (2 if harm == 3 else 1)
    found = set()
    for c in convs:
        own = sorted(after[c], key=lambda v: v[:4])
        turns = [v[5] for v in own if v[5] is not None]
        seen, faults = set(), []
        for v in own:
            solid = [ch for ch in v[4] if ch not in " \t\n\x0b\x0c\r"]
            faults.append("blank" if not solid else "duplicate" if (v[2], v[4]) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((v[2], v[4]))
        initials = [v[2][:1] for v in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        heap, done, best = [(0, "", 0, "", ())], set(), None
        while heap:
            cost, audit, i, roles, out = heapq.heappop(heap)
            state = "u" if roles.endswith("u") else "a" if roles.endswith("a") else roles
            if i == len(own) and (not roles or roles.endswith("a")):
                best = (cost, audit, out)
                break
            if (i, state) in done:
                continue
            done.add((i, state))
            wanted = "a" if roles.endswith("u") else "u"
            name = {"u": "user", "a": "assistant"}[wanted]
            heapq.heappush(heap, (cost + 5, audit + "I", i, roles + wanted, (*out, f"{name}:")))
            if i < len(own):
                role, text, fault = own[i][2], own[i][4], faults[i]
                heapq.heappush(heap, (cost + 2, audit + "D", i + 1, roles, out))
                if fault not in ("blank", "duplicate"):
                    extra = 5 if fault == "truncated" else 0
                    if role[:1] == wanted or role[:1] == "s" and not roles:
                        heapq.heappush(heap, (cost + extra, audit + "K", i + 1, roles + role[0], (*out, f"{role}:{text}")))
                    heapq.heappush(heap, (cost + extra + 1, audit + "R", i + 1, roles + wanted, (*out, f"{name}:{text}")))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        found.add((c, gaps, *counts, illegal, best[0], best[1], sha("\n".join(best[2]))))
    return found


def broken_conversations(seed, n=250):
    rng = random.Random(seed)
    rows = []
    for c in [None, *range(n)]:
        t = rng.choice([None, 0, 5])
        for k in range(rng.choice([0, 1, 2, 3, 5, 8, 14]) + 1):
            role = rng.choices(["user", "assistant", "system", "tool", None, "", "a"], [9, 9, 2, 1, 1, 1, 1])[0]
            text = rng.choice(["Yes.", "No", "", None, " \n", "Why? ", f"Turn {k}.", f"cut {k}", f"Ünï {k} 😀!\n"])
            rows.append((c, t, role, text))
            t = (t or 0) + rng.choice([0, 1, 1, 1, 4]) if t is not None or k else rng.choice([None, 1])
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"segment": 3}, {"segment": 2, "limit": 4}])
def test_repair_equals_search(spark, options):
    rows = broken_conversations(5)
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'k' AS conv", "1 AS part", "2 AS state")
    got = [tuple(r) for r in repair.repair(frame, **options).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_repair(rows)


def test_repair_of_odd_tables(spark):
    assert repair.repair(spark.createDataFrame([], SCHEMA)).collect() == []
    long_text = "word " * 100_000 + "end."
    rows = [(1, t, ["user", "assistant"][t % 2], long_text if t == 3 else f"Turn {t}.") for t in range(1500)] + [(2, None, None, None)]
    got = {tuple(r) for r in repair.repair(spark.createDataFrame(rows, SCHEMA), segment=100).collect()}
    assert got == brute_repair(rows)


def test_powers_of_runs_equal_single_steps():
    rng = random.Random(2)
    for _ in range(50):
        symbols = "".join(rng.choice("suaoSUAOx") * rng.choice([1, 1, 2, 7, 30]) for _ in range(rng.randrange(1, 6)))
        whole = repair.product(repair.advance(symbols), np.array(repair.last_costs())[:, None])[:, 0]
        now = tuple(repair.last_costs())
        offset = min(now)
        now = tuple(v - offset for v in now)
        for symbol in reversed(symbols):
            now, least, _ = repair._before(symbol, now)
            offset += least
        assert [v + offset for v in now] == whole.tolist()
