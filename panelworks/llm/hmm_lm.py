"""Hidden Markov language model, trained by Baum-Welch over all training texts.

Tokens are lower-cased (A to Z) words between ASCII white space, and one end per
text. The ``OWN`` most frequent words are symbols of their own; all other words share
``SHARED`` symbols by their last three bytes, and within a symbol a word has the
share of its smoothed count (each shared symbol keeps a share for unseen words). The
probability of a word in a state is that of its symbol times that share, so the
model is a proper one over all words, and with a single state it is the smoothed
unigram model. Per iteration every partition runs the scaled forward-backward
recursion over its texts and emits expected counts (states x symbols numbers,
whatever the size of the input); Spark adds them and the driver normalises.

Word counts cover all training texts and stay distributed: at most ``LOOKUP`` of
the most frequent words travel with the tasks, all others meet their counts in a join.

Defined results: NULL and empty texts consist of the end alone; a NULL
``doc_id`` is never learned from and not held out; repeated rows are learned
from and scored each.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import batches, kept, remainder, whole_text

STATES, ITERATIONS = 8, 5
OWN, SHARED = 4_096, 1_024
LOOKUP = 65_536
#: classes of counts in each doubling, for the bound of the most frequent words
COUNT_CLASSES = 64
#: Weight, in tokens, of the corpus-wide symbol shares in each state.
PRIOR = 200.0
STAY = 0.9
TOKENS_AT_ONCE = 400_000
END = b""
SEED = 7


def words_of(text: str) -> list[bytes]:
    """Words of the contract: bytes.lower and bytes.split know ASCII letters and white space only."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shared_symbol(word: bytes) -> int:
    return OWN + zlib.crc32(word[-3:]) % SHARED


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, n long) over all texts; the end is the empty word."""

    def counted(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), type=pa.binary()), pa.array(list(counts.values()), type=pa.int64())],
                names=["word", "n"],
            )
            counts.clear()
            return batch

        for batch in batches(rows):
            for text in batch.column("text").to_pylist():
                counts.update(words_of(text))
                counts[END] += 1
            if len(counts) > 300_000:
                yield out()
        if counts:
            yield out()

    return docs.mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """What tasks need to know of the counts: frequent words and the mass of the shared symbols."""

    lookup: dict[bytes, tuple[int, float]]  # symbol and log10(count + 0.5)
    mass: np.ndarray  # smoothed count of every symbol
    tokens: int
    types: int


def frequent(counts: DataFrame, most: int = LOOKUP) -> DataFrame:
    """The most frequent words, at most ``most``: whole classes of nearly equal counts (exactly equal ones below 64).

    The bound comes from a histogram of at most a few thousand classes, so no task sends its own top to the driver.
    """
    level = F.floor(F.log2("n") * COUNT_CLASSES)
    sizes = sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True)
    lowest, held = None, 0
    for r in sizes:
        held += r["count"]
        if held > most:
            break
        lowest = r.level
    return counts.where(F.lit(False) if lowest is None else level >= lowest)


def lexicon(counts: DataFrame) -> Lexicon:
    total = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    top = sorted(frequent(counts.where(F.length("word") > 0)).collect(), key=lambda r: (-r.n, bytes(r.word)))
    ends = counts.where(F.length("word") == 0).first()
    n_end = ends.n if ends else 0
    own = {bytes(r.word): k for k, r in enumerate(top[: OWN - 1], start=1)}
    lookup = {bytes(r.word): (own.get(bytes(r.word)) or shared_symbol(bytes(r.word)), math.log10(r.n + 0.5)) for r in top}
    lookup[END] = (0, math.log10(n_end + 0.5))
    mass = np.full(OWN + SHARED, 0.5)  # an unseen word for every shared symbol
    mass[:OWN] = 1e-9  # symbols without a word
    mass[0] = n_end + 0.5
    for r in top[: OWN - 1]:
        mass[own[bytes(r.word)]] = r.n + 0.5
    symbol = F.crc32(F.expr("substring(word, -3, 3)")) % SHARED
    # the own words lead the order of counts; all others, ties included, add to the shared symbols
    rest = counts.where(F.length("word") > 0).groupBy(symbol.alias("symbol")).agg(F.sum(F.col("n") + F.lit(0.5)).alias("m"))
    for r in rest.collect():  # at most SHARED rows
        mass[OWN + r.symbol] += r.m
    for r in top[: OWN - 1]:
        mass[shared_symbol(bytes(r.word))] -= r.n + 0.5
    return Lexicon(lookup, np.maximum(mass, 1e-9), int(total[0] or 0), int(total[1]))


def encoded(docs: DataFrame, words: Lexicon) -> DataFrame:
    """(row, doc_id, train, symbols, n_tokens, n_top, top_log, shared_log, rare words) of every text."""
    facts = docs.sparkSession.sparkContext.broadcast(words.lookup)

    def numbered(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = facts.value
        end = lookup[END]
        for batch in batches(rows):
            symbols, sizes, known, top_log, shared_log, rare = [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                own, others = [], []
                every = shared = 0.0
                for word in words_of(text):
                    found = lookup.get(word)
                    if found is None:
                        own.append(shared_symbol(word))
                        others.append(word)
                    else:
                        own.append(found[0])
                        every += found[1]
                        if found[0] >= OWN:
                            shared += found[1]
                own.append(0)
                symbols.append(np.array(own, dtype=np.uint16).tobytes())
                sizes.append(len(own))
                known.append(len(own) - len(others))
                top_log.append(every + end[1])
                shared_log.append(shared)
                rare.append(list(Counter(others).items()))
            flat = [pair for pairs in rare for pair in pairs]
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in rare])))
            pairs = pa.StructArray.from_arrays(
                [pa.array([w for w, _ in flat], type=pa.binary()), pa.array([n for _, n in flat], type=pa.int32())],
                names=["word", "n"],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("train"),
                    pa.array(symbols, type=pa.binary()),
                    pa.array(sizes, type=pa.int64()),
                    pa.array(known, type=pa.int64()),
                    pa.array(top_log),
                    pa.array(shared_log),
                    pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pairs),
                ],
                names=["doc_id", "train", "symbols", "n_tokens", "n_top", "top_log", "shared_log", "rare"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.mapInArrow(
        numbered,
        f"doc_id {id_type}, train boolean, symbols binary, n_tokens long, n_top long, top_log double, "
        "shared_log double, rare array<struct<word:binary,n:int>>",
    )
    return kept(rows.withColumn("row", F.monotonically_increasing_id()))


@dataclass
class Hmm:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # symbols x states

    def batch(self, texts: list[np.ndarray], learn: "Expected | None" = None) -> np.ndarray:
        """Natural log likelihood of each text by the scaled forward recursion; adds expected counts to ``learn``."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        sizes = np.array([len(texts[i]) for i in order])
        steps = int(sizes[0])
        active = np.searchsorted(-sizes, -np.arange(steps), "left")  # texts longer than t
        begin = np.concatenate(([0], np.cumsum(active)))
        seen = np.empty(begin[-1], dtype=np.int64)
        place = np.argsort(np.concatenate([np.arange(n) for n in sizes]), kind="stable")
        seen[:] = np.concatenate([texts[i] for i in order])[place]  # all first symbols, all second ones, ...
        likely = self.emit[seen]
        scale = np.empty(begin[-1], dtype=np.float32)
        ahead = np.empty((begin[-1], len(self.start)), dtype=np.float32)
        move = self.move.astype(np.float32)
        now = np.broadcast_to(self.start.astype(np.float32), (active[0], len(self.start)))
        for t in range(steps):
            span = slice(begin[t], begin[t + 1])
            if t:
                now = ahead[begin[t - 1] : begin[t - 1] + active[t]] @ move
            now = now * likely[span]
            total = now.sum(axis=1)
            scale[span] = total
            np.divide(now, total[:, None], out=ahead[span])
        logs = np.log(scale.astype(np.float64))
        text_of = np.concatenate([np.arange(n) for n in active])
        result = np.empty(len(texts))
        result[order] = np.bincount(text_of, logs, len(texts))
        if learn is not None:
            behind = np.ones((active[-1], len(self.start)), dtype=np.float32)
            pairs = np.zeros_like(move, dtype=np.float64)
            share = np.empty_like(ahead)
            for t in range(steps - 1, -1, -1):
                span = slice(begin[t], begin[t + 1])
                if t < steps - 1:
                    after = slice(begin[t + 1], begin[t + 2])
                    weight = likely[after] * behind / scale[after][:, None]
                    pairs += ahead[begin[t] : begin[t] + active[t + 1]].T @ weight
                    behind = np.ones((active[t], len(self.start)), dtype=np.float32)
                    behind[: active[t + 1]] = weight @ move.T
                np.multiply(ahead[span], behind, out=share[span])
            learn.move += pairs * self.move
            learn.start += share[: active[0]].sum(axis=0)
            for k in range(len(self.start)):
                learn.emit[:, k] += np.bincount(seen, share[:, k], len(learn.emit))
            learn.log += float(logs.sum())
        return result


@dataclass
class Expected:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    log: float = 0.0


def first_model(mass: np.ndarray) -> Hmm:
    """Slightly different states that tend to stay."""
    rng = np.random.default_rng(SEED)
    emit = mass[:, None] * rng.uniform(0.6, 1.4, (len(mass), STATES))
    move = np.full((STATES, STATES), (1 - STAY) / max(1, STATES - 1))
    np.fill_diagonal(move, STAY)
    return Hmm(np.full(STATES, 1 / STATES), move, (emit / emit.sum(axis=0)).astype(np.float32))


def _groups(rows: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of rows of similar total length with their symbols."""
    for batch in rows:
        texts = [np.frombuffer(s, dtype=np.uint16) for s in batch.column("symbols").to_pylist()]
        order = np.argsort([len(t) for t in texts], kind="stable")
        start, total = 0, 0
        for i, k in enumerate(order):
            total += len(texts[k])
            if total >= TOKENS_AT_ONCE or i == len(order) - 1:
                chosen = order[start : i + 1]
                yield batch.take(pa.array(chosen)), [texts[c] for c in chosen]
                start, total = i + 1, 0


def improved(model: Hmm, texts: DataFrame, mass: np.ndarray) -> tuple[Hmm, float]:
    """One Baum-Welch iteration over all rows; also the log likelihood before it."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def expected(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        learn = Expected(np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((len(own.emit), STATES)))
        for _, symbols in _groups(rows):
            own.batch(symbols, learn)
        used = np.flatnonzero(learn.emit.any(axis=1))
        if len(used):
            log = np.zeros((1, STATES))
            log[0, 0] = learn.log
            values = np.concatenate([learn.start[None, :], learn.move, log, learn.emit[used]])
            at = np.concatenate((np.arange(-STATES - 2, 0), used))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), *[pa.array(values[:, k]) for k in range(STATES)]], names=["at", *names]
            )

    names = [f"s{k}" for k in range(STATES)]
    sums = (
        texts.select("symbols")
        .mapInArrow(expected, "at long, " + ", ".join(f"{c} double" for c in names))
        .groupBy("at")
        .agg(*[F.sum(c).alias(c) for c in names])
        .collect()  # symbols x states numbers at most
    )
    emit = PRIOR * np.repeat((mass / mass.sum())[:, None], STATES, axis=1)
    start, move, log = np.full(STATES, 1.0), np.full((STATES, STATES), 1.0), 0.0
    for row in sums:
        values = np.array(row[1:])
        if row["at"] >= 0:
            emit[row["at"]] += values
        elif row["at"] == -1:
            log = values[0]
        elif row["at"] == -STATES - 2:
            start += values
        else:
            move[row["at"] + STATES + 1] += values
    normal = Hmm(
        start / start.sum(), move / move.sum(axis=1, keepdims=True), (emit / emit.sum(axis=0)).astype(np.float32)
    )
    return normal, log


def train(texts: DataFrame, mass: np.ndarray, iterations: int = ITERATIONS) -> tuple[Hmm, list[float]]:
    model, logs = first_model(mass), []
    for _ in range(iterations):
        model, log = improved(model, texts, mass)
        logs.append(log)
    return model, logs


def likelihoods(texts: DataFrame, model: Hmm, mass: np.ndarray) -> DataFrame:
    """``forward``: log10 likelihood of the symbols less the mass of the shared ones, for every row."""
    shared = texts.sparkSession.sparkContext.broadcast((model, np.log10(mass)))
    columns = ["row", "doc_id", "train", "n_tokens", "n_top", "top_log", "shared_log"]

    def scored(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, log_mass = shared.value
        for batch, symbols in _groups(rows):
            found = own.batch(symbols) / math.log(10)
            found -= np.array([log_mass[s[s >= OWN]].sum() for s in symbols])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], pa.array(found)], names=[*columns, "forward"]
            )

    id_type = texts.schema["doc_id"].dataType.simpleString()
    schema = (
        f"row long, doc_id {id_type}, train boolean, n_tokens long, n_top long, top_log double, shared_log double, "
        "forward double"
    )
    return texts.select(*columns, "symbols").mapInArrow(scored, schema)


def scores(docs: DataFrame) -> DataFrame:
    """Base and model score of every text, learned from the rows whose crc32 remainder modulo 5 is not 1."""
    fold = remainder("doc_id", 5)
    rows = docs.select("doc_id", whole_text(), F.coalesce(fold != 1, F.lit(False)).alias("train"))
    counts = kept(word_counts(rows.where("train").select("text")))
    words = lexicon(counts)
    texts = encoded(rows, words)
    model, _ = train(texts.where("train"), words.mass)
    # rare words meet their counts: the frequent ones, which could be hot, are not among them
    rare = texts.select("row", F.explode("rare").alias("r")).select("row", "r.word", F.col("r.n").alias("times"))
    met = rare.join(counts, "word", "left")
    log = F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))
    tails = met.groupBy("row").agg(
        F.sum(log).alias("rare_log"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known")
    )
    every = likelihoods(texts, model, words.mass).join(tails, "row", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    norm = math.log10(words.tokens + 0.5 * (words.types + 1))
    end_known = 1 if words.tokens else 0  # the end is unknown only where nothing was learned
    return every.select(
        "doc_id",
        F.coalesce(~F.col("train") & F.col("doc_id").isNotNull(), F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("n_top") - (1 - end_known) + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("top_log") + rare_log - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("forward") + F.col("shared_log") + rare_log).alias("score"),
    )
