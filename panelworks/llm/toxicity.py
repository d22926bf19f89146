"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

The class counts of hashed character n-grams (3 to 6 code points, presence per
document) come from every labelled training row. Their smoothed log ratio ``r``
scales the features of a logistic regression, which is fitted on a sample of at
most ``fit_rows`` labelled rows over the ``MAX_FEATURES`` most telling n-grams.
Scoring is a map over whole texts: no shuffle.

Defined results: NULL and empty texts get the score of a text without features;
rows without a label, or with a NULL one, teach nothing; a document with several
labels counts once, toxic if any of them is; an empty training set, or one with
a single class, gives the constant score of its smoothed class share. Extra
columns pass through untouched where asked for and are never features.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelworks.llm.common import batches, broadcast_if_small, column, free_names, kept, remainder, whole_text

BITS = 20
LENGTHS = (3, 4, 5, 6)
MAX_FEATURES = 2_000
FIT_ROWS = 20_000
SMOOTHING = 1.0
RIDGE = 1.0
STEPS = 200


def ngram_hashes(text: str) -> np.ndarray:
    """Hashed n-grams of the lower-cased text, padded by one blank at either end; repeats included."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    found = []
    h = np.full(len(points), 0x811C9DC5, dtype=np.uint32)
    for n in range(1, LENGTHS[-1] + 1):
        if len(points) < n:
            break
        # the hash of n points from that of the first n - 1
        h = (h[: len(points) - n + 1] ^ points[n - 1 :]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        if n >= LENGTHS[0]:
            found.append((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS))
    return np.concatenate(found) if found else np.empty(0, dtype=np.uint32)


def ngram_bins(text: str) -> np.ndarray:
    """Distinct hashed n-grams."""
    bins = ngram_hashes(text)
    marked = np.zeros(1 << BITS, dtype=bool) if len(bins) > 100_000 else None
    if marked is None:
        return np.unique(bins)
    marked[bins] = True
    return np.flatnonzero(marked)


@dataclass
class ToxicityModel:
    """Weights by n-gram bin (already multiplied by the ratios) and the intercept."""

    weights: np.ndarray
    intercept: float

    def score(self, text: str) -> float:
        bins = ngram_hashes(text)
        used = np.unique(bins[self.weights[bins] != 0])
        z = self.intercept + float(self.weights[used].astype(np.float64).sum())
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic 0/1): labelled documents, one label for each id."""
    marks = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    )
    return docs.select("doc_id", whole_text()).join(broadcast_if_small(marks), "doc_id")


def _class_counts(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), dtype=np.int64)
    sizes = [0, 0]
    for batch in batches(rows):
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic, ngram_bins(text)] += 1
            sizes[toxic] += 1
    if sum(sizes):
        bins = np.flatnonzero(counts.sum(axis=0))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(bins, -1), type=pa.int32()),
                pa.array(np.append(counts[0, bins], sizes[0])),
                pa.array(np.append(counts[1, bins], sizes[1])),
            ],
            names=["bin", "clean", "toxic"],
        )


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Fit on labelled rows; callers leave held-out rows out of ``labels``.

    What reaches the driver is bounded: ``MAX_FEATURES`` ratios and ``fit_rows`` rows
    of as many features at most.
    """
    rows = labelled(docs, labels)
    counts = kept(
        rows.mapInArrow(_class_counts, "bin int, clean long, toxic long")
        .groupBy("bin")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    )
    sizes = counts.where("bin = -1").first()
    clean, toxic = (sizes.clean, sizes.toxic) if sizes else (0, 0)
    prior = np.log((toxic + 1.0) / (clean + 1.0))
    weights = np.zeros(1 << BITS, dtype=np.float32)
    if not clean or not toxic:
        return ToxicityModel(weights, float(prior))
    p, q = F.col("toxic") + SMOOTHING, F.col("clean") + SMOOTHING
    log_ratio = F.log(p / (toxic + 2 * SMOOTHING)) - F.log(q / (clean + 2 * SMOOTHING))
    # the standard error of a log ratio makes rare n-grams compete fairly with common ones
    telling = F.abs("ratio") / F.sqrt(1 / p + 1 / q)
    best = (
        counts.where("bin >= 0")
        .withColumn("ratio", log_ratio)
        .orderBy(telling.desc(), "bin")
        .limit(MAX_FEATURES)
        .select("bin", "ratio")
        .collect()
    )
    bins, ratio = np.array([r.bin for r in best], dtype=np.int64), np.array([r.ratio for r in best])
    slot = np.full(1 << BITS, -1, dtype=np.int32)
    slot[bins] = np.arange(len(bins))
    shared = docs.sparkSession.sparkContext.broadcast(slot)

    def features(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            found = [(f := shared.value[ngram_bins(t)])[f >= 0].tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, type=pa.binary()), batch.column("toxic")], names=["features", "toxic"]
            )

    total = clean + toxic
    draw = F.xxhash64("doc_id", F.lit("fit"))
    sample = rows if total <= fit_rows else rows.where(F.pmod(draw, F.lit(total)) < fit_rows)
    found = sample.mapInArrow(features, "features binary, toxic int")
    # the draw may exceed the bound a little: which rows go, and their order, is the same in every run
    fitted = found.orderBy(F.xxhash64("features"), "features", "toxic").limit(fit_rows).collect()
    active = [np.frombuffer(r.features, dtype=np.int32) for r in fitted]
    w, b = _logistic(active, [r.toxic for r in fitted], ratio, prior)
    weights[bins] = (w * ratio).astype(np.float32)
    return ToxicityModel(weights, b)


def _logistic(
    rows: list[np.ndarray], toxic: list[int], ratio: np.ndarray, prior: float
) -> tuple[np.ndarray, float]:
    """Ridge logistic regression over ratio-scaled presence features by accelerated gradient steps."""
    columns = np.concatenate(rows) if rows else np.empty(0, dtype=np.int32)
    row_of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    values = ratio[columns]
    y = np.asarray(toxic, dtype=float)
    n, m = len(rows), len(ratio)
    # the largest singular value bounds the curvature
    v = np.ones(m) / np.sqrt(m)
    for _ in range(12):
        u = np.bincount(row_of, values * v[columns], n)
        v = np.bincount(columns, values * u[row_of], m)
        norm = np.linalg.norm(v) or 1.0
        v /= norm
    step = 1.0 / (0.25 * (1.1 * norm + n) + RIDGE)
    w, b = np.zeros(m), float(prior)
    at, at_b, pace = w, b, 1.0
    for _ in range(STEPS):
        z = np.bincount(row_of, values * at[columns], n) + at_b
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        new = at - step * (np.bincount(columns, values * error[row_of], m) + RIDGE * at)
        new_b = at_b - step * error.sum()
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        at, at_b = new + (pace - 1) / faster * (new - w), new_b + (pace - 1) / faster * (new_b - b)
        w, b, pace = new, new_b, faster
    return w, b


def score(
    docs: DataFrame, model: ToxicityModel, keep: Sequence[str] = ("doc_id",), out: str = "score"
) -> DataFrame:
    """``keep`` columns of every row and its score under the name ``out``; a map, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, text="scored"):
            scores = pa.array([shared.value.score(t) for t in batch.column("scored").to_pylist()], type=pa.float64())
            kept_columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept_columns, scores], names=[*keep, out])

    # tasks see numbered columns, whatever the names of the table
    chosen = docs.select(*[column(c).alias(f"c{i}") for i, c in enumerate(keep)], whole_text("text").alias("scored"))
    fields = [T.StructField(c, docs.schema[c].dataType) for c in keep]
    return chosen.mapInArrow(scored, T.StructType([*fields, T.StructField(out, T.DoubleType())]))


def training_labels(labels: DataFrame) -> DataFrame:
    """The rows the query may learn from: crc32 of the id modulo 4 is not 2."""
    return labels.where(F.coalesce(remainder("doc_id", 4) != 2, F.lit(False)))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Documents whose score stays below ``threshold``, with all their columns."""
    model = train(docs, training_labels(labels))
    (out,) = free_names(docs.columns, "_toxicity")
    scored = score(docs, model, keep=docs.columns, out=out)
    return scored.where(F.col(out) < threshold).drop(out)


