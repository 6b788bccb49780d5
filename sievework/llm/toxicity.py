"""Operator 9: toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of hashed n-grams of the lower-cased text's bytes. Spark counts, class by class, in
how many labelled texts each feature stands; the features whose class shares differ most are kept, scaled by
their log-count ratio, and a logistic regression is fitted on them.

Training reads at most `MOST` labelled rows (those with the smallest hash of doc_id), a fixed bound: their ids are
broadcast, so no text is shuffled to meet its label. Scoring reads every whole text. Null and empty texts have no feature and get the score of the intercept. Without
labels, or with one class only, every score is the smoothed share of label 1. Labels that are null are left
out; a document labelled several times counts each time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import table, utf8_batches, written

MOST = 24_000
ORDERS = (3, 4, 5, 6)
BITS = 22
KEEP = 6_000
LEAST_DOCS = 3
SMOOTH = 1.0
RIDGE = 2e-4
ROUNDS = 400

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32


@dataclass
class Model:
    """Rows of `weights` belong to `features`, sorted."""

    features: np.ndarray
    ratios: np.ndarray
    weights: np.ndarray
    intercept: float


def _hashes(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each order, the feature of the n-gram that starts at each byte."""
    b = _FOLD[data]
    h = np.zeros(len(b), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(b) < n:
            return
        h = h[: len(b) - n + 1] * np.uint32(0x9E3779B1) + b[n - 1 :] + np.uint32(n)
        if n in ORDERS:
            yield n, ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)


def _present(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs; `wanted` holds for each feature whether it counts."""
    keys = []
    for n, feature in _hashes(data):
        at = np.arange(len(feature)) if wanted is None else np.flatnonzero(wanted[feature])
        text = np.searchsorted(offsets, at, side="right") - 1
        inside = at + n <= offsets[text + 1]
        keys.append((text[inside] << BITS) | feature[at[inside]].astype(np.int64))
    found = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return found >> BITS, found & (2**BITS - 1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, 2**BITS), np.int32)
    for part, data, offsets in utf8_batches(batches, "text", 1_000_000):
        label = part.column(part.schema.get_field_index("label")).to_numpy(zero_copy_only=False)
        text, feature = _present(data, offsets, None)
        for y in (0, 1):
            total[y] += np.bincount(feature[label[text] == y], minlength=2**BITS).astype(np.int32)
    at = np.flatnonzero(total.any(0))
    for start in range(0, len(at), 100_000):
        some = at[start : start + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0, some], pa.int64()), pa.array(total[1, some], pa.int64())], ["feature", "neg", "pos"])


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST, keep: int = KEEP) -> Model:
    """A model of `label` (0 or 1) from `text`, on the `most` labelled ids with the smallest hash."""
    ids = labels.select("doc_id", F.col("label").cast("int").alias("label")).where("label is not null").orderBy(F.xxhash64("doc_id")).limit(most)
    sample = written(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").repartition(12), "labelled")
    size = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    prior = float(np.log((n1 + SMOOTH) / (n0 + SMOOTH)))
    if not n0 or not n1:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.zeros(0), prior)
    pooled = (F.col("pos") + F.col("neg")) / F.lit(float(n0 + n1))
    spread = (F.col("pos") / F.lit(float(n1)) - F.col("neg") / F.lit(float(n0))) / F.sqrt(pooled * (1 - pooled) + 1e-9)
    counted = sample.select("text", "label").mapInArrow(_counts, "feature long, neg long, pos long").groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    best = counted.where(F.col("pos") + F.col("neg") >= LEAST_DOCS).orderBy(F.abs(spread).desc(), "feature").limit(keep).toPandas().sort_values("feature")
    features = best["feature"].to_numpy(np.int64)
    p, q = best["pos"].to_numpy() + SMOOTH, best["neg"].to_numpy() + SMOOTH
    ratios = np.log(p / (n1 + 2 * SMOOTH)) - np.log(q / (n0 + 2 * SMOOTH))
    wanted = np.zeros(2**BITS, bool)
    wanted[features] = True

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in utf8_batches(batches, "text", 1_000_000):
            text, feature = _present(data, offsets, wanted)
            lists = np.split(np.searchsorted(features, feature).astype(np.int32), np.cumsum(np.bincount(text, minlength=part.num_rows))[:-1])
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("label")), pa.array(lists, pa.list_(pa.int32()))], ["label", "at"])

    got = sample.select("text", "label").mapInArrow(rows, "label int, at array<int>").toArrow()
    at = got["at"].combine_chunks()
    y = got["label"].to_numpy().astype(float)
    counts = np.diff(at.offsets.to_numpy())
    weights, intercept = _logistic(np.repeat(np.arange(len(y)), counts), at.values.to_numpy(), ratios, y, prior)
    return Model(features, ratios, weights, intercept)


def _logistic(row: np.ndarray, col: np.ndarray, scale: np.ndarray, y: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Ridge logistic regression of y on scale[col] at (row, col), by accelerated gradient descent."""
    n, x = len(y), scale[col]
    w, b, v, c = np.zeros(len(scale)), prior, np.zeros(len(scale)), prior
    square = np.bincount(row, x * x, minlength=n)
    step = 4.0 / (square.mean() * 4 + 1.0)
    for t in range(ROUNDS):
        z = np.bincount(row, x * v[col], minlength=n) + c
        g = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        w1 = v - step * (np.bincount(col, x * g[row], minlength=len(scale)) / n + RIDGE * v)
        b1 = c - step * g.mean()
        k = t / (t + 3)
        v, c = w1 + k * (w1 - w), b1 + k * (b1 - b)
        w, b = w1, b1
    return w, float(b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the score of each text."""
    value = np.zeros(2**BITS, np.float32)
    value[model.features] = model.weights * model.ratios
    wanted = value != 0
    at, kept, intercept = np.flatnonzero(wanted), value[wanted], model.intercept
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(2**BITS, np.float32)
        own[at] = kept
        hit = own != 0
        for part, data, offsets in utf8_batches(batches, "text", 2_000_000):
            text, feature = _present(data, offsets, hit)
            z = np.bincount(text, own[feature], minlength=part.num_rows) + intercept
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", F.col("toxic").alias("label"))
    model = fit(docs, labels)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op9_toxicity": op9}
