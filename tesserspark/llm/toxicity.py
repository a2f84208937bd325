"""Toxicity by character n-grams scaled with naive Bayes log-count ratios (an NB-SVM's features, a logistic loss).

A feature is the presence of a hashed n-gram of code points in the lower-cased text, white space runs
made one space.  It is scaled by the log ratio of its smoothed document frequencies in the two
classes; a logistic regression on the scaled features gives the score.  Every n-gram in ``LEAST``
documents or more counts whose ratio lies ``SURE`` standard errors or more from zero: a threshold,
not a number of features.

Learning takes a bounded sample of the labelled rows (``MAX_TOXIC`` and ``MAX_CLEAN``, least hash of
doc_id first), in two passes over the sample where its texts are: document frequencies, summed by
ranges of hashes, and then the features present in each document.  Texts never reach the driver; it
fits the weights to the present features.  Classes are weighted back to their shares among all
labelled rows, so scores are probabilities.  Scoring runs over all texts, whole, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from tesserspark.llm.common import materialize

ORDERS, BITS, LEAST, SURE, ALPHA, MAX_TOXIC, MAX_CLEAN, THRESHOLD = (4, 6, 8), 22, 3, 3.0, 1.0, 3000, 4000, 0.3
#: Document frequencies are summed in this many ranges of hashes, one row each from a task.
RANGES = 32
_SPACE = regex.compile(r"\s+")


def grams(text: str) -> np.ndarray:
    """Hashes of all n-grams of the text, repeats included."""
    b = np.frombuffer((" " + _SPACE.sub(" ", text.lower()).strip() + " ").encode("utf-32-le", "replace"), np.uint32) + np.uint32(1)
    out, h = [], np.zeros(len(b), np.uint32)
    for k in range(max(ORDERS)):
        if len(b) <= k:
            break
        h = (h[: len(b) - k] if k else h) * np.uint32(0x01000193) ^ b[k:]
        if k + 1 in ORDERS:
            x = h * np.uint32(0x9E3779B1)
            out.append((x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


@dataclass
class Model:
    slot: np.ndarray  # of each hash, the feature's place among the weights, or -1
    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        found = self.slot[grams(text)]
        found = np.unique(found[found >= 0])
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[found].sum(), -60, 60))))


def log_ratios(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int, least: int = LEAST, sure: float = SURE) -> tuple[np.ndarray, np.ndarray]:
    """(places of the features that count, their log-count ratios) from document frequencies in both classes."""
    ratio = np.log((toxic + ALPHA) / (n_toxic + 2 * ALPHA)) - np.log((clean + ALPHA) / (n_clean + 2 * ALPHA))
    error = np.sqrt(1 / (toxic + ALPHA) + 1 / (clean + ALPHA))
    chosen = np.flatnonzero((clean + toxic >= least) & (np.abs(ratio) >= sure * error))
    return chosen, ratio[chosen]


def fit(present: list[np.ndarray], toxic: np.ndarray, ratios: np.ndarray, share: float, l2: float = 1e-2, rounds: int = 120) -> tuple[np.ndarray, float]:
    """(weights, bias) from the distinct features present in each document; share: of toxic rows among all labelled ones."""
    n = np.array([(toxic == 0).sum(), (toxic == 1).sum()])
    idx = np.concatenate([*present, np.empty(0, np.int32)]).astype(np.int32)
    doc = np.repeat(np.arange(len(present), dtype=np.int32), [len(x) for x in present])
    weight = np.where(toxic == 1, share / n[1], (1 - share) / n[0])
    w, bias = np.zeros(len(ratios)), float(np.log(share / (1 - share)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):  # Adam on the whole sample
        z = bias + np.bincount(doc, (w * ratios)[idx], minlength=len(present))
        e = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - toxic)
        g = ratios * np.bincount(idx, e[doc], minlength=len(w)) + l2 * w
        gb = e.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = 0.02 / (1 + t / 60)
        w = w - step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        bias -= step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-9)
    return w * ratios, float(bias)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of a task's rows (toxic, text), packed by range of hashes: hashes, clean, toxic."""
    df = np.zeros((2, 1 << BITS), np.uint32)
    for batch in batches:
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            df[y, np.unique(grams(text.as_py()))] += 1
    seen = np.flatnonzero(df.any(axis=0)).astype(np.uint32)
    for part, hashes in enumerate(np.split(seen, np.searchsorted(seen, np.arange(1, RANGES) << (BITS - RANGES.bit_length() + 1)))):
        if len(hashes):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.concatenate([hashes, df[0, hashes], df[1, hashes]]).tobytes()], pa.binary())], names=["part", "counts"])


def _chosen(n_clean: int, n_toxic: int):
    """The features of a range of hashes that count, from the packed frequencies of all tasks."""

    def run(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x, np.uint32).reshape(3, -1) for x in table["counts"].to_pylist()]
        hashes, place = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
        clean, toxic = (np.bincount(place, np.concatenate([r[k] for r in rows])) for k in (1, 2))
        chosen, ratio = log_ratios(clean, toxic, n_clean, n_toxic)
        return pa.table({"hash": pa.array(hashes[chosen].astype(np.int64)), "ratio": pa.array(ratio)})

    return run


def _present(slot):
    """Rows (key, toxic, text) to (key, toxic, places of the distinct features present, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = slot.value
        for batch in batches:
            found = [np.unique(x[x >= 0]).tobytes() for x in (of[grams(t.as_py())] for t in batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["key", "toxic", "found"])

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Fits on at most max_toxic + max_clean labelled rows that are not held out.  With one class only, every text gets its share (clipped)."""
    marked = labels.select(F.col("doc_id").alias("key"), F.col("toxic").cast("int").alias("toxic")).where(F.col("key").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("key")))
    marked = marked.groupBy("key").agg(F.max("toxic").alias("toxic"))
    counts = dict(marked.groupBy("toxic").count().collect())
    share = float(np.clip(counts.get(1, 0) / max(1, sum(counts.values())), 1e-3, 1 - 1e-3))
    slot = np.full(1 << BITS, -1, np.int32)
    pick = [marked.where(F.col("toxic") == y).orderBy(F.xxhash64("key"), "key").limit(most) for y, most in ((1, max_toxic), (0, max_clean))]
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(pick[0].union(pick[1])), F.col("doc_id") == F.col("key"))
    sample = materialize(texts.groupBy("key", "toxic").agg(F.min("text").alias("text")), "labelled")  # rows that share an id count once
    n = dict(sample.groupBy("toxic").count().collect())
    if len(n) < 2:
        return Model(slot, np.zeros(0), float(np.log(share / (1 - share))))
    packed = sample.select("toxic", "text").mapInArrow(_frequencies, "part int, counts binary")
    features = packed.groupBy("part").applyInArrow(_chosen(n[0], n[1]), "hash long, ratio double").orderBy("hash").toPandas()  # bounded by the sample, and by the hashes
    slot[features["hash"].to_numpy()] = np.arange(len(features), dtype=np.int32)
    shared = docs.sparkSession.sparkContext.broadcast(slot)
    found = sample.select("key", "toxic", "text").mapInArrow(_present(shared), sample.drop("text").schema.add("found", "binary")).orderBy("key").toPandas()
    weights, bias = fit([np.frombuffer(x, np.int32) for x in found["found"]], found["toxic"].to_numpy(np.int64), features["ratio"].to_numpy(), share)
    return Model(slot, weights, bias)


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            scores = [m.score(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null and blank texts get the score of a text without features.  Rows without doc_id, labels
    other than 0 and 1 and held-out rows teach nothing; a doc_id labelled twice counts as toxic if
    either row says so, and the least of the texts of an id is learned from.  Without labels of both
    classes every score is the toxic share, clipped.  Texts of any length are scored whole; equal
    texts get equal scores; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_scored(shared), rows.drop("text").schema.add("score", "double"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
