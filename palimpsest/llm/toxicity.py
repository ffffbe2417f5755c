"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: the different words, their stems (first bytes), pairs of neighbouring words and pairs of words with
one between them, hashed to 2**BITS places. Training runs over a bounded sample of labelled rows, one example after the other, with a learning
rate for each coordinate and an L1 term that leaves most weights at zero. The few others are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import first_of_each, fold_bucket, sliced, table
from .textscan import Scan, mixed

BITS = 20
SAMPLE_DOCS = 8_000
FOLDS = 5
STEMS = (4, 6)
ALPHA, BETA, L1, L2 = 0.15, 1.0, 6.0, 0.5
EPOCHS = 4
BIAS = 0  # place of the constant feature
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def places(scan: Scan) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of every word, stem, pair and skip pair, repeats included."""
    h, *stems = scan.hashes(*STEMS)
    doc = scan.doc
    next_to, over_one = doc[:-1] == doc[1:], doc[:-2] == doc[2:]
    with np.errstate(over="ignore"):
        pair = mixed(h[:-1] * _PAIR + h[1:])[next_to]
        skip = mixed(h[:-2] * _SKIP + (h[2:] ^ _SKIP))[over_one]
        stems = [mixed(x + np.uint64(m)) for x, m in zip(stems, STEMS)]
    docs = np.concatenate([doc] * (1 + len(stems)) + [doc[:-1][next_to], doc[:-2][over_one]])
    at = (np.concatenate([h, *stems, pair, skip]) >> np.uint64(64 - BITS)).astype(np.int64)
    return docs, np.where(at == BIAS, 1, at)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different places of each text as little-endian 32-bit integers."""
    for batch in sliced(batches, "text"):
        docs, at = places(Scan(batch.column("text")))
        both = np.unique(docs << BITS | at)
        bounds = np.searchsorted(both >> BITS, np.arange(batch.num_rows + 1))
        low = (both & ((1 << BITS) - 1)).astype("<u4")
        rows = pa.array([low[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())
        yield pa.record_batch([batch.column("doc_id"), batch.column("label"), rows], names=["doc_id", "label", "places"])


def fit(examples: list[tuple[np.ndarray, int]], epochs: int = EPOCHS, seed: int = 11) -> np.ndarray:
    """FTRL-proximal over (places, label) examples: weights of all 2**BITS places."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    rng = np.random.default_rng(seed)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        free = np.where(i == BIAS, 0.0, L1)
        return np.where(np.abs(zi) <= free, 0.0, -(zi - np.sign(zi) * free) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            at, label = examples[k]
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            grown = np.sqrt(n[at] + g * g)
            z[at] += g - (grown - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weights(np.arange(1 << BITS))


def _fit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for b in batches for r in zip(b.column("doc_id").to_pylist(), b.column("label").to_pylist(), b.column("places").to_pylist())]
    rows.sort()
    examples = [(np.append(np.frombuffer(p, "<u4").astype(np.int64), BIAS), y) for _, y, p in rows]
    w = fit(examples)
    at = np.flatnonzero(w)
    yield pa.record_batch([pa.array(at), pa.array(w[at])], names=["place", "weight"])


def labelled_sample(labels: DataFrame, label: str, folds: int, held_out: int, most: int) -> DataFrame:
    """At most `most` (doc_id, label) of the training folds: those of the smallest hashes, the same at every run."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold_bucket("doc_id", folds) != held_out))
    each = usable.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    return each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, held_out: int = 0, sample: int = SAMPLE_DOCS) -> list[tuple[int, float]]:
    """Non-zero weights (place, weight), at most 2**BITS. Reads the sampled rows' texts only; the fit runs in one task
    over at most `sample` documents. Without labelled rows the model is empty and all scores are 0.5."""
    some = F.broadcast(labelled_sample(labels, label, folds, held_out, sample))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(some, "doc_id")
    features = first_of_each(rows.mapInArrow(_feature_rows, "doc_id bigint, label int, places binary"), "doc_id")
    fitted = features.coalesce(1).mapInArrow(_fit_batches, "place bigint, weight double")
    return [(r["place"], r["weight"]) for r in fitted.collect()]


class Scorer:
    """Scores of texts by the non-zero weights."""

    def __init__(self, at: np.ndarray, values: np.ndarray):
        self.weights = np.zeros(1 << BITS)
        self.weights[at] = values
        self.bias, self.weights[BIAS] = self.weights[BIAS], 0.0

    def __call__(self, texts: pa.Array) -> np.ndarray:
        docs, found = places(Scan(texts))
        some = self.weights[found] != 0
        both = np.unique(docs[some] << BITS | found[some])
        total = np.bincount(both >> BITS, weights=self.weights[both & ((1 << BITS) - 1)], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -35, 35)))


def _sent(spark: SparkSession, weights: list[tuple[int, float]]):
    """The non-zero weights as a broadcast; at most 2**BITS of them."""
    return spark.sparkContext.broadcast((np.array([p for p, _ in weights], np.int64), np.array([w for _, w in weights], np.float64)))


def _score_rows(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value)
        for batch in sliced(batches, "text"):
            yield pa.record_batch([batch.column("doc_id"), pa.array(scorer(batch.column("text")))], names=["doc_id", "score"])

    return run


def _clean_rows(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value)
        for batch in sliced(batches, "text"):
            yield batch.filter(pa.array(scorer(batch.column("text")) < 0.5))

    return run


def keep_clean(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = 0) -> DataFrame:
    """The rows of docs not predicted toxic, with the columns of docs, whatever their names. Rows with null and empty texts
    have the score of no features, repeated rows and null ids are judged each by their text; an empty table stays empty."""
    model = _sent(docs.sparkSession, train(train_docs, labels, "toxic", folds, held_out))
    return docs.mapInArrow(_clean_rows(model), docs.schema)


def toxicity(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Null and empty texts get the score of no features. Repeated rows each get theirs; a null doc_id belongs to the fold
    of the empty text and is never trained on. Labels besides 0 and 1 are ignored, of unequal labels for one doc_id the
    larger counts. Texts of any length are read whole; an empty table gives an empty result. Columns besides doc_id and text
    are ignored.
    """
    model = _sent(docs.sparkSession, train(train_docs, labels, "toxic", folds, held_out))
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = ids.mapInArrow(_score_rows(model), "doc_id bigint, score double")
    fold = fold_bucket("doc_id", folds) == held_out
    return scored.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, docs, table(spark, sf_dir, "labels"))
