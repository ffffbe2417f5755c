"""Quality by a linear-chain conditional random field over lines.

Every line of a text with a visible character is labelled good or bad. A line's potential sums weights of its own
binned features and of those of the lines before and after it; a transition matrix ties neighbouring labels. In
training, each line of a labelled document carries the document's label. The forward-backward marginals of a text's
lines, weighted by their lengths, are its share of good text; a logistic curve fitted on the same sample turns the
share into the document's score.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import first_of_each, fitted, fold_bucket, sliced, table
from .textscan import Scan, mixed
from .toxicity import labelled_sample

SAMPLE_DOCS = 6_000
FOLDS, HELD_OUT = 3, 1
BINS = 8
STEPS = 160
_RATE, _RIDGE = 0.08, 2e-5
_MOST = 30.0

FEATURES = (
    "log bytes", "log words", "upper-case letters", "digits", "sentence marks", "other marks", "exclamation marks", "bars",
    "non-ASCII bytes", "bytes a word", "words equal to the one before", "word pairs seen before in the text",
    "line seen before in the text", "ends with a full stop", "begins in upper case",
)


def _classes() -> list[np.ndarray]:
    """Byte classes that are counted for each line."""
    out = []
    for chars in (bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b".,;:'\"()-", b"#$%&*+/<=>?@[\\]^_`{}~", b"!", b"|", bytes(range(128, 256))):
        one = np.zeros(256, np.int8)
        one[list(chars)] = 1
        out.append(one)
    return out


def lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features (lines, FEATURES) float32, bytes of each line, n+1 offsets of the texts' lines)."""
    scan = Scan(texts)
    buf, off = scan.buf, scan.off
    n_docs = len(off) - 1
    breaks = np.flatnonzero(buf == 10)
    starts = np.unique(np.concatenate([off[:-1], breaks + 1]))
    starts = starts[starts < len(buf)]
    ends = np.append(starts[1:], len(buf))
    visible = np.zeros(len(buf) + 1, np.int32)
    np.cumsum((buf > 32) & (buf != 127), out=visible[1:])
    some = visible[ends] > visible[starts]
    starts, ends = starts[some], ends[some]
    line_off = np.searchsorted(starts, off)
    k = len(starts)
    if not k:
        return np.zeros((0, len(FEATURES)), np.float32), np.zeros(0, np.int64), line_off
    size = visible[ends] - visible[starts]
    counts = []
    total = np.zeros(len(buf) + 1, np.int32)
    for one in _classes():
        np.cumsum(one[buf], out=total[1:])
        counts.append(total[ends] - total[starts])
    upper, lower, digit, stops, marks, cries, bars, wide = counts
    word_at = np.searchsorted(scan.starts, starts)
    word_to = np.append(word_at[1:], len(scan.starts))
    words = word_to - word_at
    h = scan.hashes()[0] if len(scan.starts) else np.zeros(0, np.uint64)
    line_of = np.repeat(np.arange(k), words)
    again, seen = np.zeros(k), np.zeros(k)
    if len(h) > 1:
        same = line_of[1:] == line_of[:-1]
        again = np.bincount(line_of[1:][same & (h[1:] == h[:-1])], minlength=k)
        with np.errstate(over="ignore"):
            pair = mixed(h[:-1] * np.uint64(31) + h[1:] + scan.doc[1:].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(pair, kind="stable")
        order = order[scan.doc[order + 1] == scan.doc[order]]  # no pair reaches into another text
        old = np.zeros(len(pair), bool)
        old[order[1:]] = pair[order[1:]] == pair[order[:-1]]
        seen = np.bincount(line_of[1:][old & same], minlength=k)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * (np.arange(len(h), dtype=np.uint64) - np.repeat(word_at, words).astype(np.uint64) + np.uint64(1)), out=sums[1:])
        doc_of = np.searchsorted(off, starts, side="right") - 1
        whole = mixed(sums[word_to] - sums[word_at] + size.astype(np.uint64)) ^ mixed(doc_of.astype(np.uint64) + np.uint64(77))
    order = np.argsort(whole, kind="stable")
    twin = np.zeros(k, bool)
    twin[order[1:]] = whole[order[1:]] == whole[order[:-1]]
    last = ends - 1 - (buf[ends - 1] == 10) * (ends - 1 > starts)
    one_or = np.maximum(words, 1)
    f = np.stack([
        np.log1p(size), np.log1p(words), upper / np.maximum(upper + lower, 1), digit / size, stops / one_or, marks / one_or,
        cries / one_or, bars / one_or, wide / size, size / one_or, again / one_or, seen / one_or, twin,
        np.isin(buf[last], list(b".?!")), (buf[starts] >= 65) & (buf[starts] <= 90),
    ], axis=1).astype(np.float32)
    assert len(line_off) == n_docs + 1
    return f, size.astype(np.int64), line_off


class Model:
    """edges: bin edges of each feature; weights (3, features, bins): own, previous and next line's; outside (2,): at the
    text's begin and end; moves (2, 2): transition scores; first: score of a good first line; curve: (slope, shift)."""

    NAMES = ("edges", "weights", "outside", "moves", "first", "curve", "base")

    def __init__(self, **parts: np.ndarray):
        self.__dict__.update(parts)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{n: getattr(self, n) for n in self.NAMES})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Model:
        with np.load(io.BytesIO(data)) as got:
            return cls(**{n: got[n] for n in cls.NAMES})

    @classmethod
    def empty(cls) -> Model:
        n = len(FEATURES)
        return cls(edges=np.zeros((n, BINS - 1)), weights=np.zeros((3, n, BINS)), outside=np.zeros(2), moves=np.zeros((2, 2)), first=np.zeros(1), curve=np.array([1.0, 0.0]), base=np.array([0.5]))

    def bins(self, f: np.ndarray) -> np.ndarray:
        out = np.empty(f.shape, np.int64)
        for k in range(f.shape[1]):
            out[:, k] = np.searchsorted(self.edges[k], f[:, k], side="right")
        return out

    def potentials(self, bins: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Score of good over bad of each line, from itself and its neighbours."""
        at = np.arange(bins.shape[1])
        own, before, after = (w[at, bins].sum(axis=1) for w in self.weights)
        out = own
        out[1:] += before[:-1]
        out[:-1] += after[1:]
        some = off[1:] > off[:-1]
        first, last = off[:-1][some], off[1:][some] - 1
        inner = first[first > 0]
        out[inner] -= before[inner - 1]
        closing = last[last < len(out) - 1]
        out[closing] -= after[closing + 1]
        out[first] += self.outside[0]
        out[last] += self.outside[1]
        return np.clip(out, -_MOST, _MOST)

    def marginals(self, scores: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chance that each line is good, expected counts of label pairs), all texts in step."""
        size = np.diff(off)
        order = np.argsort(-size, kind="stable")
        start, size = off[:-1][order], size[order]
        steps = int(size.max(initial=0))
        active = np.searchsorted(-size, -np.arange(steps), side="left")
        good = np.exp(scores / 2)
        e = np.stack([1 / good, good], axis=1)
        move = np.exp(self.moves)
        a, b = np.empty_like(e), np.ones_like(e)
        for t in range(steps):
            i = start[: active[t]] + t
            x = e[i] * (a[i - 1] @ move) if t else e[i] * np.exp([0.0, float(self.first[0])])
            a[i] = x / x.sum(axis=1, keepdims=True)
        pairs = np.zeros((2, 2))
        for t in range(steps - 1, 0, -1):
            i = start[: active[t]] + t
            back = e[i] * b[i]
            x = back @ move.T
            b[i - 1] = x / x.sum(axis=1, keepdims=True)
            joint = a[i - 1][:, :, None] * move * back[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        p = a * b
        return p[:, 1] / p.sum(axis=1), pairs

    def shares(self, f: np.ndarray, size: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Length-weighted share of good text; texts without lines have the sample's share of good documents."""
        if not len(f):
            return np.full(len(off) - 1, float(self.base[0]))
        p, _ = self.marginals(self.potentials(self.bins(f), off), off)
        sums = np.zeros((2, len(f) + 1))
        np.cumsum(p * size, out=sums[0, 1:])
        np.cumsum(size, out=sums[1, 1:])
        part, whole = sums[:, off[1:]] - sums[:, off[:-1]]
        return np.where(whole > 0, part / np.maximum(whole, 1), float(self.base[0]))

    def scores(self, f: np.ndarray, size: np.ndarray, off: np.ndarray) -> np.ndarray:
        return _curve(self.shares(f, size, off), self.curve)


def _logit(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 1e-6, 1 - 1e-6)
    return np.log(share / (1 - share))


def _curve(share: np.ndarray, curve: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(curve[0] * _logit(share) + curve[1])))


def fit(f: np.ndarray, size: np.ndarray, off: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> Model:
    """Maximise the conditional likelihood of the lines' labels (Adam on the whole sample), then fit the curve."""
    model = Model.empty()
    if not len(labels):
        return model
    model.base = np.array([np.clip(labels.mean(), 0.01, 0.99)])
    if not len(f) or labels.min() == labels.max():
        model.curve = np.array([0.0, float(_logit(model.base)[0])])
        return model
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    model.edges = np.stack([np.quantile(f[:, k][f[:, k] > f[:, k].min()], quantiles) if np.ptp(f[:, k]) else np.full(BINS - 1, np.inf) for k in range(f.shape[1])])
    bins = model.bins(f)
    counts = np.diff(off)
    y = np.repeat(labels, counts).astype(float)
    some = counts > 0
    first, last = off[:-1][some], off[1:][some] - 1
    has_before = np.ones(len(f), bool)
    has_before[first] = False
    before = np.flatnonzero(has_before)
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = (counts[some & (labels == label)] - 1).sum()
    parts = ["weights", "outside", "moves", "first"]
    slow = {n: np.zeros_like(getattr(model, n)) for n in parts}
    scale = {n: np.zeros_like(getattr(model, n)) for n in parts}
    # Each document counts alike in the gradient, whatever its number of lines.
    share = np.repeat(1 / np.maximum(counts, 1), counts)
    docs = int(some.sum())
    for step in range(1, steps + 1):
        p, pairs = model.marginals(model.potentials(bins, off), off)
        r = (y - p) * share
        g = {n: np.zeros_like(getattr(model, n)) for n in parts}
        for k in range(f.shape[1]):
            g["weights"][0, k] = np.bincount(bins[:, k], weights=r, minlength=BINS)
            g["weights"][1, k] = np.bincount(bins[before - 1, k], weights=r[before], minlength=BINS)
            g["weights"][2, k] = np.bincount(bins[before, k], weights=r[before - 1], minlength=BINS)
        g["outside"][:] = r[first].sum(), r[last].sum()
        g["moves"] = (seen - pairs) / max(len(f) / docs, 1)
        g["first"][:] = (y - p)[first].sum() / max(len(f) / docs, 1)
        for n in parts:
            grad = g[n] / docs - _RIDGE * getattr(model, n)
            slow[n] = 0.9 * slow[n] + 0.1 * grad
            scale[n] = 0.99 * scale[n] + 0.01 * grad**2
            move = slow[n] / (1 - 0.9**step) / (np.sqrt(scale[n] / (1 - 0.99**step)) + 1e-8)
            setattr(model, n, getattr(model, n) + _RATE * (1 - 0.7 * step / steps) * move)
    x = np.stack([_logit(model.shares(f, size, off)), np.ones(len(labels))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curvature = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + 1e-3 * np.eye(2)
        w = w + np.linalg.solve(curvature, x.T @ (labels - p) - 1e-3 * (w - [1.0, 0.0]))
    model.curve = np.array([max(w[0], 1e-3), w[1]])
    return model


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text", 2 << 20):
        f, size, off = lines(batch.column("text"))
        data = [np.concatenate([f[a:b], size[a:b, None].astype(np.float32)], axis=1).tobytes() for a, b in zip(off[:-1], off[1:])]
        yield pa.record_batch([batch.column("doc_id"), batch.column("label"), pa.array(data, pa.binary())], names=["doc_id", "label", "lines"])


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for b in batches for r in zip(b.column("doc_id").to_pylist(), b.column("label").to_pylist(), b.column("lines").to_pylist())]
    rows.sort()
    parts = [np.frombuffer(x, np.float32).reshape(-1, len(FEATURES) + 1) for *_, x in rows]
    off = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
    whole = np.concatenate([np.zeros((0, len(FEATURES) + 1), np.float32), *parts])
    model = fit(whole[:, :-1], whole[:, -1].astype(np.int64), off, np.array([y for _, y, _ in rows], np.int64))
    yield pa.record_batch([pa.array([model.dump()], pa.binary())], names=["model"])


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, sample: int = SAMPLE_DOCS) -> bytes:
    """The fitted model. Line features are made on the executors, the fit runs in one task over at most `sample`
    labelled documents of the training folds. Without any the model is empty and all scores are 0.5."""
    some = F.broadcast(labelled_sample(labels, "quality", folds, held_out, sample))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(some, "doc_id")
    features = first_of_each(rows.mapInArrow(_line_rows, "doc_id bigint, label int, lines binary"), "doc_id")
    return fitted(features, _fit_rows)


def _score_rows(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Model.load(model.value)
        for batch in sliced(batches, "text"):
            score = crf.scores(*lines(batch.column("text")))
            yield pa.record_batch([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return run


def quality(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Texts without a visible character (null and empty ones too) get the score of the sample's share of good documents.
    Repeated rows each get their score; a null doc_id belongs to the fold of the empty text and is never trained on.
    Labels besides 0 and 1 are ignored, of unequal labels for one doc_id the larger counts. Texts of any length are read
    whole; an empty table gives an empty result. Columns besides doc_id and text are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(train_docs, labels, folds, held_out))
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = ids.mapInArrow(_score_rows(model), "doc_id bigint, score double")
    fold = fold_bucket("doc_id", folds) == held_out
    return scored.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _good_rows(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Model.load(model.value)
        for batch in sliced(batches, "text"):
            yield batch.filter(pa.array(crf.scores(*lines(batch.column("text"))) >= 0.5))

    return run


def keep_good(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """The rows of docs predicted good, with the columns of docs, whatever their names. Null and empty texts have the
    sample's share of good documents as score, repeated rows and null ids are judged each by their text; an empty table
    stays empty."""
    model = docs.sparkSession.sparkContext.broadcast(train(train_docs, labels, folds, held_out))
    return docs.mapInArrow(_good_rows(model), docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality(docs, docs, table(spark, sf_dir, "labels"))
