"""Packing along a space-filling curve.

A document's ids are counted into a hashed vector, damped by a logarithm, normalised and projected to four dimensions.
The Hilbert key of the projected point orders the documents, so that neighbours on the curve have like contents. The
documents are range-sorted by that key and laid end to end in each range, and the line is cut every `max_tokens`. What
is left at the end of a range is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, parts_for, sliced, table
from .tokens import encoder, id_bytes, ids_from, tokenizer_path

MAX_TOKENS = 1024
END_ID = 0
HASHED = 256
DIMENSIONS = 4
LEVELS = 12
_SEED = 20240229


@lru_cache(maxsize=1)
def _projection() -> np.ndarray:
    return np.random.default_rng(_SEED).standard_normal((HASHED, DIMENSIONS)).astype(np.float32)


def project(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Points in the unit cube, one for each document; documents without ids lie in its middle."""
    out = np.zeros((len(offsets) - 1, DIMENSIONS), np.float32)
    slots = ((ids.astype(np.uint64) * np.uint64(0x9E3779B1)) >> np.uint64(13)).astype(np.int64) % HASHED
    for at in range(0, len(out), 512):
        off = offsets[at : at + 513]
        rows = np.repeat(np.arange(len(off) - 1), np.diff(off)) * HASHED
        counts = np.bincount(rows + slots[off[0] : off[-1]], minlength=(len(off) - 1) * HASHED)
        v = np.log1p(counts.reshape(-1, HASHED)).astype(np.float32)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        out[at : at + 512] = (v / np.where(norm > 0, norm, 1)) @ _projection()
    return 0.5 + np.arctan(2 * out) / np.pi


def hilbert_keys(points: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    """Hilbert index of each point of the unit cube, `levels` bits a dimension (Skilling's transpose method)."""
    n, dims = points.shape
    x = np.clip((points * (1 << levels)).astype(np.int64), 0, (1 << levels) - 1).T.copy()
    q = 1 << (levels - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros(n, np.int64)
    q = 1 << (levels - 1)
    while q > 1:
        t ^= np.where((x[dims - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros(n, np.int64)
    for bit in range(levels - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


_TOKENS = "doc_id bigint, curve bigint, spread bigint, ids binary"


def _encoded(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        task, row = TaskContext.get().partitionId() << 36, 0
        for batch in sliced(batches, "text", 3 << 20):
            ids, off = enc.encode(batch.column("text"))
            curve = hilbert_keys(project(ids, off))
            ids = np.insert(ids, off[1:], end_id)
            off = off + np.arange(len(off))
            data = [id_bytes(ids[a:b]) for a, b in zip(off[:-1], off[1:])]
            spread = pa.array(task + row + np.arange(batch.num_rows))
            row += batch.num_rows
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(curve), spread, pa.array(data, pa.binary())],
                names=["doc_id", "curve", "spread", "ids"],
            )

    return run


_PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids_crc32 bigint"


def _packed(max_tokens: int, with_ids: bool):
    """Sorted documents of one range to pieces. Holds one document and the pieces of one open sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        filled = 0
        waiting: list[tuple] = []  # pieces of the open sequence: doc_id, start, doc_tokens, ids
        rows: list[tuple] = []

        def close(pieces: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for doc_id, start, whole, ids in pieces:
                row = (doc_id, start, len(ids), whole, sequence, offset, zlib.crc32(ids.tobytes()))
                rows.append((*row, id_bytes(ids)) if with_ids else row)
                offset += len(ids)
            sequence += 1

        def out() -> pa.RecordBatch:
            names = [x.split()[0] for x in _PIECES.split(", ")] + ["ids"] * with_ids
            cols = list(zip(*rows)) or [()] * len(names)
            batch = pa.record_batch([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for c, n in zip(cols, names)], names=names)
            rows.clear()
            return batch

        for batch in sliced(batches, "ids"):
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                ids = ids_from(data)
                at = 0
                while at < len(ids):
                    part = ids[at : at + max_tokens - filled]
                    waiting.append((doc_id, at, len(ids), part))
                    filled += len(part)
                    at += len(part)
                    if filled == max_tokens:
                        close(waiting)
                        waiting, filled = [], 0
                if len(rows) >= 4096:
                    yield out()
        for bit in range(filled.bit_length() - 1, -1, -1):
            room = filled & (1 << bit)
            pieces = []
            while room:
                doc_id, start, whole, ids = waiting.pop(0)
                pieces.append((doc_id, start, whole, ids[:room]))
                if len(ids) > room:
                    waiting.insert(0, (doc_id, start + room, whole, ids[room:]))
                room -= min(room, len(ids))
            if pieces:
                close(pieces)
        yield out()

    return run


def pack(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pieces of packed sequences: doc_id, start, length, doc_tokens, sequence_id, offset, ids_crc32 (of the ids as
    little-endian 32-bit integers) and, if with_ids, ids (binary, as id_bytes makes it).

    Every row of docs is encoded whole (null text: empty) and ends with end_id; each of its ids lies in exactly one
    piece. Repeated rows are packed each for itself, null doc_ids too; sequence ids are unique but not gapless; an
    empty table has no pieces. Long texts are encoded whole. Only doc_id and text are read. A range holds documents next to one another on the curve;
    equal keys (copies) are spread over ranges by doc_id and then by input place, so none grows with its copies.
    """
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    encoded = materialize(ids.mapInArrow(_encoded(tokenizer, end_id), _TOKENS), "pack-ids")
    order = ["curve", "doc_id", "spread"]
    line = encoded.repartitionByRange(parts_for(docs.sparkSession, encoded._stored_at), *order).sortWithinPartitions(*order).select("doc_id", "ids")
    return line.mapInArrow(_packed(max_tokens, with_ids), _PIECES + ", ids binary" * with_ids)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(docs, tokenizer_path("byte_bpe_50k.json"), with_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
