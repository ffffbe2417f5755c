"""SimHash near-dedup by multi-index hashing.

A fingerprint (64 bits, majority vote over the XXH64 of word shingles) is cut into two 32-bit segments. If two
fingerprints differ in at most 2 bits, they differ in at most 1 bit within some segment. So every fingerprint is stored
in one table per segment, every fingerprint enumerates the 33 values of the Hamming ball of radius 1 in each segment,
fetches the table's matches and verifies the whole distance.

Table buckets that hold more than `bucket_cap` different fingerprints would give quadratically many candidates. All
fingerprints whose probes reach such a bucket are instead linked exactly through whole-width neighbours: two
fingerprints at distance <= 2 always share a value at distance <= 1 from both, and at most 65 fingerprints can share
one, all within distance 2 of each other. Such a group needs no verification and stays small whatever the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, materialize, scratch, shuffled, sift, sliced, table, unused

SHINGLE_WORDS = 3
SEED = 42
MAX_DISTANCE = 2
BUCKET_CAP = 64
_STEP = 1 << 17


def shingle_hashes(text: bytes, words: int = SHINGLE_WORDS, seed: int = SEED) -> list[int]:
    """XXH64 of each word shingle; bytes.lower and bytes.split treat exactly A-Z and x20, x09-x0D."""
    w = text.lower().split()
    if not w:
        return []
    joined = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    return list(map(partial(xxhash.xxh64_intdigest, seed=seed), joined))


def vote(hashes: np.ndarray) -> int:
    """Fingerprint of the hashes: a bit is 1 if it is set in over half of them."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        part = hashes[at : at + _STEP]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(texts: list[bytes | None]) -> np.ndarray:
    """uint64 fingerprints; null, empty and white texts have 0."""
    out = np.zeros(len(texts), np.uint64)
    group: list[list[int]] = []
    rows: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if rows:
            h = np.fromiter(chain.from_iterable(group), np.uint64, held)
            sizes = np.array([len(x) for x in group])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
            out[rows] = np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        group.clear()
        rows.clear()
        held = 0

    for i, text in enumerate(texts):
        if not text:
            continue
        h = shingle_hashes(text)
        if len(h) > _STEP:
            out[i] = vote(np.array(h, np.uint64))
        elif h:
            group.append(h)
            rows.append(i)
            held += len(h)
            if held > _STEP:
                flush()
    flush()
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        fp = fingerprints(batch.column("text").cast(pa.binary()).to_pylist())
        yield pa.record_batch([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp bigint) of every row of docs; reads only doc_id and text."""
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ids.mapInArrow(_fingerprint_batches, "doc_id bigint, fp bigint")


def _segment(fp: F.Column, k: int) -> F.Column:
    part = fp.bitwiseAND(F.lit(0xFFFFFFFF)) if k == 0 else F.shiftrightunsigned(fp, 32)
    return part + F.lit(k << 32)


def _flips(bits: int) -> list[int]:
    return [0] + [1 << j if j < 63 else -(1 << 63) for j in range(bits)]


def links(distinct: DataFrame, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """Edges (u, v) that connect the rows of distinct (rep bigint, fp bigint; fp unique) whose fingerprints are within
    2 bits, directly or through others. Few edges per row: a large group yields no pairs of all its members."""
    fp = F.col("fp")
    stored = distinct.select("rep", "fp", F.explode(F.array(_segment(fp, 0), _segment(fp, 1))).alias("cell"))
    flips = F.explode(F.array(*(F.lit(m).cast("bigint") for m in _flips(32)))).alias("flip")
    probes = stored.select("rep", "fp", "cell", flips).select("rep", "fp", F.col("cell").bitwiseXOR(F.col("flip")).alias("cell"))
    hot = materialize(stored.groupBy("cell").count().where(F.col("count") > bucket_cap).select("cell"), "simhash-hot")
    crowded = not hot.isEmpty()
    tables = stored
    if crowded:
        # Cells that may be hot, by one filter for both sides: a pair that meets in one of them is in reached, any other is found.
        tables = sift(stored, hot, "cell")[1]
        perhaps, probes = sift(probes, hot, "cell")
    a = tables.select(F.col("rep").alias("v"), F.col("fp").alias("fp_v"), "cell")
    b = probes.select(F.col("rep").alias("u"), F.col("fp").alias("fp_u"), "cell")
    near = (F.col("fp_v") < F.col("fp_u")) & (F.bit_count(F.col("fp_u").bitwiseXOR(F.col("fp_v"))) <= MAX_DISTANCE)
    found = b.join(shuffled(a), "cell").where(near).select("u", "v")
    if not crowded:
        return found
    reached = materialize(perhaps.select("rep", "fp").distinct(), "simhash-reached")
    ball = F.explode(F.array(*(F.lit(m).cast("bigint") for m in _flips(64)))).alias("flip")
    shared = reached.select("rep", "fp", ball).groupBy(fp.bitwiseXOR(F.col("flip")).alias("z"))
    groups = shared.agg(F.collect_list("rep").alias("reps")).where(F.size("reps") > 1)
    star = groups.select(F.array_min("reps").alias("v"), F.explode("reps").alias("u"))
    return found.union(star.where("u <> v").select("u", "v").distinct())


def near_duplicates(docs: DataFrame, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    Equal fingerprints and fingerprints at 2 bits or fewer link; component_id is the smallest doc_id reachable. Null,
    empty and white texts share the fingerprint 0 and link like any other. Repeated rows are kept, one result each. A
    null doc_id gets its fingerprint's component, but a fingerprint that only null ids have links with nothing and has
    a null component. Texts of any length are taken whole. An empty table gives an empty result; other columns of docs are
    ignored.
    """
    keep: list[DataFrame] = []
    with scratch(keep=keep):
        prints = materialize(with_fingerprints(docs), "simhash-prints")
        distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
        labels = connected_components(links(distinct.where(F.col("rep").isNotNull()), bucket_cap))
        named = distinct.join(shuffled(labels.withColumnRenamed("node", "rep")), "rep", "left")
        named = materialize(named.select("fp", F.coalesce("component", "rep").alias("component_id")), "simhash-named")
        keep += [prints, named]
    return prints.join(shuffled(named), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, groups: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """The rows of docs that stay when each near-duplicate group keeps exactly one row: the one of the smallest doc_id,
    null ids last, then of the smallest text hash. Columns as in docs. groups gives (doc_id, component_id) of documents.

    Rows are numbered in a stored table and grouped by that number, so that null ids link like any other and rows that
    share a doc_id but not their texts are different documents. Null, empty and long texts follow groups; an empty table
    gives an empty result; column names of docs cannot clash. Only rows that may have to go are shuffled with their texts."""
    row = unused("row", docs)
    keep: list[DataFrame] = []
    with scratch(keep=keep):
        rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "simhash-rows")
        named = groups(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
        doc_id = F.col("doc_id").cast("bigint")
        rank = F.struct(doc_id.isNull(), doc_id, F.xxhash64("text"), F.col(row).alias("row")).alias("rank")
        ranks = materialize(rows.select(row, rank).join(shuffled(named), row).select(row, "component_id", "rank"), "simhash-ranks")
        first = ranks.groupBy("component_id").agg(F.count("*").alias("members"), F.min("rank").alias("rank"))
        shared = first.where("members > 1").select("component_id", F.col("rank.row").alias("stays"))
        lost = ranks.select(row, "component_id").join(shuffled(shared), "component_id").where(F.col(row) != F.col("stays")).select(row)
        lost = materialize(lost, "simhash-lost")
        keep += [rows, lost]
    perhaps, others = sift(rows, lost, row)
    return others.union(perhaps.join(shuffled(lost), row, "left_anti").select(*rows.columns)).select(*docs.columns)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
