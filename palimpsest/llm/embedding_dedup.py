"""Embedding near-dedup by Euclidean p-stable hashing.

Equal vectors of a label are one class. A class's normalised vector is projected on Gaussian directions; each table
quantises `projections` of them, floor((a.x + b) / width), to a bucket. Members of a bucket are compared by exact cosine
in double precision. A pair that meets in several tables counts in the first one only, so link counts need no pairs to
be stored. A bucket of many classes is cut into blocks, and pairs of blocks are compared in separate groups; a group
returns link counts and a spanning forest of its links, not its pairs.

The number of projections grows with the logarithm of the largest label's classes, so that unlike vectors seldom meet,
and the number of tables with it, so that a pair at the threshold is missed with a chance of `miss` at any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, materialize, parts_for, scratch, table

THRESHOLD = 0.93
WIDTH = 1.5
MISS = 0.02
UNLIKE = 0.3  # cosine of vectors that should seldom meet
BLOCK = 512
_SMALL = 48
_SEED = 7_919


def collision(cosine: float, width: float = WIDTH) -> float:
    """Chance that one quantised projection is equal for unit vectors at this cosine."""
    d = math.sqrt(max(2 - 2 * cosine, 1e-12))
    r = width / d
    inside = math.erf(r / math.sqrt(2))
    return inside - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(classes: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(projections a table, tables) for so many classes in the largest label."""
    k = max(6, math.ceil(math.log(max(classes, 2)) / -math.log(collision(UNLIKE))))
    return k, max(1, math.ceil(math.log(miss) / math.log(1 - collision(threshold) ** k)))


@lru_cache(maxsize=8)
def _directions(dim: int, projections: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([_SEED, dim])
    a = rng.standard_normal((dim, projections * tables))
    b = rng.random(projections * tables) * WIDTH
    mix = rng.integers(1, 1 << 62, (tables, projections), dtype=np.int64) | 1
    return a, b, mix


def unit_vectors(v: np.ndarray) -> np.ndarray:
    """Each row over its length; first over its largest component, as squares of very large or small ones overflow."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def buckets(unit: np.ndarray, projections: int, tables: int) -> np.ndarray:
    """(vectors, tables) int64 bucket keys of unit vectors."""
    a, b, mix = _directions(unit.shape[1], projections, tables)
    # Rounded, so that a product of other rows beside a vector, which may differ in its last bits, gives the same cell.
    cells = np.floor(np.round((unit @ a + b) / WIDTH, 9)).astype(np.int64).reshape(len(unit), tables, projections)
    with np.errstate(over="ignore"):
        keys = (cells * mix).sum(axis=2) + np.arange(tables) * np.int64(0x632BE59BD9B4E019 - (1 << 62))
        keys ^= keys >> 29
        return keys * np.int64(0x3C79AC492BA7B653)


def _hashed(projections: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            dims = np.array([len(v) for v in vectors], np.int64)
            keys = np.zeros((len(vectors), tables), np.int64)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                keys[rows] = buckets(unit_vectors(np.array([vectors[i] for i in rows], np.float64)), projections, tables)
            flat = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, tables, dtype=np.int32), pa.array(keys.ravel()))
            yield pa.record_batch([batch.column("rep"), flat], names=["rep", "keys"])

    return run


def _forest(linked: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each, for a symmetric link matrix."""
    n = len(linked)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1, initial=n))
        new = new[new]
        if (new == label).all():
            return label
        label = new


class _Group:
    """Rows that share a bucket and a pair of blocks, as arrays."""

    def __init__(self, batch: pa.RecordBatch, projections: int, tables: int):
        self.rep = np.asarray(batch.column("rep"))
        self.n = np.asarray(batch.column("n"))
        self.side = np.asarray(batch.column("side"))
        self.nth = np.asarray(batch.column("nth"))
        v = np.asarray(batch.column("vector").flatten()).astype(np.float64).reshape(batch.num_rows, -1)
        self.unit = unit_vectors(v)
        # Keys are cheaper to make again than to send with every row.
        self.keys = buckets(self.unit, projections, tables)
        cells = [np.asarray(batch.column(c)) for c in ("bucket", "one", "two")]
        self.starts = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cells], axis=0)]))
        self.ends = np.append(self.starts[1:], batch.num_rows)

    def first_meeting(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs meet in no earlier table."""
        alive = np.ones(len(i), bool)
        left = np.arange(len(i))
        for t in range(int(self.nth[i].max(initial=0))):
            left = left[alive[left] & (self.nth[i[left]] > t)]
            if not len(left):
                break
            alive[left] &= self.keys[i[left], t] != self.keys[j[left], t]
        return alive


def _compare(threshold: float, projections: int, tables: int):
    """Sorted rows to (kind, a, b): kind 0, class a links b vectors more; kind 1, classes a and b are connected."""

    def compared(batch: pa.RecordBatch) -> pa.RecordBatch:
        g = _Group(batch, projections, tables)
        sizes = g.ends - g.starts
        found_i, found_j, edges = [], [], []
        small = np.repeat((sizes <= _SMALL), sizes)
        group = np.repeat(np.arange(len(sizes)), sizes)
        for step in range(1, _SMALL):
            i = np.flatnonzero(small[:-step] & (group[:-step] == group[step:])) if step < len(small) else []
            if not len(i):
                break
            two = np.asarray(batch.column("one"))[i] != np.asarray(batch.column("two"))[i]
            i = i[~two | (g.side[i] != g.side[i + step])]
            near = np.einsum("ij,ij->i", g.unit[i], g.unit[i + step]) >= threshold
            found_i.append(i[near])
            found_j.append(i[near] + step)
        for s, e in zip(g.starts[sizes > _SMALL], g.ends[sizes > _SMALL]):
            near = g.unit[s:e] @ g.unit[s:e].T >= threshold
            np.fill_diagonal(near, False)
            if batch.column("one")[int(s)].as_py() != batch.column("two")[int(s)].as_py():
                near &= g.side[s:e, None] != g.side[None, s:e]
            if near.any():
                root = _forest(near)
                moved = np.flatnonzero(root != np.arange(e - s))
                edges.append((g.rep[s:e][moved], g.rep[s:e][root[moved]]))
                i, j = np.nonzero(np.triu(near))
                keep = g.first_meeting(i + s, j + s)
                edges.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
                found_i.append(-1 - (i[keep] + s))  # negative: its edges are in the forest
                found_j.append(j[keep] + s)
        i = np.concatenate([np.zeros(0, np.int64), *found_i])
        j = np.concatenate([np.zeros(0, np.int64), *found_j])
        pairwise = i >= 0
        edges.append((g.rep[i[pairwise]], g.rep[j[pairwise]]))
        keep = ~pairwise
        keep[pairwise] = g.first_meeting(i[pairwise], j[pairwise])
        i = np.where(i < 0, -1 - i, i)[keep]
        j = j[keep]
        who, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        more = np.bincount(at, weights=g.n[np.concatenate([j, i])], minlength=len(who)).astype(np.int64)
        a = np.concatenate([g.rep[who], *(x for x, _ in edges)])
        b = np.concatenate([more, *(y for _, y in edges)])
        kind = np.concatenate([np.zeros(len(who), np.int64), np.ones(len(a) - len(who), np.int64)])
        return pa.record_batch([pa.array(kind), pa.array(a), pa.array(b)], names=["kind", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            last = whole.slice(whole.num_rows - 1)
            same = np.ones(whole.num_rows, bool)
            for c in ("bucket", "one", "two"):
                same &= np.asarray(whole.column(c)) == last.column(c)[0].as_py()
            cut = whole.num_rows - int(same.sum())
            held = whole.slice(cut)
            if cut:
                yield from (compared(x) for x in _pieces(whole.slice(0, cut)))
        if held is not None:
            yield from (compared(x) for x in _pieces(held))

    def _pieces(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """One dimension at a time, as vectors of a piece form a matrix."""
        rows = rows.combine_chunks()
        dims = np.asarray(rows.column("dim"))
        for dim in np.unique(dims):
            yield from rows.filter(pa.array(dims == dim)).combine_chunks().to_batches()

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label).

    A row that has a null vec_id, label or embedding, an empty or zero vector or a null or non-finite component links
    with nothing (its component is its own vec_id). Vectors of unequal length never link. Repeated rows are vectors of
    their own that link with one another. Vectors of doubles are compared as such, all others as floats. An empty table
    gives an empty result; other columns are ignored.
    """
    kind = "array<double>" if vectors.schema["embedding"].dataType.simpleString() == "array<double>" else "array<float>"
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(kind).alias("vector"), F.col("label").cast("bigint").alias("label"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & sound & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    whole = rows.where("usable")
    keep: list[DataFrame] = []
    with scratch(keep=keep):
        classes = materialize(whole.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vec-classes")
        most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
        projections, tables = plan(most, threshold, miss)
        kinds = "rep bigint, keys array<bigint>"
        hashed = materialize(classes.select("rep", "vector").mapInArrow(_hashed(projections, tables), kinds), "vec-keys")
        # A bucket is a table's key within a label and a vector length.
        named = hashed.join(classes.select("rep", "label", F.size("vector").alias("dim")), "rep")
        bucket: Column = F.xxhash64("label", "dim", "nth", "key")
        lines = materialize(named.select("rep", "label", "dim", F.posexplode("keys").alias("nth", "key")).select("rep", "nth", bucket.alias("bucket")), "vec-lines")
        shared = lines.groupBy("bucket").count().where("count > 1").select("bucket", F.ceil(F.col("count") / block).alias("blocks"))
        shared = materialize(shared, "vec-shared")
        own = F.pmod(F.xxhash64("rep"), F.col("blocks"))
        met = lines.join(shared, "bucket").withColumn("own", own)
        pairs = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")
        met = met.select("rep", "nth", "bucket", "own", pairs)
        met = met.select("rep", "nth", "bucket", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))
        full = met.join(classes.select("rep", "n", "vector", F.size("vector").alias("dim")), "rep")
        parts = parts_for(vectors.sparkSession, lines._stored_at)
        order = ["bucket", "one", "two"]
        compared = full.repartition(parts, *order).sortWithinPartitions(*order).mapInArrow(_compare(threshold, projections, tables), "kind bigint, a bigint, b bigint")
        compared = materialize(compared, "vec-compared")
        counts = compared.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("more"))
        edges = compared.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v"))
        labels = connected_components(edges).withColumnRenamed("node", "rep")
        known = classes.join(counts, "rep", "left").join(labels, "rep", "left")
        known = known.select("label", "vector", F.coalesce("component", "rep").alias("component_id"), (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
        known = materialize(known, "vec-known")
        keep.append(known)
    linked = whole.join(known, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
