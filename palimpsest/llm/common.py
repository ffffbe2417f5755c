"""What the operators of this package share: tables, shared-folder materialisation, connected components."""

from __future__ import annotations

import ctypes
import functools
import math
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (local runs)."""
    conf = spark.sparkContext.getConf()
    if got := spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None):
        return got.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='palimpsest-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_open_scratch: list[list[DataFrame]] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path  # noqa: SLF001
    if _open_scratch:
        _open_scratch[-1].append(back)
    return back


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote; only for tables that no later plan reads. Deleting twice does nothing."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)  # noqa: SLF001
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)  # noqa: SLF001


@contextmanager
def scratch(*, keep: list[DataFrame]) -> Iterator[None]:
    """Tables that materialize() writes inside are deleted at the end, but for those that have been added to keep."""
    _open_scratch.append([])
    try:
        yield
    finally:
        for df in _open_scratch.pop():
            if not any(df is k for k in keep):
                discard(df)
            elif _open_scratch:
                _open_scratch[-1].append(df)


def shuffled(df: DataFrame) -> DataFrame:
    """df, so marked that a join with it shuffles and sorts both sides. The planner takes a stored table's size from its
    compressed files and doesn't count what explode() adds, so it would send tables of any number of rows through the driver."""
    return df.hint("merge")


FILTER_WORDS = 1 << 18


def sift(rows: DataFrame, some: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose bigint key may be in some, rows whose key is surely not), so that only the former need a shuffle.

    A Bloom filter of at most FILTER_WORDS words of 63 bits, three bits a key, is joined to the rows as a broadcast of
    that many rows at most. Its size does not grow with the data: where some has far more keys than it has bits, most
    rows count as possible, which costs a shuffle and changes no result. Null keys are surely not in some.
    """
    hashed = F.xxhash64(key)
    word = F.pmod(hashed, F.lit(FILTER_WORDS))
    bits = [F.pmod(F.shiftrightunsigned(hashed, s), F.lit(63)).cast("int") for s in (20, 32, 44)]
    mask = F.lit(0).cast("bigint")
    for b in bits:
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), b))
    words = some.where(F.col(key).isNotNull()).groupBy(word.alias("_word")).agg(F.bit_or(mask).alias("_mask"))
    at, own, bits_of = unused("at", rows), unused("word", rows), unused("mask", rows)
    marked = rows.withColumn(at, word).join(F.broadcast(words.toDF(own, bits_of)), F.col(at) == F.col(own), "left")
    maybe = F.coalesce(F.col(bits_of).bitwiseAND(mask) == mask, F.lit(False)) & F.col(key).isNotNull()
    return marked.where(maybe).select(*rows.columns), marked.where(~maybe).select(*rows.columns)


def unused(name: str, df: DataFrame) -> str:
    """A column name like name that df does not have; names differ in more than case."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (f"_{name}{k}" for k in range(len(taken) + 1)) if n not in taken)


PART_BYTES = 64 << 20


def parts_for(spark: SparkSession, path: str) -> int:
    """Partitions for a shuffle of the files in a folder, at PART_BYTES each, and not fewer than the session's number."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    size = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()  # noqa: SLF001
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PART_BYTES))


def fold_bucket(column: str | Column, modulus: int) -> Column:
    """crc32 of the column's decimal text, modulo modulus: the fold rule of the contracts. Null ids count as the text ''."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus


def fold_of(value, modulus: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % modulus


def binary_values(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A text or binary Arrow column as (uint8 buffer, int64 offsets of n+1); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    elif pa.types.is_large_string(column.type):
        column = column.view(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def text_array(buf: np.ndarray, off: np.ndarray) -> pa.Array:
    """Texts from their bytes and offsets, as an array of its own: some Arrow functions misread slices."""
    data = np.ascontiguousarray(buf)
    return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(data))


def sliced(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the named column holds about max_bytes in each (a single longer value stays whole)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64()))
        ends = np.cumsum(sizes)
        at = 0
        while at < n:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to


@contextmanager
def batches_of(spark: SparkSession, max_bytes: int) -> Iterator[None]:
    """Plans that run inside send rows to Python in Arrow batches of about so many bytes. A batch is held by the JVM, which
    doubles its buffers as they fill, and by the worker; Spark's own bound is 64 MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max_bytes))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tidied(run: Callable) -> Callable:
    """run, a function for mapInArrow, that gives what it has freed back to the system when it ends. Workers live on, and
    would else keep the most that any stage has held."""

    @functools.wraps(run)
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
                trim(0)

    return out


def first_of_each(examples: DataFrame, key: str) -> DataFrame:
    """One row of each key, the least by all other columns, so that reruns choose the same one."""
    others = [c for c in examples.columns if c != key]
    least = examples.groupBy(key).agg(F.min(F.struct(*others)).alias("least"))
    return least.select(key, *(F.col("least")[c].alias(c) for c in others))


def fitted(examples: DataFrame, fit) -> bytes:
    """What fit (batches to one batch of one binary) makes of a bounded number of rows, in one task."""
    row = examples.coalesce(1).mapInArrow(fit, "model binary").first()
    if row is None:  # a table without partitions runs no task
        return next(iter(fit(iter([])))).column(0)[0].as_py()
    return bytes(row[0])


def connected_components(edges: DataFrame, passes: list[int] | None = None) -> DataFrame:
    """Components of an undirected graph given as bigint edges (u, v): one row (node, component) per node that has an
    edge to another node; component is the smallest node of its component.

    Contraction: every node points to the smallest of itself and its neighbours; the pointers are followed to their
    ends, five times as far at each step; and the edges are rewritten through them until none is left. The smallest
    node of a component never moves, so it names the component. A node that stays has taken in a neighbour in this pass
    or moves in the next one, so two passes at least halve the nodes, and a chain of n pointers needs log5(n) steps.
    Tables between the steps are written to the shared folder, so all joins read plain exchanges, which adaptive
    execution can split when a component is very large. passes, if given, receives the number of steps of each pass.
    """
    columns = [F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")]
    keep: list[DataFrame] = []
    with scratch(keep=keep):
        edges = materialize(edges.select(*columns).where("u > v").distinct(), "cc-edges")
        levels: list[DataFrame] = []
        while not edges.isEmpty():
            both = edges.select("u", "v").union(edges.select("v", "u"))
            near = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
            point = materialize(near.select("node", F.least("node", "m").alias("parent")), "cc-near")
            steps, moved = 0, True
            while moved:
                far = point
                for _ in range(4):
                    far = _followed(far, point)
                jumped = materialize(far.select("node", "parent", (F.col("parent") != F.col("before")).alias("moved")), "cc-jump")
                steps += 1
                moved = not jumped.where("moved").isEmpty()
                discard(point)
                point = jumped.drop("moved")
                point._stored_at = jumped._stored_at  # noqa: SLF001
            if passes is not None:
                passes.append(steps)
            levels.append(point)
            a = point.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
            b = point.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
            crossing = edges.join(shuffled(a), "u").join(shuffled(b), "v").select(F.col("pu").alias("u"), F.col("pv").alias("v"))
            rest = materialize(crossing.select(*columns).where("u > v").distinct(), "cc-edges")
            discard(edges)
            edges = rest
        if not levels:
            return edges.sparkSession.createDataFrame([], "node bigint, component bigint")
        label = levels[0].select("node", F.col("parent").alias("component"))
        for level in levels[1:]:
            up = level.select(F.col("node").alias("component"), F.col("parent").alias("above"))
            label = label.join(shuffled(up), "component", "left").select("node", F.coalesce("above", "component").alias("component"))
            label = materialize(label, "cc-label")
        if len(levels) == 1:
            label = materialize(label, "cc-label")
        keep.append(label)
    return label


def _followed(start: DataFrame, step: DataFrame) -> DataFrame:
    """Pointers (node, parent) of start, each followed once more through step; before is where it led until then."""
    on = step.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
    return start.select("node", "parent").join(shuffled(on), "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"), F.col("parent").alias("before"))
