"""Sorted runs, their metadata and the search order over tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..options import DEFAULT, Options
from ..schemas import DELETION
from ..sources.storage import stored
from .ordered import running_total


def entry_bytes() -> Column:
    """Bytes of an entry: internal key (user key and 8 tag bytes) and value."""
    return F.octet_length("user_key") + 8 + F.coalesce(F.octet_length("value"), F.lit(0))


def file_stats(entries: DataFrame) -> DataFrame:
    """(tier, file_no, file_size, smallest, largest, num_entries, num_deletions) of each file."""
    return entries.groupBy("tier", "file_no").agg(
        F.sum(entry_bytes()).cast("bigint").alias("file_size"), F.min("user_key").alias("smallest"), F.max("user_key").alias("largest"),
        F.count("*").alias("num_entries"), F.count_if(F.col("type") == DELETION).alias("num_deletions"),
    )


def tier_summary(meta: DataFrame, o: Options = DEFAULT) -> DataFrame:
    """(tier, files, bytes, entries) for every tier, empty ones with zeros."""
    tiers = meta.sparkSession.range(o.max_tiers).select(F.col("id").cast("int").alias("tier"))
    sums = meta.groupBy("tier").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"), F.sum("num_entries").alias("entries"))
    return tiers.join(sums, "tier", "left").na.fill(0, ["files", "bytes", "entries"])


def covering(points: DataFrame, ranges: DataFrame, name: str) -> DataFrame:
    """points (key, ...) with name, the number of ranges (smallest, largest) that hold key.

    A range holds a key if it has begun and not ended there, so the number is a running total over keys, beginnings and
    ends in one order: linear in both, and no pair of a key and a range is ever made.
    """
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in points.schema if f.name != "key"]
    rest = [F.col(c) for c in points.columns if c != "key"]
    one = F.lit(1).cast("bigint")
    asked = points.select("key", F.lit(1).alias("__turn"), (one - 1).alias("__more"), *rest)
    begun = ranges.select(F.col("smallest").alias("key"), F.lit(0).alias("__turn"), one.alias("__more"), *none)
    ended = ranges.select(F.col("largest").alias("key"), F.lit(2).alias("__turn"), (-one).alias("__more"), *none)
    spread = F.xxhash64(*(rest or [F.lit(0)]))
    summed = running_total(asked.union(begun).union(ended), "__more", name, "key", "__turn", spread)
    return summed.where("__turn = 1").select(*points.columns, name)


def overlaps(meta: DataFrame) -> DataFrame:
    """(file_no, overlaps): how many other files' key ranges overlap each file's. Files that begin at or before its end,
    less those that end before its beginning, less itself: counts over two orders, not pairs of files."""
    both = meta.select("file_no", F.explode(F.array(F.struct(F.col("largest").alias("key"), F.lit(True).alias("upto")), F.struct(F.col("smallest").alias("key"), F.lit(False).alias("upto")))).alias("e"))
    own = both.select(F.col("e.key").alias("key"), F.lit(1).alias("turn"), "file_no", F.col("e.upto").alias("upto"), F.lit(0).cast("bigint").alias("begun"), F.lit(0).cast("bigint").alias("ended"))
    # At equal keys: beginnings, then the questions, then ends, so that an end counts only as one before the key.
    mark = lambda key, turn, begun: meta.select(F.col(key).alias("key"), F.lit(turn).alias("turn"), "file_no", F.lit(None).cast("boolean").alias("upto"), F.lit(begun).cast("bigint").alias("begun"), F.lit(1 - begun).cast("bigint").alias("ended"))
    line = own.union(mark("smallest", 0, 1)).union(mark("largest", 2, 0))
    line = running_total(line, "begun", "begun_before", "key", "turn", "file_no")
    line = running_total(line, "ended", "ended_before", "key", "turn", "file_no").where("turn = 1")
    at = line.groupBy("file_no").agg(F.max(F.when(F.col("upto"), F.col("begun_before"))).alias("begun"), F.max(F.when(~F.col("upto"), F.col("ended_before"))).alias("ended"))
    return at.select("file_no", (F.col("begun") - F.col("ended") - 1).alias("overlaps"))


def overlapping(inputs: DataFrame, meta: DataFrame, o: Options = DEFAULT) -> DataFrame:
    """Pairs of an input file and another file whose key ranges overlap. The inputs are those of a compaction, a stated
    and bounded set; more of them than may be broadcast are refused."""
    if inputs.limit(o.broadcast_files + 1).count() > o.broadcast_files:
        raise ValueError("too many input files: ask for overlaps()")
    a = inputs.select(F.col("file_no").alias("a_file"), F.col("smallest").alias("a_first"), F.col("largest").alias("a_last"))
    b = meta.select(F.col("file_no").alias("b_file"), F.col("smallest").alias("b_first"), F.col("largest").alias("b_last"))
    hit = (F.col("a_file") != F.col("b_file")) & (F.col("a_first") <= F.col("b_last")) & (F.col("b_first") <= F.col("a_last"))
    return b.join(F.broadcast(a), hit).select("a_file", "b_file")


def consulted(probes: DataFrame, meta: DataFrame) -> DataFrame:
    """(probe_id, user_key, files): how many files a lookup has to consider by key range."""
    keys = probes.select(F.col("user_key").alias("key"), "probe_id")
    return covering(keys, meta, "files").select("probe_id", F.col("key").alias("user_key"), "files")


CHUNK = 4096
SPREAD = 16


def looked_up(probes: DataFrame, index: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(file_no, probe_id, block_no) of every probe (probe_id, user_key) and every file of the index (file_no, block_no,
    last_key) that has a block whose last key is not below the probe's: the first such block.

    In key order, the probes of a block follow each other: those above the last key of the block before it, up to its own.
    So probes and last keys are ordered once, the probes are kept in chunks of that order, and each block takes its stretch
    of every chunk that it reaches. The rows of the result, as many as probes times files, are made where they are read,
    and are neither sorted nor shuffled.
    """
    spark = probes.sparkSession
    none = F.lit(None).cast("bigint")
    asked = probes.select(F.col("user_key").alias("key"), F.lit(0).alias("turn"), F.col("probe_id").cast("bigint").alias("probe_id"), none.alias("file_no"), none.alias("block_no"), F.lit(1).cast("bigint").alias("more"))
    ends = index.select(F.col("last_key").alias("key"), F.lit(1).alias("turn"), none.alias("probe_id"), "file_no", "block_no", F.lit(0).cast("bigint").alias("more"))
    line = stored(running_total(asked.union(ends), "more", "upto", "key", "turn", "probe_id", "file_no", "block_no"), "looked-up")
    at = F.col("upto") - 1
    members = F.array_sort(F.collect_list(F.struct(at.alias("at"), "probe_id")))
    chunks = line.where("turn = 0").groupBy(F.floor(at / chunk).alias("chunk")).agg(members["probe_id"].alias("ids"))
    chunks = chunks.select("chunk", "ids", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"))
    before = F.lag("upto", 1, 0).over(Window.partitionBy("file_no").orderBy("block_no"))
    blocks = line.where("turn = 1").select("file_no", "block_no", before.alias("low"), F.col("upto").alias("high")).where("high > low")
    reached = F.explode(F.sequence(F.floor(F.col("low") / chunk), F.floor((F.col("high") - 1) / chunk))).alias("chunk")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    pairs = blocks.select("file_no", "block_no", "low", "high", reached).withColumn("part", F.pmod(F.hash("file_no", "block_no"), F.lit(SPREAD)))
    met = pairs.repartition(parts, "chunk", "part").join(chunks.hint("merge"), ["chunk", "part"])
    first = F.greatest(F.col("low") - F.col("chunk") * chunk, F.lit(0))
    last = F.least(F.col("high") - F.col("chunk") * chunk, F.lit(chunk))
    mine = F.slice("ids", (first + 1).cast("int"), (last - first).cast("int"))
    return met.select("file_no", F.explode(mine).alias("probe_id"), "block_no")


def first_hit(entries: DataFrame, snap: int | Column | None = None) -> DataFrame:
    """The version that a search finds which goes from the shallowest tier down and from the newest file back. It is the
    newest one only while every compaction moves the oldest files down. One partial and one final aggregate."""
    seen = entries if snap is None else entries.where(F.col("seq") <= snap)
    best = F.min_by(F.struct("tier", "file_no", "seq", "type"), F.struct("tier", -F.col("file_no"), -F.col("seq"))).alias("v")
    return seen.groupBy("user_key").agg(best).select("user_key", "v.tier", "v.file_no", "v.seq", "v.type")


def order_violations(placed: DataFrame) -> DataFrame:
    """(file_no, violations): neighbours in a file (by pos, their place in it) that are not strictly ascending: key up,
    sequence down."""
    w = Window.partitionBy("file_no").orderBy("pos")
    k, s = F.lag("user_key").over(w), F.lag("seq").over(w)
    bad = (k > F.col("user_key")) | ((k == F.col("user_key")) & (s <= F.col("seq")))
    return placed.select("file_no", F.coalesce(bad, F.lit(False)).alias("bad")).groupBy("file_no").agg(F.count_if("bad").alias("violations"))


def dump_totals(entries: DataFrame) -> DataFrame:
    """What a dump of each file reports: entries, deletions, bytes of keys and values, and their share of the file."""
    return entries.groupBy("file_no").agg(
        F.count("*").alias("entries"), F.count_if(F.col("type") == DELETION).alias("deletions"), F.min("user_key").alias("first_key"), F.max("user_key").alias("last_key"),
        F.sum(F.octet_length("user_key")).alias("key_bytes"), F.sum(F.coalesce(F.octet_length("value"), F.lit(0))).alias("value_bytes"),
    )


def write_run(entries: DataFrame, path: str, bloom_bits: int = DEFAULT.bloom_bits_per_key) -> None:
    """Write entries as Parquet, sorted within partitions by key and newest first, so that row-group statistics and the
    Bloom filter on user_key prune reads."""
    writer = entries.repartitionByRange("user_key").sortWithinPartitions("user_key", F.col("seq").desc()).write
    if bloom_bits > 0:
        writer = writer.option("parquet.bloom.filter.enabled#user_key", "true")
    writer.parquet(path)
