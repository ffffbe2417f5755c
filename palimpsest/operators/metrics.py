"""Counters, latency histograms and the checks of a load test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINEAR, LAST_BUCKET = 256, 57 * 256 - 1
#: The counters of a store and how each is reduced over shards.
COUNTERS = {
    "writes": "sum", "wal-syncs": "sum", "bloom-checked": "sum", "bloom-rejected": "sum", "blocks-read": "sum", "filter-blocks-read": "sum",
    "filter-bytes-resident": "gauge", "cache-hits": "sum", "cache-misses": "sum", "memtable-bytes": "gauge", "compactions": "sum",
    "bytes-compacted": "sum", "pending-compaction-bytes": "gauge", "stalls": "sum", "max-stall-ms": "max", "orphan-files": "gauge", "orphan-bytes": "gauge",
}
SLOW_FILES, STOP_FILES = 8, 12


def with_kinds(counters: DataFrame) -> DataFrame:
    """Counters (shard, name, v) with the kind of each; unknown names are refused."""
    kind = F.create_map(*(F.lit(x) for pair in COUNTERS.items() for x in pair))[F.col("name")]
    return counters.withColumn("kind", F.when(kind.isNotNull(), kind).otherwise(F.raise_error(F.concat(F.lit("no counter "), F.col("name")))))


def pressure(files: Column) -> Column:
    """What writers meet at so many files in tier 0: nothing, a brake, or a stop."""
    return F.when(files >= STOP_FILES, "stop").when(files >= SLOW_FILES, "slow").otherwise("free")


def reduce_counters(counters: DataFrame) -> DataFrame:
    """(name, kind, total): sums add over shards, maxima take the largest, a gauge lives in shard 0."""
    v = F.col("v")
    total = F.when(F.col("kind") == "max", F.col("most")).when(F.col("kind") == "gauge", F.col("first")).otherwise(F.col("added"))
    sums = counters.groupBy("name", "kind").agg(F.sum(v).alias("added"), F.max(v).alias("most"), F.sum(F.when(F.col("shard") == 0, v).otherwise(0)).alias("first"))
    return sums.select("name", "kind", total.cast("bigint").alias("total"))


def bucket_of(v: Column) -> Column:
    """256 linear buckets, then 256 to each power of two."""
    e = F.length(F.bin(v)) - 1
    return F.when(v < LINEAR, v).otherwise(F.least((e - 7).cast("bigint") * 256 + F.call_function("shiftright", v, (e - 8).cast("int")).bitwiseAND(F.lit(255)), F.lit(LAST_BUCKET))).cast("bigint")


def lower_of(bucket: Column) -> Column:
    """Smallest value of a bucket."""
    octave, part = F.floor(bucket / 256).cast("int"), F.pmod(bucket, F.lit(256))
    return F.when(bucket < LINEAR, bucket).otherwise(F.call_function("shiftleft", (part + 256).cast("bigint"), octave - 1)).cast("bigint")


def histogram(samples: DataFrame, *by: str) -> DataFrame:
    """(*by, bucket, lower, cnt)."""
    b = bucket_of(F.col("v"))
    return samples.groupBy(*by, b.alias("bucket")).agg(F.count("*").alias("cnt")).select(*by, "bucket", lower_of(F.col("bucket")).alias("lower"), "cnt")


def merge_histograms(parts: DataFrame) -> DataFrame:
    """Histograms of several shards as one."""
    return parts.groupBy("bucket", "lower").agg(F.sum("cnt").alias("cnt"))


def percentiles(hist: DataFrame, per_mille: list[int]) -> DataFrame:
    """(per_mille, v): the lower bound of the first bucket at which the running count reaches floor(p*n); no
    interpolation. A histogram has at most 57*256 rows, so one ordered pass over it is small at any size."""
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    run = hist.select("bucket", "lower", F.sum("cnt").over(w).alias("cum"))
    n = hist.agg(F.sum("cnt").alias("n"))
    asked = hist.sparkSession.createDataFrame([(p,) for p in per_mille], "per_mille bigint").crossJoin(n)
    target = F.floor(F.col("per_mille") * F.col("n") / 1000)
    hit = F.broadcast(asked.withColumn("target", target)).join(run, F.col("cum") >= F.col("target"))
    return hit.groupBy("per_mille").agg(F.min("lower").alias("v"))


def summary(samples: DataFrame) -> DataFrame:
    return samples.agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.sum("v").alias("total"), F.floor(F.sum("v") / F.count("*")).cast("bigint").alias("mean"))


REPORTED = (500, 900, 990, 999)


def report(samples: DataFrame) -> DataFrame:
    """One row: number and mean of the samples, the reported percentiles of their histogram, and the largest."""
    found = percentiles(histogram(samples), list(REPORTED))
    wide = found.agg(*(F.max(F.when(F.col("per_mille") == p, F.col("v"))).alias(f"p{p}") for p in REPORTED))
    return summary(samples).select("n", "mean", "most").crossJoin(F.broadcast(wide))


def open_loop(ops: DataFrame, interval_us: int) -> DataFrame:
    """ops (run, i, done_us): a run's latency counts from each operation's intended start i*interval; operations over a
    second late are diverging, and the run is valid if it reached 99 % of the intended rate."""
    late = F.col("done_us") - F.col("i") * interval_us
    sums = ops.groupBy("run").agg(F.count("*").alias("n"), F.max("done_us").alias("took_us"), F.count_if(late > 1_000_000).alias("late"), F.max(late).alias("worst_us"))
    valid = F.col("n") * interval_us * 100 >= F.col("took_us") * 99
    return sums.withColumn("valid", valid)
