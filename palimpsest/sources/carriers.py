"""The driver's tables as carriers of log tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..options import DEFAULT, Options


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # Pandas files carry nanosecond or zone-less times; readers below never need them as anything but plain times.
    return df.select(*(F.col(f.name).cast("timestamp_ntz") if isinstance(f.dataType, T.TimestampType) else F.col(f.name) for f in df.schema))


def key(n: str | Column) -> Column:
    """Fixed-width key of a number: 'key' and 13 digits."""
    return F.format_string("key%013d", F.col(n) if isinstance(n, str) else n)


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as a mutation log: an error deletes its user's key, any other event puts a value."""
    dead = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).cast("bigint").alias("seq"),
        F.when(dead, 0).otherwise(1).alias("type"),
        key("user_id").alias("user_key"),
        F.when(~dead, F.concat("event_type", F.lit(":"), "props")).alias("value"),
    )


def last_sequence(m: DataFrame) -> DataFrame:
    """One row: n, the newest sequence number (0 for an empty log)."""
    return m.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("n"))


def with_snapshot(m: DataFrame, tenths: int) -> DataFrame:
    """Adds snap, the sequence number at so many tenths of the log. The other side is a single row."""
    return m.crossJoin(F.broadcast(last_sequence(m).select((F.col("n") * tenths / 10).cast("bigint").alias("snap"))))


def flush_units(m: DataFrame, rows: int = DEFAULT.flush_rows) -> DataFrame:
    """Entries with the number of the flush that writes them."""
    return m.withColumn("file_no", F.floor((F.col("seq") - 1) / rows).cast("bigint"))


def steady_tier(file_no: Column, files: Column, fan_in: int, max_tiers: int) -> Column:
    """Tier of a flush once all compactions have drained: the largest t such that the flush belongs to a whole block of
    fan_in**t flushes."""
    found = F.lit(0)
    for t in range(1, max_tiers):
        block = fan_in**t
        found = F.when(file_no < F.floor(files / block) * block, t).otherwise(found)
    return found.cast("int")


def entries(m: DataFrame, o: Options = DEFAULT) -> DataFrame:
    """The log as entries of flushed files in steady tiers."""
    flushed = flush_units(m, o.flush_rows)
    files = F.broadcast(flushed.agg((F.max("file_no") + 1).alias("files")))
    tier = steady_tier(F.col("file_no"), F.col("files"), o.tier_trigger, o.max_tiers)
    return flushed.crossJoin(files).withColumn("tier", tier).drop("files")


def batches(m: DataFrame, ops: int = 7) -> DataFrame:
    """Write batches of consecutive mutations; every fifth is synced."""
    no = F.floor((F.col("seq") - 1) / ops).cast("bigint")
    grouped = m.groupBy(no.alias("batch_no")).agg(
        F.array_sort(F.collect_list(F.struct("seq", "type", "user_key", "value"))).alias("ops")
    )
    return grouped.select("batch_no", (F.col("batch_no") % 5 == 0).alias("sync"), F.col("ops")[0]["seq"].alias("base_seq"), "ops")


def wal_records(m: DataFrame, per_log: int = 50) -> DataFrame:
    """Batches as log records: a log has 50, and one record in 97 is damaged."""
    b = batches(m)
    return b.select(
        F.floor(F.col("batch_no") / per_log).cast("bigint").alias("log_no"),
        (F.col("batch_no") % per_log).alias("rec_no"),
        (F.col("batch_no") % 97 != 96).alias("ok"),
        "batch_no", "sync", "base_seq", "ops",
    )


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of all customers; those beyond the users are absent from the log."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("probe_id"), key("c_custkey").alias("user_key"))


#: How each event type is reduced when events stand for counters.
COUNTER_KINDS = {"error": "max", "purchase": "max", "view": "gauge"}


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.lit("sum")
    for name, k in COUNTER_KINDS.items():
        kind = F.when(F.col("event_type") == name, k).otherwise(kind)
    return e.select(
        (F.col("user_id") % 16).cast("int").alias("shard"), F.col("event_type").alias("name"), kind.alias("kind"),
        F.floor("value").cast("bigint").alias("v"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-negative latencies with a shard, from the event values."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 8).cast("int").alias("shard"), F.abs(F.floor(F.col("value") * 100)).cast("bigint").alias("v"))


def edits(m: DataFrame, o: Options = DEFAULT) -> DataFrame:
    """Version edits: each flush adds a tier-0 file; after every tier_trigger flushes an edit replaces them by one file
    of tier 1, numbered from 100000."""
    t = o.tier_trigger
    files = flush_units(m, o.flush_rows).select("file_no").distinct()
    made = files.select((F.col("file_no") * 2).alias("edit_no"), F.lit("add").alias("action"), F.lit(0).alias("tier"), "file_no")
    full = files.where(F.col("file_no") % t == t - 1).select(F.floor(F.col("file_no") / t).alias("g"))
    gone = full.select((2 * (F.col("g") * t + t - 1) + 1).alias("edit_no"), F.lit("del").alias("action"), F.lit(0).alias("tier"), F.explode(F.sequence(F.col("g") * t, F.col("g") * t + t - 1)).alias("file_no"))
    new = full.select((2 * (F.col("g") * t + t - 1) + 1).alias("edit_no"), F.lit("add").alias("action"), F.lit(1).alias("tier"), (F.col("g") + 100000).alias("file_no"))
    return made.unionByName(gone).unionByName(new)
