"""Write batches and the log: sequence numbers, torn tails, recovery, group commit, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..options import DEFAULT, Options
from .ordered import running_total

RECORD_HEADER, FILE_HEADER = 9, 16


def varint_bytes(n: Column) -> Column:
    """Bytes of a number in groups of seven bits."""
    out = F.lit(10)
    for k in range(9, 0, -1):
        out = F.when(n < (1 << (7 * k)) if 7 * k < 63 else F.lit(True), k).otherwise(out)
    return out


def op_bytes(kind: Column, user_key: Column, value: Column) -> Column:
    k, v = F.octet_length(user_key), F.coalesce(F.octet_length(value), F.lit(0))
    return 1 + varint_bytes(k) + k + F.when(kind == 1, varint_bytes(v) + v).otherwise(0)


def batch_bytes(ops: Column) -> Column:
    """Bytes of a serialised batch: a 12-byte header and its operations."""
    return F.aggregate(F.transform(ops, lambda o: op_bytes(o["type"], o["user_key"], o["value"]).cast("bigint")), F.lit(12).cast("bigint"), lambda a, x: a + x)


def exploded(batches: DataFrame) -> DataFrame:
    """(batch_no, pos, seq, type, user_key, value): operation i of a batch has sequence number base + i."""
    one = batches.select("batch_no", "base_seq", F.posexplode("ops").alias("pos", "op"))
    return one.select("batch_no", F.col("pos").cast("bigint").alias("pos"), (F.col("base_seq") + F.col("pos")).alias("seq"), "op.type", "op.user_key", "op.value")


def assigned(records: DataFrame) -> DataFrame:
    """(log_no, batch_no, n_ops, base_seq) from records without sequence numbers: the batches of all logs in a row, each
    beginning after the running total of those before it."""
    sized = records.select("log_no", "batch_no", F.size("ops").cast("bigint").alias("n_ops"))
    before = running_total(sized, "n_ops", "before", "log_no", "batch_no", inclusive=False)
    return before.select("log_no", "batch_no", "n_ops", (1 + F.col("before")).alias("base_seq"))


def appended(batches: DataFrame, group: Column) -> DataFrame:
    """(group_no, base_seq, n_ops, ops): the batches of a group as one, their operations in batch order. The whole takes
    the first batch's sequence number and its operations are numbered on from it. Groups are bounded by the batch limit."""
    rows = batches.groupBy(group.alias("group_no")).agg(F.array_sort(F.collect_list(F.struct("batch_no", "base_seq", "ops"))).alias("b"))
    ops = F.flatten(F.col("b.ops"))
    base = F.col("b")[0]["base_seq"]
    numbered = F.transform(ops, lambda op, i: F.struct((base + i).alias("seq"), op["type"].alias("type"), op["user_key"].alias("user_key"), op["value"].alias("value")))
    return rows.select("group_no", base.alias("base_seq"), F.size(ops).cast("bigint").alias("n_ops"), numbered.alias("ops"))


def recovery_units(records: DataFrame, most: int) -> DataFrame:
    """(log_no, batch_no, unit): the run that replaying a log writes a batch to, when the buffer is written out as soon
    as it holds more than so many bytes after a batch, and at the log's end. A fold over the records of a log in order,
    up to the first damaged one; logs are bounded in length."""
    rows = valid_prefix(records).select("log_no", F.struct("rec_no", "batch_no", batch_bytes(F.col("ops")).alias("size")).alias("r"))
    logs = rows.groupBy("log_no").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("unit"), zero.alias("used"), F.array().cast("array<bigint>").alias("out"))

    def step(a: Column, r: Column) -> Column:
        full = a["used"] > most
        unit = F.when(full, a["unit"] + 1).otherwise(a["unit"])
        used = F.when(full, r["size"]).otherwise(a["used"] + r["size"])
        return F.struct(unit.alias("unit"), used.cast("bigint").alias("used"), F.concat(a["out"], F.array(unit)).alias("out"))

    units = logs.select("log_no", "rs", F.aggregate("rs", start, step)["out"].alias("units"))
    each = units.select("log_no", F.explode(F.arrays_zip(F.col("rs.batch_no").alias("batch_no"), F.col("units").alias("unit"))).alias("z"))
    return each.select("log_no", "z.batch_no", "z.unit")


def valid_prefix(records: DataFrame) -> DataFrame:
    """Records before the first damaged one of their log; other logs are not affected."""
    w = Window.partitionBy("log_no").orderBy("rec_no").rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumn("__bad", F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(w)).where("__bad = 0").drop("__bad")


def recovered(records: DataFrame, min_log: int | Column) -> DataFrame:
    """(log_no, records, ops, last_seq, stopped) of each log that recovery replays: clean end or the first damage."""
    logs = records.where(F.col("log_no") >= min_log)
    good = valid_prefix(logs).groupBy("log_no").agg(F.count("*").alias("records"), F.sum(F.size("ops")).alias("ops"), F.max(F.col("base_seq") + F.size("ops") - 1).alias("last_seq"))
    every = logs.groupBy("log_no").agg(F.count("*").alias("written"))
    stopped = F.when(F.coalesce("records", F.lit(0)) < F.col("written"), "CRC mismatch").otherwise("clean end of file")
    zero = F.lit(0).cast("bigint")
    return every.join(good, "log_no", "left").select("log_no", F.coalesce("records", zero).alias("records"), F.coalesce("ops", zero).alias("ops"), F.coalesce("last_seq", zero).alias("last_seq"), stopped.alias("stopped"))


def good_offset(records: DataFrame) -> DataFrame:
    """(log_no, good_offset): the byte at which a log is cut logically."""
    good = valid_prefix(records).groupBy("log_no").agg(F.sum(RECORD_HEADER + batch_bytes(F.col("ops"))).alias("n"))
    logs = records.select("log_no").distinct()
    return logs.join(good, "log_no", "left").select("log_no", (F.coalesce("n", F.lit(0)) + FILE_HEADER).cast("bigint").alias("good_offset"))


def commit_groups(records: DataFrame, small: int = 128 << 10, large: int = 1 << 20) -> DataFrame:
    """(log_no, batch_no, group_no): consecutive writers with the same sync, up to a size that depends on the first.

    A fold over the records of a log in order, as a group's end depends on where it began; logs are bounded in length.
    """
    rows = records.select("log_no", F.struct("batch_no", "sync", batch_bytes(F.col("ops")).alias("size")).alias("r"))
    logs = rows.groupBy("log_no").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    start = F.struct(F.lit(-1).cast("bigint").alias("group"), F.lit(None).cast("boolean").alias("sync"), F.lit(0).cast("bigint").alias("size"), F.lit(-1).cast("bigint").alias("most"), F.array().cast("array<bigint>").alias("out"))

    def step(a: Column, r: Column) -> Column:
        joins = (a["group"] >= 0) & (r["sync"] == a["sync"]) & (a["size"] + r["size"] <= a["most"])
        group = F.when(joins, a["group"]).otherwise(a["group"] + 1)
        most = F.when(joins, a["most"]).otherwise(F.when(r["size"] <= small, r["size"] + small).otherwise(large))
        return F.struct(
            group.alias("group"), F.when(joins, a["sync"]).otherwise(r["sync"]).alias("sync"), F.when(joins, a["size"] + r["size"]).otherwise(r["size"]).alias("size"),
            most.cast("bigint").alias("most"), F.concat(a["out"], F.array(group)).alias("out"),
        )

    folded = logs.select("log_no", "rs", F.aggregate("rs", start, step)["out"].alias("groups"))
    each = folded.select("log_no", F.explode(F.arrays_zip(F.col("rs.batch_no").alias("batch_no"), F.col("groups").alias("group_no"))).alias("z"))
    return each.select("log_no", "z.batch_no", "z.group_no")


def last_op_wins(batches: DataFrame) -> DataFrame:
    """(batch_no, user_key, type, seq): what a batch leaves of each key that it writes."""
    w = F.max_by(F.struct("type", "seq"), "seq").alias("v")
    return exploded(batches).groupBy("batch_no", "user_key").agg(w).select("batch_no", "user_key", "v.type", "v.seq")


def frozen(batches: DataFrame, rows: int) -> DataFrame:
    """(batch_no, unit): the buffer that takes a batch, when a buffer is frozen at so many operations."""
    return batches.select("batch_no", F.floor((F.col("base_seq") - 1) / rows).cast("bigint").alias("unit"))


def validation(key_bytes: Column, value_bytes: Column, o: Options = DEFAULT) -> Column:
    """Status of a write by its sizes; nothing is ever cut to fit."""
    return F.when(key_bytes > o.max_key_bytes, "InvalidArgument: key too large").when(value_bytes > o.max_value_bytes, "InvalidArgument: value too large").otherwise("OK")
