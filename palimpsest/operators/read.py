"""Reads of the multi-version log. Sequence and key predicates stand below the newest-per-key aggregate, where they reach
the scan; the deletion test stands above it, as a deleted key must not fall back to an older value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import VALUE
from . import ordered


def _bounded(m: DataFrame, snap: int | Column | None) -> DataFrame:
    return m if snap is None else m.where(F.col("seq") <= snap)


def newest(m: DataFrame, snap: int | Column | None = None) -> DataFrame:
    """(user_key, seq, type, value) of each key's newest version at a snapshot; one partial and one final aggregate."""
    v = F.max_by(F.struct("type", "value", "seq"), "seq").alias("v")
    return _bounded(m, snap).groupBy("user_key").agg(v).select("user_key", "v.seq", "v.type", "v.value")


def scan(m: DataFrame, snap: int | Column | None = None) -> DataFrame:
    """(user_key, value) of every live key at a snapshot."""
    return newest(m, snap).where(F.col("type") == VALUE).select("user_key", "value")


def get(m: DataFrame, key: str, snap: int | Column | None = None) -> DataFrame:
    """The live value of one key, or no row."""
    return scan(m.where(F.col("user_key") == key), snap)


def outcome(seq: Column, kind: Column) -> Column:
    """absent, tombstone or value: a deleted key differs from one never written."""
    return F.when(seq.isNull(), "absent").when(kind == VALUE, "value").otherwise("tombstone")


def multi_get(m: DataFrame, probes: DataFrame, snap: int | Column | None = None) -> DataFrame:
    """probes (probe_id, user_key) with outcome and value. The log is cut to the probed keys before it is aggregated."""
    wanted = m.join(probes.select("user_key").distinct(), "user_key", "left_semi")
    got = probes.join(newest(wanted, snap), "user_key", "left")
    return got.select("probe_id", "user_key", outcome(F.col("seq"), F.col("type")).alias("outcome"), F.when(F.col("type") == VALUE, F.col("value")).alias("value"))


def as_of(m: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (probe_id, user_key, snap) with the newest version at each probe's own snapshot.

    Versions and probes are merged in one order of key and sequence number and the last version is carried forward, so
    the work is linear in both and a hot key may lie in many tasks; a join on the key would make a row for every version
    below every probe.
    """
    versions = m.select("user_key", F.col("seq").alias("at"), F.lit(0).alias("is_probe"), F.lit(None).cast("bigint").alias("probe_id"), F.struct("seq", "type", "value").alias("v"))
    asked = probes.select("user_key", F.col("snap").cast("bigint").alias("at"), F.lit(1).alias("is_probe"), F.col("probe_id").cast("bigint").alias("probe_id"), F.lit(None).cast(versions.schema["v"].dataType).alias("v"))
    found = ordered.carried(versions.unionByName(asked), "user_key", "v", "at", "is_probe", "probe_id").where("is_probe = 1")
    return found.select(F.col("probe_id").cast(probes.schema["probe_id"].dataType).alias("probe_id"), "user_key", F.col("at").alias("snap"), "v.seq", outcome(F.col("v.seq"), F.col("v.type")).alias("outcome"), F.when(F.col("v.type") == VALUE, F.col("v.value")).alias("value"))


def range_scan(m: DataFrame, first: str, last: str, snap: int | Column | None = None) -> DataFrame:
    return scan(m.where(F.col("user_key").between(first, last)), snap)


def prefix_scan(m: DataFrame, prefix: str, snap: int | Column | None = None) -> DataFrame:
    return scan(m.where(F.col("user_key").startswith(prefix)), snap)


def first_key(m: DataFrame, snap: int | Column | None = None) -> DataFrame:
    return scan(m, snap).orderBy("user_key").limit(1)


def last_key(m: DataFrame, snap: int | Column | None = None) -> DataFrame:
    return scan(m, snap).orderBy(F.col("user_key").desc()).limit(1)


def seek(m: DataFrame, target: str, snap: int | Column | None = None) -> DataFrame:
    """First live key at or after target."""
    return first_key(m.where(F.col("user_key") >= target), snap)


def prev(m: DataFrame, target: str, snap: int | Column | None = None) -> DataFrame:
    """Last live key before target."""
    return last_key(m.where(F.col("user_key") < target), snap)


def seek_all(view: DataFrame, targets: DataFrame, backwards: bool = False) -> DataFrame:
    """targets (target) with found_key, the first live key at or after it, or backwards the last before it. Keys and
    targets are merged in one order, in which the last key seen is the answer."""
    key_type = view.schema["user_key"].dataType
    keys = view.select(F.col("user_key").alias("k"), F.lit(1 if backwards else 0).alias("turn"), F.col("user_key").alias("found_key"))
    asked = targets.select("target").distinct().select(F.col("target").alias("k"), F.lit(0 if backwards else 1).alias("turn"), F.lit(None).cast(key_type).alias("found_key"))
    way = F.col("k") if backwards else F.col("k").desc()
    merged = keys.union(asked).withColumn("target", F.when(F.col("turn") == (0 if backwards else 1), F.col("k")))
    return ordered.carried(merged, None, "found_key", way, "turn").where("target is not null").select("target", "found_key")


def seek_next(view: DataFrame, targets: DataFrame, n: int) -> DataFrame:
    """(target, step, user_key, value): the first n live keys at or after each target, step counted from 0."""
    placed = ordered.ranked(view, "user_key")
    from_key = seek_all(placed, targets).where("found_key is not null")
    start = from_key.join(placed.select(F.col("user_key").alias("found_key"), "rank"), "found_key")
    steps = start.select("target", "rank", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("step"))
    return steps.withColumn("rank", F.col("rank") + F.col("step")).join(placed, "rank").select("target", "step", "user_key", "value")


def ordered_scan(m: DataFrame, snap: int | Column | None = None) -> DataFrame:
    """The scan with each row's place in key order."""
    return ordered.ranked(scan(m, snap), "user_key")


def internal_order(m: DataFrame) -> DataFrame:
    """Every version with its place in the order of a sorted run: key up, newest first."""
    return ordered.ranked(m.select("user_key", "seq", "type"), "user_key", F.col("seq").desc())


def reverse_scan(m: DataFrame, snap: int | Column | None = None) -> DataFrame:
    """The scan with each row's place from the largest key down."""
    return ordered.ranked(scan(m, snap), F.col("user_key").desc())


def history(m: DataFrame) -> DataFrame:
    """Every version with its place from the newest and the sequence number that superseded it. A version's place is its
    rank among all versions less that of its key's newest, and the newer version stands one rank before it: joins of
    single rows, so a key of many versions is no task of its own."""
    line = ordered.ranked(m.select("user_key", "seq", "type"), "user_key", F.col("seq").desc())
    first = line.groupBy("user_key").agg(F.min("rank").alias("first"))
    newer = line.select((F.col("rank") + 1).alias("rank"), F.col("user_key").alias("k"), F.col("seq").alias("superseded_by"))
    placed = line.join(first, "user_key").join(newer, "rank", "left")
    after = F.when(F.col("k") == F.col("user_key"), F.col("superseded_by"))
    return placed.select("user_key", "seq", "type", (F.col("rank") - F.col("first") + 1).alias("version"), after.alias("superseded_by"))


def diff(m: DataFrame, older: int | Column, newer: int | Column) -> DataFrame:
    """Keys whose live value differs between two snapshots: added, removed or changed. One pass over the log: both
    newest versions come from the same aggregate."""
    old, new = (F.max_by(F.struct("type", "value"), F.when(F.col("seq") <= s, F.col("seq"))) for s in (older, newer))
    both = m.groupBy("user_key").agg(old.alias("a"), new.alias("b"))
    a, b = (F.when(F.col(f"{x}.type") == VALUE, F.struct(F.col(f"{x}.value").alias("value"))) for x in "ab")
    change = F.when(F.col("a").isNull() & F.col("b").isNotNull(), "added").when(F.col("a").isNotNull() & F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    out = both.select("user_key", a.alias("a"), b.alias("b")).withColumn("change", change).where("change is not null")
    return out.select("user_key", "change", F.col("a.value").alias("old_value"), F.col("b.value").alias("new_value"))


def common_keys(m: DataFrame, older: int | Column, newer: int | Column) -> DataFrame:
    """Keys live at both snapshots."""
    return scan(m, older).select("user_key").intersect(scan(m, newer).select("user_key"))
