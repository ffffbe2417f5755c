"""Compaction: choice of files, merge with the two drop rules, and the loop until no tier is full."""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..options import DEFAULT, Options
from ..schemas import DELETION, VALUE
from ..sources.storage import new_path, stored
from .files import covering, file_stats, write_run
from .ordered import carried
from .read import newest


@dataclass(frozen=True)
class Pick:
    input_tier: int
    output_tier: int
    inputs: tuple[int, ...]


def choose(files: Iterable[tuple[int, int]], o: Options = DEFAULT) -> Pick | None:
    """The next compaction of files (tier, file_no): the shallowest tier with tier_trigger files, its oldest that many by
    number. At the last tier the whole deepest tier is merged into itself."""
    tiers: dict[int, list[int]] = {}
    for tier, number in files:
        tiers.setdefault(tier, []).append(number)
    full = min((t for t, numbers in tiers.items() if len(numbers) >= o.tier_trigger), default=None)
    if full is None:
        return None
    oldest = sorted(tiers[full])
    out = full + 1
    inputs = oldest[: o.tier_trigger]
    if out >= o.max_tiers:
        out = o.max_tiers - 1
        inputs = oldest if out == full else inputs + sorted(tiers.get(out, []))
    return Pick(full, out, tuple(inputs))


def choose_round(files: Iterable[tuple[int, int]], o: Options = DEFAULT) -> list[Pick]:
    """The compactions that choose() gives one after the other until its tier is no longer full. They write to a deeper
    tier, so none of them reads what another one has written."""
    files = list(files)
    first = choose(files, o)
    if first is None or first.output_tier <= first.input_tier:
        return [] if first is None else [first]
    oldest, k = sorted(n for t, n in files if t == first.input_tier), o.tier_trigger
    return [Pick(first.input_tier, first.output_tier, tuple(oldest[i : i + k])) for i in range(0, len(oldest) - k + 1, k)]


def picked(meta: DataFrame, o: Options = DEFAULT) -> DataFrame:
    """(file_no, input_tier, output_tier) of the next compaction's inputs, as a plan: no file list leaves the cluster."""
    full = meta.groupBy("tier").count().where(F.col("count") >= o.tier_trigger).agg(F.min("tier").alias("full"))
    rank = F.row_number().over(Window.partitionBy("tier").orderBy("file_no"))
    last = F.lit(o.max_tiers - 1)
    out = F.least(F.col("full") + 1, last)
    mine = (F.col("tier") == F.col("full")) & ((F.col("rank") <= o.tier_trigger) | (F.col("full") == last))
    folded = (F.col("full") + 1 == last + 1) & (F.col("tier") == last)
    both = meta.withColumn("rank", rank).crossJoin(F.broadcast(full)).where(mine | folded)
    return both.select("file_no", F.col("tier").alias("input_tier"), out.cast("int").alias("output_tier"))


def oldest_snapshot(m: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row: the oldest live snapshot, else the last sequence number (never 0 for a log with entries)."""
    return m.agg(F.max("seq").alias("last")).crossJoin(snapshots.agg(F.min("seq").alias("low"))).select(F.coalesce("low", "last", F.lit(0)).cast("bigint").alias("oldest"))


def united(ranges: Iterable[tuple]) -> list[tuple]:
    """Ranges (smallest, largest) with those that touch made one."""
    out: list[tuple] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


FEW_RANGES = 1000


def _uncovered(keys: DataFrame, others: DataFrame | list[tuple]) -> DataFrame:
    """The keys (key) that no range holds. A list's ranges are united first; few of them are tested in place, more are
    counted in one order with the keys."""
    if isinstance(others, list):
        ranges, kind = united(others), keys.schema["key"].dataType.simpleString()
        others = keys.sparkSession.createDataFrame(ranges, f"smallest {kind}, largest {kind}")
        if len(ranges) <= FEW_RANGES:
            return keys.join(F.broadcast(others), F.col("key").between(F.col("smallest"), F.col("largest")), "left_anti")
    return covering(keys, others, "holding").where("holding = 0").select("key")


def judged(inputs: DataFrame, others: DataFrame | list[tuple], oldest: int | Column) -> DataFrame:
    """Input entries with their fate: superseded (a newer input version is visible to every snapshot), tombstone (a
    deletion no snapshot needs, over keys that no other file from the output tier down can hold) or kept.

    The newer version counts whether or not it is itself dropped. So what matters of a key is its newest version up to
    the oldest snapshot: all before it are superseded, and it is the only deletion that may go. That is one aggregate, in
    which a key of many versions is combined before the shuffle. others: (smallest, largest) of those other files.
    """
    seen = F.col("seq") <= oldest
    tops = inputs.where(seen).groupBy("user_key").agg(F.max("seq").alias("top"), F.max_by("type", "seq").alias("top_type"))
    dead = tops.where(F.col("top_type") == DELETION).select(F.col("user_key").alias("key"))
    free = _uncovered(dead, others).select(F.col("key").alias("user_key"), F.lit(True).alias("free"))
    both = inputs.join(tops.join(free, "user_key", "left"), "user_key", "left")
    fate = F.when(F.col("seq") < F.col("top"), "superseded").when((F.col("seq") == F.col("top")) & F.col("free"), "tombstone").otherwise("kept")
    return both.withColumn("fate", fate).drop("top", "top_type", "free")


def merged(inputs: DataFrame, others: DataFrame | list[tuple], oldest: int | Column) -> DataFrame:
    """The entries that a compaction of the inputs writes."""
    return judged(inputs, others, oldest).where("fate = 'kept'").drop("fate")


class _Cover:
    """Closed ranges of keys, united where they touch."""

    def __init__(self) -> None:
        self.lows: list = []
        self.highs: list = []

    def holds(self, key) -> bool:
        i = bisect_left(self.highs, key)
        return i < len(self.highs) and self.lows[i] <= key

    def add(self, low, high) -> bool:
        """Whether the range brings any key that was not held."""
        i, j = bisect_left(self.highs, low), bisect_right(self.lows, high)
        if i < j:
            if self.lows[i] <= low and high <= self.highs[i]:
                return False
            low, high = min(low, self.lows[i]), max(high, self.highs[j - 1])
        self.lows[i:j], self.highs[i:j] = [low], [high]
        return True


def _steps(ranges: list[tuple]) -> list[tuple]:
    """(key, turn, since) in order, of ranges (number, smallest, largest): from there on, the least number of a range that
    holds the place, or _NEVER. Turn 0 is before the key itself and turn 2 after it."""
    events = sorted([(low, 0, n, high) for n, low, high in ranges] + [(high, 2, n, None) for n, _, high in ranges], key=lambda e: e[:3])
    out, open_ = [], []
    for at, (key, turn, n, high) in enumerate(events):
        if turn == 0:
            heapq.heappush(open_, (n, high))
        while open_ and (open_[0][1] < key or (turn == 2 and open_[0][1] == key)):
            heapq.heappop(open_)
        if at + 1 == len(events) or events[at + 1][:2] != (key, turn):
            out.append((key, turn, open_[0][0] if open_ else _NEVER))
    return out


_NEVER = (1 << 63) - 1


def _held(dead: DataFrame, ranges: list[tuple]) -> DataFrame:
    """The rows of dead (made, user_key, ...) whose key is in a range (number, smallest, largest) of a number below made.
    Few ranges are tested in place, more of them are met in one order with the keys."""
    spark, kind = dead.sparkSession, dead.schema["user_key"].dataType.simpleString()
    if len(ranges) <= FEW_RANGES:
        known = spark.createDataFrame(ranges, f"__number bigint, __smallest {kind}, __largest {kind}")
        inside = (F.col("__number") < F.col("made")) & F.col("user_key").between(F.col("__smallest"), F.col("__largest"))
        return dead.join(F.broadcast(known), inside, "left_semi")
    steps = spark.createDataFrame(_steps(ranges), f"user_key {kind}, __turn int, __since bigint")
    asked = dead.withColumns({"__turn": F.lit(1), "__since": F.lit(None).cast("bigint")})
    met = carried(asked.unionByName(steps, allowMissingColumns=True), None, "__since", "user_key", "__turn", "made")
    return met.where((F.col("__turn") == 1) & (F.col("__since") < F.col("made"))).select(*dead.columns)


def merged_apart(inputs: DataFrame, others: list[tuple], oldest: int) -> DataFrame:
    """The entries (made, ...) that several compactions write, the inputs of each marked by the number (made) of its
    output; as merged() for one after the other by number. others: (smallest, largest) of the files that the output tier
    had before.

    Only one thing passes from one compaction to the next: the key ranges of the outputs, which hold deletions back. An
    output's range is that of its entries that stay in any case, and of those of its deletions that are held back. So
    only deletions outside the former can matter for it; they come to the driver in order, one partition at a time.
    """
    by = ["made", "user_key"]
    tops = inputs.where(F.col("seq") <= oldest).groupBy(*by).agg(F.max("seq").alias("__top"), F.max_by("type", "seq").alias("__top_type"))
    both = inputs.join(tops, by, "left").where(F.col("__top").isNull() | (F.col("seq") >= F.col("__top")))
    dead = F.coalesce((F.col("seq") == F.col("__top")) & (F.col("__top_type") == DELETION), F.lit(False))
    left = stored(both.select(*inputs.columns, dead.alias("__dead")), "merged")
    sure, dead = left.where("NOT __dead").drop("__dead"), left.where("__dead").drop("__dead")
    plain = lambda key: bytes(key) if isinstance(key, bytearray) else key
    ends = {r["made"]: (plain(r["low"]), plain(r["high"])) for r in sure.groupBy("made").agg(F.min("user_key").alias("low"), F.max("user_key").alias("high")).collect()}
    kind = inputs.schema["user_key"].dataType.simpleString()
    known = inputs.sparkSession.createDataFrame([(n, *e) for n, e in ends.items()], f"made bigint, low {kind}, high {kind}")
    outside = dead.join(known, "made", "left").where("low IS NULL OR user_key < low OR user_key > high").select(*by).orderBy(*by)
    cover, ranges = _Cover(), []

    def close(number: int, low, high) -> None:
        if low is not None and cover.add(low, high):
            ranges.append((number, low, high))

    for low, high in united(others):
        close(-1, low, high)
    waiting = sorted(ends, reverse=True)
    now = low = high = None
    for r in outside.toLocalIterator():
        if r["made"] != now:
            if now is not None:
                close(now, low, high)
            now = r["made"]
            while waiting and waiting[-1] < now:
                close(waiting[-1], *ends[waiting.pop()])
            if waiting and waiting[-1] == now:
                waiting.pop()
            low, high = ends.get(now, (None, None))
        key = plain(r["user_key"])
        if cover.holds(key):
            low, high = key if low is None else min(low, key), key if high is None else max(high, key)
    if now is not None:
        close(now, low, high)
    for number in reversed(waiting):
        close(number, *ends[number])
    return sure.unionByName(_held(dead, ranges))


def outputs_of(picks: list[Pick], numbers: list[int]) -> list[tuple[int, int]]:
    """(file_no, made) of the files that go into each output."""
    return [(n, number) for pick, number in zip(picks, numbers) for n in pick.inputs]


def ranges_beside(live: dict[int, dict], picks: list[Pick]) -> list[tuple]:
    """(smallest, largest) of the files from the output tier down that are not among the inputs."""
    inputs = {n for pick in picks for n in pick.inputs}
    return [(m["smallest"], m["largest"]) for n, m in live.items() if m["tier"] >= picks[0].output_tier and n not in inputs]


def merged_round(inputs: DataFrame, others: list[tuple], picks: list[Pick], oldest: int) -> DataFrame:
    """The entries (made, ...) that a round writes. inputs: their entries, with made."""
    return merged(inputs, others, oldest) if len(picks) == 1 else merged_apart(inputs, others, oldest)


def run_once(
    live: dict[int, dict], pick: Pick, number: int, path: str, oldest: int, read: Callable[[Iterable[int]], DataFrame], o: Options = DEFAULT
) -> dict | None:
    """Merge the picked files into one run at path; only they are read and only it is written. Returns its metadata, or
    None if nothing is left. live: metadata by file number."""
    mine = read(pick.inputs)
    write_run(merged(mine, ranges_beside(live, [pick]), oldest), path, o.bloom_bits_per_key)
    return run_stats(mine.sparkSession.read.schema(mine.schema).parquet(path), number, pick.output_tier)


def run_stats(run: DataFrame, number: int, tier: int) -> dict | None:
    """Metadata of one run, or None for an empty one."""
    row = file_stats(run.select("*", F.lit(number).cast("bigint").alias("file_no"), F.lit(tier).alias("tier"))).first()
    return row.asDict() if row else None


def compact_all(entries: DataFrame, oldest: int, o: Options = DEFAULT) -> DataFrame:
    """Compact until no tier is full, a round for each tier: its compactions are merged in one pass, which reads what the
    tier has and writes their outputs. Only metadata, a row for each file, is held by the driver."""
    spark = entries.sparkSession
    live = {r["file_no"]: r.asDict() for r in file_stats(entries).collect()}
    if not live:
        return entries
    schema = entries.drop("tier").schema
    path = new_path(spark, "compacted")
    entries.write.partitionBy("tier").parquet(path)
    held = {t: [spark.read.schema(schema).parquet(f"{path}/tier={t}")] for t in {m["tier"] for m in live.values()}}
    number = max(live)
    while picks := choose_round(((m["tier"], n) for n, m in live.items()), o):
        numbers = list(range(number + 1, number + 1 + len(picks)))
        number = numbers[-1]
        tiers = {live[n]["tier"] for pick in picks for n in pick.inputs}
        goes = spark.createDataFrame(outputs_of(picks, numbers), "file_no bigint, made bigint")
        inputs = _all_of(df for t in tiers for df in held[t]).join(goes, "file_no").drop("file_no")
        out = merged_round(inputs, ranges_beside(live, picks), picks, oldest)
        out = stored(out.withColumnRenamed("made", "file_no").select(*schema.names), "run")
        for pick in picks:
            for n in pick.inputs:
                del live[n]
        tier = picks[0].output_tier
        live |= {r["file_no"]: r.asDict() for r in file_stats(out.withColumn("tier", F.lit(tier))).collect()}
        held.setdefault(tier, []).append(out)
        if picks[0].input_tier == tier == o.max_tiers - 1:
            break  # the deepest tier is one file now, and nothing above it is full
    if not live:
        return entries.limit(0)
    known = spark.createDataFrame([(n, m["tier"]) for n, m in live.items()], "file_no bigint, tier int")
    rows = _all_of(df for t in {m["tier"] for m in live.values()} for df in held[t])
    return rows.join(known, "file_no").select(*entries.drop("file_no", "tier").columns, "file_no", "tier")


def _all_of(tables: Iterable[DataFrame]) -> DataFrame:
    first, *rest = tables
    for df in rest:
        first = first.unionByName(df)
    return first


def numbered(runs: DataFrame, pattern: str) -> DataFrame:
    """Adds file_no, from the path each row was read from."""
    return runs.select("*", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).cast("bigint").alias("file_no"))


def with_files(runs: DataFrame, tiers: dict[int, int], pattern: str) -> DataFrame:
    """Adds file_no, from the path each row was read from, and the file's tier."""
    known = runs.sparkSession.createDataFrame(list(tiers.items()), "file_no bigint, tier int")
    return numbered(runs, pattern).join(known, "file_no").select(*runs.columns, "file_no", "tier")


def space(entries: DataFrame) -> DataFrame:
    """One row: entries, distinct keys, live keys and entries a live key."""
    counts = entries.agg(F.count("*").alias("entries"), F.countDistinct("user_key").alias("distinct_keys"))
    live = newest(entries).where(F.col("type") == VALUE).agg(F.count("*").alias("live_keys"))
    both = counts.crossJoin(live)
    return both.withColumn("per_mille", F.floor(F.col("entries") * 1000 / F.greatest("live_keys", F.lit(1))).cast("bigint"))
