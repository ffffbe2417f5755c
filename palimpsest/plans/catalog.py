"""All queries over the versioned log by name: the operators applied to the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import encode
from ..operators import compact, files, manifest, metrics, read, wal
from ..options import DEFAULT, Options
from ..sources import carriers as c
from ..sources import log_file, workload
from ..sources.storage import new_path, shared_dir
from ..store import StatusError, Store, properties
from ..streaming import ingest
from . import sql
from .sql import SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
__all__ = ["QUERIES", "SQL"]

MID, LOW = 6, 3


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _at(m: DataFrame, tenths: int) -> tuple[DataFrame, Column]:
    """The log with a snapshot column at so many tenths of it."""
    return c.with_snapshot(m, tenths), F.col("snap")


def _to_last(m: DataFrame) -> DataFrame:
    """The log with n, its newest sequence number, from a single row: no action runs before the query does."""
    return m.crossJoin(F.broadcast(c.last_sequence(m)))


# ---- reads


@query
def snapshot_scan(spark, d):
    return read.scan(c.mutations(spark, d))


@query
def snapshot_scan_mid(spark, d):
    return read.scan(*_at(c.mutations(spark, d), MID))


@query
def snapshot_scan_empty(spark, d):
    return read.scan(c.mutations(spark, d), 0)


@query
def point_get(spark, d):
    return read.get(c.mutations(spark, d), "key0000000000007")


@query
def point_get_tombstone(spark, d):
    m = c.mutations(spark, d).where(F.col("user_key").between("key0000000000000", "key0000000000009"))
    return read.newest(m).select("user_key", "seq", read.outcome(F.col("seq"), F.col("type")).alias("outcome"))


#: Keys that a run is asked for: some it has, some beyond its range, some never written.
ASKED = [f"key{7 * n:013d}" for n in range(30)]


@query
def run_probe(spark, d):
    """The log written as one sorted run with a Bloom filter, and read again by keys: the filter and the row groups'
    statistics stand at the scan."""
    path = new_path(spark, "run")
    m = c.mutations(spark, d)
    files.write_run(m, path)
    return read.newest(spark.read.schema(m.schema).parquet(path).where(F.col("user_key").isin(ASKED)))


@query
def multi_get_outcome(spark, d):
    return read.multi_get(c.mutations(spark, d), c.probes(spark, d))


@query
def asof_join(spark, d):
    m = c.mutations(spark, d)
    n = F.broadcast(c.last_sequence(m))
    probes = c.probes(spark, d).crossJoin(n).select("probe_id", "user_key", (F.col("probe_id") * 37 % (F.col("n") + 1)).alias("snap"))
    return read.as_of(m, probes)


def _targets(spark, d):
    return c.table(spark, d, "nation").select(c.key(F.col("n_nationkey") * 7).alias("target"))


@query
def seek_first_ge(spark, d):
    return read.seek_all(read.scan(c.mutations(spark, d)), _targets(spark, d))


@query
def predecessor(spark, d):
    return read.seek_all(read.scan(c.mutations(spark, d)), _targets(spark, d), backwards=True)


@query
def first_key(spark, d):
    return read.first_key(c.mutations(spark, d))


@query
def last_key(spark, d):
    return read.last_key(c.mutations(spark, d))


@query
def range_scan(spark, d):
    return read.range_scan(c.mutations(spark, d), "key0000000000020", "key0000000000060")


@query
def prefix_scan(spark, d):
    return read.prefix_scan(c.mutations(spark, d), "key00000000000")


@query
def reverse_scan(spark, d):
    return read.reverse_scan(c.mutations(spark, d))


@query
def version_history(spark, d):
    return read.history(c.mutations(spark, d))


def _two_snapshots(m: DataFrame) -> tuple[DataFrame, Column, Column]:
    n = F.broadcast(c.last_sequence(m))
    return m.crossJoin(n), (F.col("n") * LOW / 10).cast("bigint"), (F.col("n") * MID / 10).cast("bigint")


@query
def snapshot_diff(spark, d):
    return read.diff(*_two_snapshots(c.mutations(spark, d)))


@query
def common_keys(spark, d):
    return read.common_keys(*_two_snapshots(c.mutations(spark, d)))


@query
def source_union_scan(spark, d):
    """Buffer, frozen buffer and files read as one."""
    m = c.mutations(spark, d)
    parts = [m.where(F.col("seq") % 3 == k) for k in range(3)]
    return read.scan(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query
def ordered_scan(spark, d):
    """The scan with each key's place in key order."""
    return read.ordered_scan(c.mutations(spark, d))


@query
def internal_order(spark, d):
    """Every version's place in the order of a run: key up, newest first."""
    return read.internal_order(c.mutations(spark, d))


@query
def seek_next(spark, d):
    """The three live keys from each target on."""
    return read.seek_next(read.scan(c.mutations(spark, d)), _targets(spark, d), 3)


@query
def absent_in_range(spark, d):
    """Probes inside the key range of a log without the keys that end in 3 or 7."""
    m = c.mutations(spark, d).where(~F.substring("user_key", -1, 1).isin("3", "7"))
    ends = F.broadcast(m.agg(F.min("user_key").alias("first"), F.max("user_key").alias("last")))
    inside = c.probes(spark, d).crossJoin(ends).where(F.col("user_key").between(F.col("first"), F.col("last")))
    return inside.join(m, "user_key", "left_anti").select("probe_id", "user_key")


# ---- files


def _entries(spark, d):
    return c.entries(c.mutations(spark, d))


def _meta(spark, d):
    return files.file_stats(_entries(spark, d))


@query
def flush_file_stats(spark, d):
    return _meta(spark, d)


@query
def tier_summary(spark, d):
    return files.tier_summary(_meta(spark, d))


@query
def overlapping_files(spark, d):
    """How many other files each file's key range overlaps."""
    return files.overlaps(_meta(spark, d))


@query
def overlapping_inputs(spark, d):
    """The files beside which each file of the next compaction lies."""
    meta = _meta(spark, d)
    inputs = meta.join(compact.picked(meta, Options(tier_trigger=2)).select("file_no"), "file_no", "left_semi")
    return files.overlapping(inputs, meta)


@query
def files_consulted_per_probe(spark, d):
    return files.consulted(c.probes(spark, d), _meta(spark, d))


@query
def first_hit_lookup(spark, d):
    return files.first_hit(_entries(spark, d))


@query
def first_hit_is_newest(spark, d):
    """The invariant that compaction keeps: the first hit in search order is the newest version."""
    e = _entries(spark, d)
    newest = read.newest(e).select("user_key", F.col("seq").alias("newest_seq"))
    return files.first_hit(e).select("user_key", F.col("seq").alias("first_seq")).join(newest, "user_key")


@query
def order_violations(spark, d):
    """Files of odd numbers as the log wrote them, unsorted; the others sorted."""
    placed = encode.in_file_order(_entries(spark, d)).withColumn("pos", F.when(F.col("file_no") % 2 == 1, F.col("seq")).otherwise(F.col("pos")))
    return files.order_violations(placed)


@query
def dump_totals(spark, d):
    return files.dump_totals(_entries(spark, d))


@query
def dump_entries(spark, d):
    """A dump's line for each entry, in file order."""
    e = encode.in_file_order(_entries(spark, d))
    kind = F.when(F.col("type") == 1, "PUT").otherwise("DEL")
    value = F.coalesce("value", F.lit(""))
    return e.select("file_no", "pos", encode.printable(F.col("user_key")).alias("key"), "seq", kind.alias("kind"), F.octet_length(value).cast("bigint").alias("value_bytes"), encode.printable(value, 24).alias("value"))


@query
def dump_ratio(spark, d):
    """File bytes to user bytes, in thousandths: entries as they lie in blocks (keys sharing nothing), with four bytes for
    each restart point and for their number."""
    p = _placed(spark, d)
    cut = encode.cut_blocks(p.select("file_no", "pos", "size"), BLOCK)
    blocks = p.join(cut, ["file_no", "pos"]).groupBy("file_no", "block_no").agg(F.sum("size").alias("bytes"), F.count("*").alias("entries"))
    restarts = F.floor((F.col("entries") + DEFAULT.restart_interval - 1) / DEFAULT.restart_interval)
    sizes = blocks.groupBy("file_no").agg(F.sum(F.col("bytes") + 4 * restarts + 4).alias("file_bytes"))
    user = files.dump_totals(_entries(spark, d)).select("file_no", (F.col("key_bytes") + F.col("value_bytes")).alias("user_bytes"))
    return sizes.join(user, "file_no").select("file_no", "file_bytes", "user_bytes", F.floor(F.col("file_bytes") * 1000 / F.col("user_bytes")).cast("bigint").alias("per_mille"))


@query
def flush_tiers(spark, d):
    return _entries(spark, d).select("file_no", "tier").distinct()


# ---- compaction


PICKS = [(1, 7), (2, 7), (3, 7), (2, 3), (2, 2), (1, 1)]


@query
def compact_pick(spark, d):
    """The next compaction over the steady tiers, at several settings: a deeper tier, the fold into the last tier, and
    the last tier into itself among them."""
    meta, out = _meta(spark, d), None
    for trigger, tiers in PICKS:
        capped = meta.withColumn("tier", F.least("tier", F.lit(tiers - 1)))
        one = compact.picked(capped, Options(tier_trigger=trigger, max_tiers=tiers)).select(F.lit(trigger).alias("trigger"), F.lit(tiers).alias("tiers"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def _log_entries(e: DataFrame) -> DataFrame:
    return e.select("seq", "type", "user_key", "value")


def _compacted(spark, d, tenths: int = 10) -> DataFrame:
    """All entries judged as one compaction with the oldest snapshot at so many tenths of the log; n is its end."""
    e = _to_last(_entries(spark, d))
    return compact.judged(e, [], (F.col("n") * tenths / 10).cast("bigint"))


@query
def compact_no_snapshot(spark, d):
    return _log_entries(_compacted(spark, d).where("fate = 'kept'"))


@query
def compact_with_snapshot(spark, d):
    return _log_entries(_compacted(spark, d, LOW).where("fate = 'kept'"))


@query
def compact_tombstones_blocked(spark, d):
    """The two shallowest tiers merged: files of deeper tiers hold deletions back."""
    e = _to_last(_entries(spark, d))
    deeper = files.file_stats(e).where("tier >= 2")
    return _log_entries(compact.merged(e.where("tier < 2"), deeper, F.col("n")))


@query
def compact_then_scan(spark, d):
    """A scan after compaction equals the scan before it, for snapshots from the oldest live one on."""
    kept = _compacted(spark, d, LOW).where("fate = 'kept'")
    return read.scan(kept, (F.col("n") * MID / 10).cast("bigint"))


@query
def dropped_by_rule(spark, d):
    return _compacted(spark, d, LOW).groupBy("fate").agg(F.count("*").alias("entries"))


@query
def reclaim_ratio(spark, d):
    return compact.space(_entries(spark, d))


@query
def oldest_snapshot(spark, d):
    m = c.mutations(spark, d)
    some = c.last_sequence(m).select("n", F.explode(F.array(F.lit(LOW), F.lit(MID))).alias("tenths")).select((F.col("n") * F.col("tenths") / 10).cast("bigint").alias("seq"))
    both = compact.oldest_snapshot(m, some).withColumn("snapshots", F.lit("with"))
    return both.unionByName(compact.oldest_snapshot(m, some.where("false")).withColumn("snapshots", F.lit("without")))


@query
def compact_loop(spark, d):
    """Every flush into tier 0, compacted until no tier is full: files and entries of each tier, and the live keys."""
    flushed = c.flush_units(c.mutations(spark, d)).withColumn("tier", F.lit(0))
    last = flushed.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    done = compact.compact_all(flushed, last)
    return done.groupBy("tier").agg(F.countDistinct("file_no").alias("files"), F.count("*").alias("entries"), F.count_if(F.col("type") == 1).alias("puts"))


# ---- manifest


@query
def manifest_fold(spark, d):
    return manifest.live_files(c.edits(c.mutations(spark, d)))


@query
def live_files_union(spark, d):
    e = c.edits(c.mutations(spark, d))
    return manifest.live_in_any(e, [9, 1 << 62])


@query
def obsolete_files(spark, d):
    e = c.edits(c.mutations(spark, d))
    made = e.where("action = 'add'").select(manifest.file_name(F.lit("sst"), F.col("file_no")).alias("name"))
    ten = spark.range(10)
    for kind in ("log", "tmp", "MANIFEST"):
        made = made.union(ten.select(manifest.file_name(F.lit(kind), F.col("id")).alias("name")))
    listed = made.union(spark.createDataFrame([("CURRENT",), ("LOCK",), ("notes.txt",)], "name string"))
    return manifest.obsolete(listed, manifest.live_files(e), 4, 3)


@query
def orphan_bytes(spark, d):
    return manifest.orphans(_meta(spark, d), manifest.live_files(c.edits(c.mutations(spark, d))))


@query
def next_file_number(spark, d):
    return manifest.next_number(c.edits(c.mutations(spark, d)).select(F.col("file_no").alias("number")), 99)


@query
def min_live_log(spark, d):
    n = c.table(spark, d, "nation")
    low = manifest.min_live_log(F.col("n_nationkey"), F.col("n_regionkey"))
    return n.select(F.col("n_nationkey").alias("log"), F.col("n_regionkey").alias("prev"), low.alias("min_log"))


@query
def catalog_parse(spark, d):
    return manifest.parse_names(spark.createDataFrame([(n,) for n in sql.NAMES], "name string"))


@query
def version_text(spark, d):
    meta = _meta(spark, d)
    made = meta.groupBy((F.floor(F.col("file_no") / DEFAULT.tier_trigger) + 100000).alias("file_no")).agg(F.sum("file_size").alias("file_size"))
    sizes = meta.select("file_no", "file_size").unionByName(made)
    return manifest.version_text(manifest.live_files(c.edits(c.mutations(spark, d))), sizes)


# ---- log


def _batches(spark, d):
    return c.batches(c.mutations(spark, d))


def _records(spark, d):
    return c.wal_records(c.mutations(spark, d))


@query
def batch_explode(spark, d):
    return wal.exploded(_batches(spark, d))


@query
def sequence_assign(spark, d):
    return wal.assigned(_records(spark, d))


@query
def torn_tail(spark, d):
    return wal.valid_prefix(_records(spark, d)).select("log_no", "rec_no", "batch_no", "base_seq")


@query
def recover_logs(spark, d):
    return wal.recovered(_records(spark, d), 1)


@query
def good_offset(spark, d):
    return wal.good_offset(_records(spark, d))


@query
def group_commit(spark, d):
    return wal.commit_groups(_records(spark, d), small=400, large=1000)


@query
def recovery_units(spark, d):
    """The runs that replaying each log writes, with a buffer of 1,500 bytes."""
    return wal.recovery_units(_records(spark, d), 1500)


@query
def batch_append(spark, d):
    """Every three batches appended to one, their operations numbered on."""
    whole = wal.appended(_batches(spark, d), F.floor(F.col("batch_no") / 3).cast("bigint"))
    return whole.select("group_no", "base_seq", "n_ops", F.explode("ops").alias("op")).select("group_no", "base_seq", "n_ops", "op.seq", "op.type", "op.user_key")


@query
def batch_last_op_wins(spark, d):
    return wal.last_op_wins(_batches(spark, d))


@query
def memtable_freeze(spark, d):
    return wal.frozen(_batches(spark, d), 1000)


@query
def input_validation(spark, d):
    cases = spark.createDataFrame([(k, v) for k in sql.KEY_SIZES for v in sql.VALUE_SIZES], "key_bytes int, value_bytes int")
    return cases.select("key_bytes", "value_bytes", wal.validation(F.col("key_bytes"), F.col("value_bytes")).alias("status"))


@query
def write_amplification(spark, d):
    """Writes, commits and synced commits of the log, and writes for each sync."""
    b = _batches(spark, d)
    sums = b.agg(F.sum(F.size("ops")).alias("writes"), F.count("*").alias("commits"), F.count_if("sync").alias("syncs"))
    return sums.withColumn("writes_per_sync_pct", F.floor(F.col("writes") * 100 / F.col("syncs")).cast("bigint"))


# ---- metrics


@query
def counter_reduce(spark, d):
    return metrics.reduce_counters(c.counters(spark, d))


@query
def hist_buckets(spark, d):
    return metrics.histogram(c.samples(spark, d))


@query
def hist_merge(spark, d):
    return metrics.merge_histograms(metrics.histogram(c.samples(spark, d), "shard"))


@query
def hist_summary(spark, d):
    return metrics.summary(c.samples(spark, d))


@query
def hist_percentiles(spark, d):
    return metrics.percentiles(metrics.histogram(c.samples(spark, d)), [500, 900, 990, 999, 1000])


@query
def hist_report(spark, d):
    return metrics.report(c.samples(spark, d))


@query
def openloop_validity(spark, d):
    e = c.table(spark, d, "events")
    i = F.floor(F.col("event_id") / 4).cast("bigint")
    ops = e.select((F.col("user_id") % 4).alias("run"), i.alias("i"), (i * 1_000_000 + F.floor(F.col("value") * 20000)).cast("bigint").alias("done_us"))
    return metrics.open_loop(ops, 1_000_000)


@query
def store_properties(spark, d):
    return properties(_meta(spark, d))


QUERIES["properties"] = QUERIES.pop("store_properties")


# ---- encodings


@query
def packed_tag(spark, d):
    tagged = c.mutations(spark, d).select("seq", "type", encode.packed(F.col("seq"), F.col("type")).alias("packed"))
    seq, kind = encode.unpacked(F.col("packed"))
    return tagged.select("*", seq.alias("seq_back"), kind.cast("bigint").alias("type_back"))


@query
def internal_key_valid(spark, d):
    """Every third key has a type that there is not, and every fifth is cut to seven bytes."""
    kind = F.when(F.col("seq") % 3 == 0, F.col("type") + 2).otherwise(F.col("type"))
    whole = encode.internal_key(F.col("user_key"), F.col("seq"), kind)
    k = c.mutations(spark, d).select("seq", F.when(F.col("seq") % 5 == 0, F.substring(whole, 1, 7)).otherwise(whole).alias("k"))
    return k.select("seq", F.length("k").alias("key_bytes"), encode.valid_internal_key(F.col("k")).alias("valid"))


@query
def shared_prefix(spark, d):
    e = encode.in_file_order(_entries(spark, d))
    return e.select("file_no", "pos", encode.shared_prefix(F.col("before"), F.col("user_key")).alias("shared"))


BLOCK = 1024


def _placed(spark, d):
    size = F.octet_length("user_key") + 11 + F.coalesce(F.octet_length("value"), F.lit(0))
    return encode.in_file_order(_entries(spark, d)).select("file_no", "pos", "user_key", "seq", size.alias("size"))


@query
def block_cut(spark, d):
    return encode.cut_blocks(_placed(spark, d).select("file_no", "pos", "size"), BLOCK)


@query
def restart_points(spark, d):
    """The first entry of each block and every sixteenth after it."""
    cut = encode.cut_blocks(_placed(spark, d).select("file_no", "pos", "size"), BLOCK)
    first = cut.groupBy("file_no", "block_no").agg(F.min("pos").alias("first"))
    return cut.join(first, ["file_no", "block_no"]).where((F.col("pos") - F.col("first")) % DEFAULT.restart_interval == 0).select("file_no", "block_no", "pos")


@query
def index_separators(spark, d):
    p = _placed(spark, d)
    return encode.separators(p.join(encode.cut_blocks(p.select("file_no", "pos", "size"), BLOCK), ["file_no", "pos"]))


@query
def block_count(spark, d):
    cut = encode.cut_blocks(_placed(spark, d).select("file_no", "pos", "size"), BLOCK)
    return cut.groupBy("file_no").agg(F.countDistinct("block_no").alias("blocks"))


@query
def block_layout_exact(spark, d):
    """Byte-exact blocks of each file, prefixes shared over whole internal keys."""
    return encode.block_layout(_entries(spark, d), DEFAULT.block_size, DEFAULT.restart_interval)


@query
def varint_length(spark, d):
    return c.samples(spark, d).select("v").distinct().select("v", wal.varint_bytes(F.col("v")).alias("bytes"))


@query
def varint_bytes(spark, d):
    return c.samples(spark, d).select("v").distinct().select("v", F.hex(encode.varint(F.col("v"))).alias("bytes"))


@query
def fixed_bytes(spark, d):
    return c.mutations(spark, d).select("seq", F.hex(encode.little_endian(F.col("seq"), 4)).alias("bytes"))


@query
def file_names(spark, d):
    name = manifest.file_name
    return _meta(spark, d).select("file_no", name(F.lit("sst"), F.col("file_no")).alias("sst"), name(F.lit("MANIFEST"), F.col("file_no")).alias("manifest"))


@query
def printable_keys(spark, d):
    keys = c.mutations(spark, d).select("user_key").distinct()
    return keys.select("user_key", encode.printable(F.concat("user_key", F.lit("\0é"))).alias("shown"))


@query
def hot_keys(spark, d):
    """Nine draws in ten from the first hundredth of the keys."""
    e = c.table(spark, d, "events").select("event_id")
    n = F.broadcast(e.agg(F.count("*").alias("n")))
    draw = F.when(F.col("event_id") % 100 < 90, F.col("event_id") % (F.floor(F.col("n") / 100) + 1)).otherwise(F.col("event_id") % F.col("n"))
    return e.crossJoin(n).select("event_id", draw.cast("bigint").alias("draw"))


@query
def block_cache_keys(spark, d):
    """File number and the block's offset, that is the bytes of the blocks before it."""
    p = _placed(spark, d)
    sizes = p.join(encode.cut_blocks(p.select("file_no", "pos", "size"), BLOCK), ["file_no", "pos"]).groupBy("file_no", "block_no").agg(F.sum("size").alias("bytes"))
    offset = F.coalesce(F.sum("bytes").over(Window.partitionBy("file_no").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.select("file_no", F.col("block_no").alias("block"), (F.col("file_no") * (1 << 32) + offset).alias("cache_key"))


@query
def crc32c_records(spark, d):
    """CRC-32C of every value, tombstones as empty."""
    return c.mutations(spark, d).select("seq", encode.crc32c(F.coalesce(F.col("value"), F.lit("")).cast("binary")).alias("crc"))


@query
def hash64_keys(spark, d):
    return c.mutations(spark, d).select("user_key").distinct().select("user_key", encode.hash64(F.col("user_key").cast("binary")).alias("hash"))


@query
def block_checksums(spark, d):
    """CRC-32C of each block: its keys, each followed by its value, in order."""
    p = encode.in_file_order(_entries(spark, d)).select("file_no", "pos", F.concat("user_key", F.coalesce("value", F.lit(""))).alias("data"))
    cut = encode.cut_blocks(_placed(spark, d).select("file_no", "pos", "size"), BLOCK)
    rows = p.join(cut, ["file_no", "pos"]).groupBy("file_no", "block_no").agg(F.array_sort(F.collect_list(F.struct("pos", "data"))).alias("e"))
    return rows.select("file_no", "block_no", encode.crc32c(F.array_join(F.col("e.data"), "").cast("binary")).alias("crc"))


@query
def probe_positions(spark, d):
    """The bits that each key sets in a filter of 4,096 bits with six probes."""
    keys = c.mutations(spark, d).select("user_key").distinct().select("user_key", encode.hash64(F.col("user_key").cast("binary")).alias("h"))
    at = encode.probe_positions(F.col("h"), 4096, 6)
    return keys.select("user_key", F.posexplode(at).alias("i", "bit")).select("user_key", F.col("i").cast("bigint").alias("i"), "bit")


@query
def bloom_build(spark, d):
    """The words of a filter over all keys, of ten bits a key."""
    keys = c.mutations(spark, d).select(F.col("user_key").alias("key")).distinct()
    return encode.bloom_words(keys, 4096, encode.probe_count(10))


@query
def bloom_excludes(spark, d):
    """What a filter over the keys of the log's first half says of all probes, beside whether it has them."""
    m = _to_last(c.mutations(spark, d))
    keys = m.where(F.col("seq") * 2 <= F.col("n")).select(F.col("user_key").alias("key")).distinct()
    maybe = encode.may_contain(c.probes(spark, d).select(F.col("user_key").alias("key")), encode.bloom_words(keys, 4096, 6), 4096, 6)
    return maybe.join(keys.withColumn("there", F.lit(True)), "key", "left").select("key", "maybe", F.coalesce("there", F.lit(False)).alias("there"))


@query
def bloom_fpr(spark, d):
    """False-positive share of filters over 20,000 keys, measured with 100,000 absent ones, at 4, 10 and 16 bits."""
    keys = spark.range(20_000).select(F.concat(F.lit("key:"), F.col("id")).alias("key"))
    absent = spark.range(100_000).select(F.concat(F.lit("absent:"), F.col("id")).alias("key"))
    out = None
    for per_key in (4, 10, 16):
        bits, k = encode.filter_bits(20_000, per_key), encode.probe_count(per_key)
        hit = encode.may_contain(absent, encode.bloom_words(keys, bits, k), bits, k)
        row = hit.agg(F.lit(per_key).alias("bits_per_key"), F.lit(k).alias("probes"), F.count_if("maybe").alias("false_positives"), F.count("*").alias("probed"))
        out = row if out is None else out.unionByName(row)
    return out


@query
def block_lookup(spark, d):
    """The block of each file that an index search takes each probe's key to: the first whose last key is not below it.
    A row for each probe and file is the query's result, so the work is one pass that makes them, see files.looked_up."""
    p = _placed(spark, d)
    index = encode.separators(p.join(encode.cut_blocks(p.select("file_no", "pos", "size"), BLOCK), ["file_no", "pos"]))
    return files.looked_up(c.probes(spark, d), index)


@query
def wal_scan_raw(spark, d):
    """The log as bytes, scanned record by record up to the first damage."""
    found = log_file.scan_logs(log_file.write_logs(_records(spark, d)))
    return found.select("log_no", F.size("payloads").cast("bigint").alias("records"), "stopped", "good_offset")


@query
def wal_replay_raw(spark, d):
    return log_file.replayed(log_file.scan_logs(log_file.write_logs(_records(spark, d))))


@query
def backpressure(spark, d):
    """What writers meet if a compaction only begins after every sixteenth flush."""
    flushed = _meta(spark, d).select("file_no", (F.col("file_no") % 16 + 1).alias("tier0_files"))
    return flushed.select("file_no", "tier0_files", metrics.pressure(F.col("tier0_files")).alias("writers"))


@query
def workload_fillseq(spark, d):
    return workload.sequential(spark, 4000, 4)


def _drawn(spark, kind: str) -> DataFrame:
    return workload.keys(spark, kind, 4000, 4).select("thread", "i", "n", "user_key")


@query
def workload_fillrandom(spark, d):
    return _drawn(spark, "fillrandom")


@query
def workload_readrandom(spark, d):
    return _drawn(spark, "readrandom")


@query
def workload_readhot(spark, d):
    return _drawn(spark, "readhot")


@query
def workload_readmissing(spark, d):
    """Odd probes, against a preload of even keys."""
    loaded = spark.range(2000).select(workload.baseline(4000, F.col("id")).alias("user_key"), F.lit(True).alias("found"))
    probed = _drawn(spark, "readmissing").join(loaded, "user_key", "left")
    return probed.select("thread", "i", "n", F.coalesce("found", F.lit(False)).alias("found"))


@query
def workload_mixed(spark, d):
    """Two writers and four readers at once: each one's operations and different keys, and how many reads found a key
    that some writer has written."""
    ops = workload.mixed(spark, 4000, 1000, 2, 4)
    written = ops.where("role = 'write'").select("n").distinct().withColumn("found", F.lit(True))
    both = ops.join(written, "n", "left")
    return both.groupBy("role", "thread").agg(F.count("*").alias("ops"), F.countDistinct("n").alias("different_keys"), F.count_if((F.col("role") == "read") & F.col("found")).alias("found"))


@query
def height_draws(spark, d):
    """The generator of tower heights from several seeds."""
    return workload.height_draws(spark, [1, 7, 48271, 2147483646], 200)


@query
def status_text(spark, d):
    """How an operation's failure reads, with and without a message."""
    return spark.createDataFrame([(code, text, str(StatusError(code, text))) for code in sql.CODES for text in ("", "no such file")], "code string, message string, shown string")


@query
def workload_baseline(spark, d):
    """The raw append: keys in order with a fixed value, and the bytes they make."""
    return workload.sequential(spark, 4000, 1).agg(F.count("*").alias("ops"), F.sum(F.octet_length("user_key") + 100).alias("bytes"))


# ---- whole stores


@query
def store_session(spark, d):
    """The log as a store's files; under a snapshot, keys are deleted and all tiers of two files or more compacted; then
    it is read at the snapshot."""
    s = Store(spark, Options(tier_trigger=2), entries=_entries(spark, d))
    with s.snapshot() as at:
        s.write([(0, f"key{n:013d}", None) for n in range(0, 100, 3)])
        s.compact()
        return s.scan(at)


@query
def store_reopened(spark, d):
    """The nation's keys put in a store, some deleted, the store left without closing and opened again: the log is
    replayed. Values and sequence numbers as they are found."""
    rows = [(r["n_nationkey"], r["n_name"]) for r in c.table(spark, d, "nation").orderBy("n_nationkey").collect()]
    s = Store(spark, Options(tier_trigger=2))
    for i, (n, name) in enumerate(rows):
        s.write([(1, f"n{n:03d}", name), (1, f"last{n % 3}", str(n))])
        if i % 9 == 8:
            s.flush()
    s.compact()
    for n, _ in rows:
        if n % 4 == 0:
            s.delete(f"n{n:03d}")
    again = Store(spark, Options(tier_trigger=2), path=s.folder.path)
    return read.newest(again.log())


@query
def stream_ingest_scan(spark, d):
    """The event stream ingested in micro-batches as tier-0 runs, then read."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    # As a pattern, the path may be one file or a folder of them.
    stream = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parque[t]")
    dead = F.col("event_type") == "error"
    m = stream.select((F.col("event_id") + 1).alias("seq"), F.when(dead, 0).otherwise(1).alias("type"), c.key("user_id").alias("user_key"), F.when(~dead, F.concat("event_type", F.lit(":"), "props")).alias("value"))
    ingest.ingest_runs(m, path, f"{path}-checkpoint").awaitTermination()
    return read.scan(ingest.runs(spark, path))
