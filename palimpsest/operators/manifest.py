"""Version edits folded to live files, file numbers, and the catalogue of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def live_files(edits: DataFrame, at: int | Column | None = None) -> DataFrame:
    """(tier, file_no) live after all edits, or those up to a number. Within an edit deletions come before additions."""
    seen = edits if at is None else edits.where(F.col("edit_no") <= at)
    last = F.max_by("action", F.struct("edit_no", F.col("action") == "add")).alias("last")
    return seen.groupBy("tier", "file_no").agg(last).where("last = 'add'").select("tier", "file_no")


def live_in_any(edits: DataFrame, ats: list[int | Column]) -> DataFrame:
    """Files live in any of several pinned versions; none may be deleted."""
    out = live_files(edits, ats[0])
    for at in ats[1:]:
        out = out.union(live_files(edits, at))
    return out.distinct()


def snapshot_edits(edits: DataFrame) -> DataFrame:
    """The whole state as additions, the first record of a new manifest."""
    return live_files(edits).select(F.lit(0).cast("bigint").alias("edit_no"), F.lit("add").alias("action"), "tier", "file_no")


def parse_names(names: DataFrame) -> DataFrame:
    """(name, kind, number) of file names that belong to a store; others get nulls."""
    name = F.col("name")
    fixed = name.isin("CURRENT", "LOCK", "LOG")
    manifest = F.regexp_extract(name, r"^MANIFEST-([0-9]+)$", 1)
    number = F.regexp_extract(name, r"^([0-9]+)\.(sst|log|tmp)$", 1)
    kind = F.when(fixed, name).when(manifest != "", "MANIFEST").when(number != "", F.regexp_extract(name, r"^([0-9]+)\.(sst|log|tmp)$", 2))
    n = F.when(fixed, 0).when(manifest != "", manifest.try_cast("bigint")).when(number != "", number.try_cast("bigint"))
    return names.select("name", kind.alias("kind"), n.cast("bigint").alias("number"))


def file_name(kind: Column, number: Column) -> Column:
    return F.when(kind == "MANIFEST", F.format_string("MANIFEST-%06d", number)).when(kind.isin("CURRENT", "LOCK", "LOG"), kind).otherwise(F.format_string("%06d.%s", number, kind))


def obsolete(listed: DataFrame, live: DataFrame, min_log: int | Column, manifest_no: int | Column) -> DataFrame:
    """Listed names (name) that may go: files no version has, logs below the oldest needed, manifests older than the
    current one, all temporary files. Strangers are never touched."""
    parsed = parse_names(listed).where("kind is not null")
    known = parsed.join(live.select(F.col("file_no").alias("number"), F.lit(True).alias("is_live")).distinct(), "number", "left")
    keep = (
        F.when(F.col("kind") == "sst", F.col("is_live").isNotNull()).when(F.col("kind") == "log", F.col("number") >= min_log)
        .when(F.col("kind") == "MANIFEST", F.col("number") >= manifest_no).when(F.col("kind") == "tmp", False).otherwise(True)
    )
    return known.where(~keep).select("name", "kind", "number")


def orphans(on_disk: DataFrame, live: DataFrame) -> DataFrame:
    """One row: files and bytes on disk (file_no, file_size) that no version has."""
    lost = on_disk.join(live.select("file_no").distinct(), "file_no", "left_anti")
    return lost.agg(F.count("*").alias("orphan_files"), F.coalesce(F.sum("file_size"), F.lit(0)).cast("bigint").alias("orphan_bytes"))


def next_number(numbers: DataFrame, recorded: int | Column) -> DataFrame:
    """One row: the next file number: above the recorded one and above every number (number) seen."""
    return numbers.agg(F.greatest(F.lit(recorded) + 1, F.coalesce(F.max("number"), F.lit(0)) + 1).cast("bigint").alias("next_file_number"))


def min_live_log(log: Column, prev: Column) -> Column:
    return F.when(prev != 0, F.least(prev, log)).otherwise(log)


def version_text(live: DataFrame, sizes: DataFrame) -> DataFrame:
    """(tier, text): a tier's files as number(size B), by number."""
    each = live.join(sizes.select("file_no", "file_size"), "file_no").select("tier", "file_no", F.concat(F.col("file_no").cast("string"), F.lit("("), F.col("file_size").cast("string"), F.lit(" B)")).alias("t"))
    return each.groupBy("tier").agg(F.array_sort(F.collect_list(F.struct("file_no", "t"))).alias("f")).select("tier", F.array_join(F.col("f.t"), " ").alias("text"))
