"""What needs a total order over all rows, without a single task that sees them all.

Rows are range-sorted and stored, so that each partition is one stretch of the order. What passes from stretch to
stretch is one row for each of them, which the driver carries along. Ties are spread by whatever order ends with, so a
hot key can lie in several stretches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored

PART, AT = "__part", "__at"


def stretches(df: DataFrame, *order: Column | str) -> DataFrame:
    """df in order, with the number of each row's stretch and its place there."""
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    ordered = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return stored(ordered.withColumn(PART, F.spark_partition_id()).withColumn(AT, place), "ordered")


def _carry(ordered: DataFrame, summary: DataFrame, start, step: Callable) -> dict[int, object]:
    """What reaches each stretch from those before it: step(state, summary row) after each, beginning with start."""
    out, state = {}, start
    for r in sorted(summary.collect(), key=lambda r: r[PART]):
        out[r[PART]] = state
        state = step(state, r)
    return out


def ranked(df: DataFrame, *order: Column | str) -> DataFrame:
    """Adds rank, the 1-based place in a total order."""
    ordered = stretches(df, *order)
    before = _carry(ordered, ordered.groupBy(PART).count(), 0, lambda n, r: n + r["count"])
    starts = F.broadcast(df.sparkSession.createDataFrame(list(before.items()), f"{PART} int, __start bigint"))
    return ordered.join(starts, PART).withColumn("rank", F.col("__start") + F.col(AT) + 1).drop(PART, AT, "__start")


def running_total(df: DataFrame, value: str, name: str, *order: Column | str, inclusive: bool = True) -> DataFrame:
    """Adds name, the sum of a bigint column over all rows up to this one (or before it)."""
    ordered = stretches(df, *order)
    before = _carry(ordered, ordered.groupBy(PART).agg(F.sum(value).alias("sum")), 0, lambda n, r: n + (r["sum"] or 0))
    starts = F.broadcast(df.sparkSession.createDataFrame(list(before.items()), f"{PART} int, __start bigint"))
    w = Window.partitionBy(PART).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    total = F.col("__start") + F.coalesce(F.sum(value).over(w), F.lit(0))
    return ordered.join(starts, PART).withColumn(name, total.cast("bigint")).drop(PART, AT, "__start")


def carried(df: DataFrame, group: str | None, value: str, *order: Column | str) -> DataFrame:
    """Fills nulls of value with the last value before them, among rows of the same group (of all rows for None)."""
    by = [] if group is None else [group]
    ordered = stretches(df, *by, *order)
    of_part = ordered.groupBy(PART).agg(*(f(b, AT).alias(n) for b in by for f, n in ((F.min_by, "first"), (F.max_by, "last"))), F.count("*").alias("rows"))
    seen = ordered.where(F.col(value).isNotNull())
    if by:
        seen = seen.join(F.broadcast(of_part.select(PART, "last")), PART).where(F.col(group) == F.col("last"))
    ends = seen.groupBy(PART).agg(F.max_by(F.struct(F.col(value).alias("v")), AT).alias("end"))

    def step(state, r):
        if r["end"] is not None:
            return (r["last"] if by else None, r["end"]["v"])
        if not by or (state is not None and r["first"] == r["last"] == state[0]):
            return state
        return None

    before = _carry(ordered, of_part.join(ends, PART, "left"), None, step)
    kinds = f"{PART} int" + "".join(f", __group {df.schema[b].dataType.simpleString()}" for b in by) + f", __carried {df.schema[value].dataType.simpleString()}"
    rows = [(p, *([s[0]] if by else []), s[1]) for p, s in before.items() if s is not None]
    starts = F.broadcast(df.sparkSession.createDataFrame(rows, kinds))
    w = Window.partitionBy(PART, *by).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col(PART) == F.col("__to")
    if by:
        same = same & (F.col(group) == F.col("__group"))
    run = ordered.withColumn(value, F.last(value, ignorenulls=True).over(w)).join(starts.withColumnRenamed(PART, "__to"), same, "left")
    return run.withColumn(value, F.coalesce(value, "__carried")).select(*df.columns)
