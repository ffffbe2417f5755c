"""Mixing sources to target weights by entropy balancing.

Of all document rates with the required tokens in every source and no rate above 2, the one nearest to the input
(least sum of r*log(r) - r over documents) is r = min(2, exp(lambda[source] * x)), where x is the document's size over
its source's mean size. The dual has one variable for each source, is convex, and its gradient and curvature are sums
over documents, so each Newton iteration is one grouped aggregation. Steps that leave a source's bracket are halved
back into it. Sums are taken in decimals, so that reruns agree whatever order tasks end in.

The rates are rounded into whole copies by error feedback, largest documents first: a document takes the number of
copies that brings its group nearest to the sum of rates times sizes so far. A source's documents of over 1/1000 of
its tokens (at most 1000) form one group, and what their rounding leaves over is carried into the others, which are
dealt by hash into groups of about 2000.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, shuffled, table, unused

SHARE = Fraction(3, 2)
WEIGHTS = (3, 1, 2)
MOST_COPIES = 2
BROADCAST_SOURCES = 10_000
HEAVY_PARTS = 1000
GROUP_ROWS = 2000
_MOST_STEPS = 80
_TOLERANCE = 1e-7


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def ranked(sources: DataFrame) -> DataFrame:
    """Adds place, the 0-based place of the (unique) source by code point, null last. The only thing collected is a
    count for each partition."""
    spark = sources.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").asc_nulls_last()]
    spread = sources.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def number(batches):
        from pyspark import TaskContext

        import pyarrow as pa

        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            cols = [*b.columns, pa.array(np.full(b.num_rows, part, np.int64)), pa.array(n + np.arange(b.num_rows))]
            n += b.num_rows
            yield pa.record_batch(cols, names=[*b.schema.names, "part", "local"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sources.schema)
    local = materialize(spread.mapInArrow(number, f"{kinds}, part bigint, local bigint"), "mix-places")
    at, starts = 0, []
    for row in sorted(local.groupBy("part").count().collect()):
        starts.append((row["part"], at))
        at += row["count"]
    first = spark.createDataFrame(starts, "part bigint, first bigint")
    return local.join(F.broadcast(first), "part").withColumn("place", F.col("first") + F.col("local")).drop("part", "local", "first")


def targets(sources: DataFrame, share: Fraction = SHARE, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, source_size, n_docs): `share` of all sizes dealt by the
    weights, none over MOST_COPIES times its source's size. Pairs of sums are all that the driver sees."""
    turn = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    dealt = materialize(ranked(sources).withColumn("weight", turn.cast("bigint")), "mix-dealt")
    most = F.col("source_size") * MOST_COPIES
    whole = share * (dealt.agg(F.sum("source_size")).first()[0] or 0)
    level = Fraction(0)  # tokens for each unit of weight
    while True:
        free = F.col("weight") * F.lit(float(level)) < most
        sums = dealt.agg(
            F.sum(F.when(~free, most)).alias("full"), F.sum(F.when(free, F.col("weight"))).alias("weight")
        ).first()
        if not sums["weight"]:
            break
        new = (whole - (sums["full"] or 0)) / sums["weight"]
        if new <= level:
            break
        level = new
    target = F.least(F.col("weight") * F.lit(float(level)), most.cast("double"))
    return dealt.select("source", "source_size", "n_docs", target.alias("target"))


def _with_state(rows: DataFrame, state: DataFrame, n_sources: int) -> DataFrame:
    """Join by source; the state has one row for each source and is broadcast only below a checked number of them."""
    state = state.withColumnRenamed("source", "source_of")
    small = F.broadcast(state) if n_sources <= BROADCAST_SOURCES else state
    return rows.join(small, rows["source"].eqNullSafe(small["source_of"])).drop("source_of")


def _rate() -> F.Column:
    tilt = F.exp(F.least(F.col("lam") * F.col("size") * F.col("n_docs") / F.greatest("source_size", F.lit(1)), F.lit(50.0)))
    return F.when(F.col("full"), F.lit(float(MOST_COPIES))).otherwise(F.least(tilt, F.lit(float(MOST_COPIES))))


def balance(rows: DataFrame, aims: DataFrame) -> DataFrame:
    """(source, source_size, n_docs, target, full, lam): the dual's solution for every source.

    rows: (source, size, ...), one for each document; aims: as from targets(). A source whose target is its most has
    full = true; one with a target of 0 or no tokens gets the least lam.
    """
    n = aims.count()
    groups = materialize(rows.groupBy("source", "size").agg(F.sum("n").alias("n")), "mix-sizes")
    full = F.col("target") >= F.col("source_size") * MOST_COPIES * (1 - 1e-12)
    start = F.log(F.greatest(F.col("target"), F.lit(1e-9)) / F.greatest(F.col("source_size"), F.lit(1)))
    state = aims.withColumn("full", full).withColumn("lam", start)
    state = state.withColumns({"lo": F.lit(-1e6), "hi": F.lit(1e6), "done": full | (F.col("target") <= 0)})
    state = materialize(state, "mix-state")
    for _ in range(_MOST_STEPS):
        if state.where("not done").isEmpty():
            break
        each = _with_state(groups, state.where("not done"), n).withColumn("r", _rate())
        tokens = F.col("n") * F.col("size") * F.col("r")
        bend = F.when(F.col("r") < MOST_COPIES, tokens * F.col("size") * F.col("n_docs") / F.greatest("source_size", F.lit(1)))
        sums = each.groupBy("source").agg(
            F.sum(tokens.cast("decimal(30,6)")).cast("double").alias("got"),
            F.coalesce(F.sum(bend.cast("decimal(30,6)")).cast("double"), F.lit(0.0)).alias("bend"),
        )
        joined = state.join(sums.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        over = F.col("got") - F.col("target")
        lo = F.when(over < 0, F.greatest("lo", "lam")).otherwise(F.col("lo"))
        hi = F.when(over > 0, F.least("hi", "lam")).otherwise(F.col("hi"))
        stepped = joined.withColumns({"lo2": lo, "hi2": hi, "step": F.col("lam") - over / F.greatest("bend", F.lit(1e-9))})
        inside = (F.col("step") > F.col("lo2")) & (F.col("step") < F.col("hi2"))
        wide = (F.col("hi2") > 1e5) | (F.col("lo2") < -1e5)
        other = F.when(wide, F.col("lam") + F.when(over < 0, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.greatest(F.abs("lam"), F.lit(1.0)))
        near = F.abs(over) <= F.greatest(F.lit(_TOLERANCE) * F.col("target"), F.lit(1e-3))
        close = (F.col("hi2") - F.col("lo2")) <= 1e-12 * F.greatest(F.abs("lam"), F.lit(1.0))
        done = F.col("done") | F.coalesce(near | close, F.lit(True))
        bounded = F.when(inside & (F.abs(F.col("step") - F.col("lam")) < 1e3), F.col("step"))
        lam = F.when(done, F.col("lam")).otherwise(F.coalesce(bounded, other, (F.col("lo2") + F.col("hi2")) / 2))
        new = materialize(
            stepped.select("source", "source_size", "n_docs", "target", "full", lam.alias("lam"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), done.alias("done")),
            "mix-state",
        )
        discard(state)
        state = new
    return state.drop("lo", "hi", "done")


_ROUNDED = "doc_id bigint, no_id boolean, source string, size bigint, own bigint, n bigint, copies bigint, left double"


def _round(group: pd.DataFrame) -> pd.DataFrame:
    """Copies for one group of rows; copies counts those of all n equal rows."""
    group = group.sort_values(["size", "doc_id", "own"], ascending=[False, True, True], kind="stable")
    want, taken, copies = float(group["carry"].iloc[0]), 0, []
    for size, n, rate in zip(group["size"], group["n"], group["rate"]):
        if size == 0:
            copies.append(n)
            continue
        want += rate * size * n
        c = min(MOST_COPIES * n, max(0, math.floor((want - taken) / size + 0.5)))
        copies.append(c)
        taken += c * size
    out = group[["doc_id", "no_id", "source", "size", "own", "n"]].copy()
    out["copies"] = copies
    out["left"] = 0.0
    out.iloc[0, out.columns.get_loc("left")] = want - taken
    return out


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, own, n): equal ones counted together; own tells documents without an id apart, by a hash of
    their text."""
    size = word_count(F.col("text").cast("string"))
    doc_id = F.col("doc_id").cast("bigint")
    own = F.when(doc_id.isNull(), F.xxhash64("text")).otherwise(0)
    ids = docs.select(doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), own.alias("own"))
    return ids.groupBy("doc_id", "source", "size", "own").agg(F.count("*").alias("n"))


def mix(docs: DataFrame, share: Fraction = SHARE, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, source, size, own, n, source_size, target, copies): for each different (doc_id, source, size, own), how many
    copies the mix takes of its n rows together, from 0 to 2n.

    Null text has size 0, a null source is a source of its own, placed last; own is 0 but for documents without an id, which
    it tells apart by their text. Texts of any length are counted whole. A text
    without words is taken once. An empty table gives an empty result. Reads doc_id, source and text only.
    """
    rows = materialize(sized(docs), "mix-rows")
    sources = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    aims = materialize(targets(sources, share, weights), "mix-aims")
    n = aims.count()
    state = balance(rows, aims)
    rated = _with_state(rows, state, n).withColumn("rate", _rate())
    heavy = F.col("size") * HEAVY_PARTS > F.col("source_size")
    # Pandas would turn a column of integers with nulls into floats.
    rated = rated.withColumns({"no_id": F.col("doc_id").isNull(), "doc_id": F.coalesce("doc_id", F.lit(0))})
    columns = ["doc_id", "no_id", "source", "size", "own", "n", "rate", "source_size", "n_docs"]
    rated = materialize(rated.select(*columns, heavy.alias("heavy")), "mix-rated")

    first = rated.where("heavy").withColumn("carry", F.lit(0.0))
    large = materialize(first.groupBy("source").applyInPandas(_round, _ROUNDED), "mix-large")
    rest = rated.where("not heavy")
    light = rest.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("light_size"), F.count("*").alias("light_rows"))
    over = large.groupBy(F.col("source").alias("s")).agg(F.sum("left").alias("left"))
    light = light.join(over, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    light = materialize(light.select("source", "light_size", "light_rows", F.coalesce("left", F.lit(0.0)).alias("left_over")), "mix-light")
    groups = F.ceil(F.col("light_rows") / GROUP_ROWS)
    dealt = _with_state(rest, light, n).withColumn("deal", F.pmod(F.xxhash64("doc_id", "size", "own"), groups))
    part = F.col("left_over") / F.greatest("light_size", F.lit(1))
    dealt = dealt.withColumn("rate", F.col("rate") + part).withColumn("carry", F.lit(0.0))
    small = dealt.select(*columns, "deal", "carry").groupBy("source", "deal").applyInPandas(_round, _ROUNDED)
    whole = large.union(small).withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("left", "no_id")
    return _with_state(whole, aims.drop("n_docs"), n)


def _copies_of_row(row_number: F.Column) -> F.Column:
    """Copies of one of n equal rows that take `copies` together."""
    return F.floor(F.col("copies") / F.col("n")) + F.when(row_number <= F.col("copies") % F.col("n"), 1).otherwise(0)


def mixed_documents(docs: DataFrame, share: Fraction = SHARE, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """docs as the mix takes them: a row for each copy, with the columns of docs, whatever their names. Texts are shuffled
    once. Null texts have size 0 and stay once; rows of one doc_id, source and size share their copies, as evenly as can
    be, those of the least text hash first; rows with a null doc_id count as documents by their text. An empty table
    stays empty."""
    from pyspark.sql import Window

    names = docs.columns
    size = word_count(F.col("text").cast("string"))
    own = F.when(F.col("doc_id").cast("bigint").isNull(), F.xxhash64("text")).otherwise(0)
    key, n, copies, nth, each, copy = (unused(c, docs) for c in ("key", "n", "copies", "nth", "each", "copy"))
    parts = F.struct(F.col("doc_id").cast("bigint").alias("d"), F.col("source").cast("string").alias("s"), size.alias("z"), own.alias("h"))
    taken = mix(docs, share, weights)
    taken = taken.select(F.struct(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("size").alias("z"), F.col("own").alias("h")).alias(key), F.col("n").alias(n), F.col("copies").alias(copies))
    taken = materialize(taken, "mix-taken")
    joined = docs.withColumn(key, parts).join(shuffled(taken), key)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64("text")))
    often = F.floor(F.col(copies) / F.col(n)) + F.when(F.col(nth) <= F.col(copies) % F.col(n), 1).otherwise(0)
    picked = joined.withColumn(nth, place).withColumn(each, often.cast("int")).where(F.col(each) > 0)
    return picked.select(*names, F.explode(F.sequence(F.lit(1), F.col(each))).alias(copy)).select(*names)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix(table(spark, sf_dir, "documents"))
    rows = got.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("nth"))
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * _copies_of_row(F.col("nth"))).alias("taken")
    )
