"""Load-test key streams: sequential, random, hot and absent keys of a fixed width, the same for a thread at each run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .carriers import key

#: Multiplier and increment of the write stream's generator, the shift of its output, thread seeds, the
#: shifts of the read stream's generator, and multiplier and modulus of the height generator.
LCG_FACTOR, LCG_STEP, LCG_SHIFT = 6364136223846793005, 1442695040888963407, 20
WRITE_SEED, READ_SEED = (2654435761, 1), (88172645463325252, 7)
#: Thread seeds of the mixed workload.
MIXED_WRITE_SEED, MIXED_READ_SEED = (1, 11), (99, 5)
XORSHIFT = (13, 7, 17)
PARK_MILLER = (48271, 2147483647)
STRETCH = 1 << 18


def write_stream(thread: int, count: int, seeds: tuple[int, int] = WRITE_SEED) -> np.ndarray:
    """Draws of a writer: all powers of the factor at once, so the whole stream is two cumulative operations."""
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(count, LCG_FACTOR, np.uint64))
        before = np.concatenate([[np.uint64(1)], powers[:-1]])
        seed = np.uint64((thread * seeds[0] + seeds[1]) % (1 << 64))
        return (powers * seed + np.uint64(LCG_STEP) * np.cumsum(before)) >> np.uint64(LCG_SHIFT)


def read_stream(thread: int, count: int, seeds: tuple[int, int] = READ_SEED) -> np.ndarray:
    seed, out, full = (thread * seeds[0] + seeds[1]) % (1 << 64), [], (1 << 64) - 1
    left, right, last = XORSHIFT
    for _ in range(count):
        seed ^= seed << left & full
        seed ^= seed >> right
        seed ^= seed << last & full
        out.append(seed)
    return np.array(out, np.uint64)


def heights(seed: int, count: int) -> list[int]:
    out = []
    for _ in range(count):
        seed = seed * PARK_MILLER[0] % PARK_MILLER[1]
        out.append(seed)
    return out


def height_draws(spark: SparkSession, seeds: list[int], count: int) -> DataFrame:
    """(seed, i, draw) of the height generator, each seed's draws in a row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for seed in pdf["seed"]:
                yield pd.DataFrame({"seed": seed, "i": np.arange(count), "draw": heights(int(seed), count)})

    return spark.createDataFrame([(s,) for s in seeds], "seed bigint").mapInPandas(run, "seed bigint, i bigint, draw bigint")


def hot(draw: np.ndarray, n: int) -> np.ndarray:
    """Nine draws in ten fall on the first hundredth of the keys."""
    return np.where(draw % np.uint64(100) < 90, draw % np.uint64(n // 100 + 1), draw % np.uint64(n))


def sequential(spark: SparkSession, n: int, threads: int) -> DataFrame:
    """(thread, i, n, user_key) of fillseq: each thread's stretch of the keys in order."""
    per = n // threads
    at = spark.range(per * threads)
    thread = F.floor(F.col("id") / per).cast("bigint")
    return at.select(thread.alias("thread"), (F.col("id") % per).alias("i"), F.col("id").alias("n"), key(F.col("id")).alias("user_key"))


def mixed(spark: SparkSession, n: int, ops: int, writers: int, readers: int) -> DataFrame:
    """(role, thread, i, n) of writers at random keys and readers at hot ones, so many operations each."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for t in pdf["id"]:
                if t < writers:
                    drawn = write_stream(int(t), ops, MIXED_WRITE_SEED) % np.uint64(n)
                else:
                    drawn = hot(read_stream(int(t) - writers, ops, MIXED_READ_SEED), n)
                own = t if t < writers else t - writers
                yield pd.DataFrame({"role": "write" if t < writers else "read", "thread": own, "i": np.arange(ops), "n": drawn.astype(np.int64)})

    return spark.range(writers + readers).mapInPandas(run, "role string, thread bigint, i bigint, n bigint")


def keys(spark: SparkSession, kind: str, n: int, threads: int) -> DataFrame:
    """(thread, i, n, user_key) of a workload: fillrandom, readrandom, readhot or readmissing. A thread's draws follow
    one another, so they are made in one task, a stretch at a time."""
    per = n // threads

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for t in pdf["id"]:
                if kind == "fillrandom":
                    drawn = write_stream(int(t), per) % np.uint64(n)
                else:
                    drawn = read_stream(int(t), per)
                    drawn = hot(drawn, n) if kind == "readhot" else drawn % np.uint64(n)
                    drawn = drawn | np.uint64(1) if kind == "readmissing" else drawn
                for a in range(0, per, STRETCH):
                    some = drawn[a : a + STRETCH].astype(np.int64)
                    yield pd.DataFrame({"thread": t, "i": np.arange(a, a + len(some)), "n": some})

    drawn = spark.range(threads).mapInPandas(run, "thread bigint, i bigint, n bigint")
    return drawn.select("thread", "i", "n", key(F.col("n")).alias("user_key"))


def baseline(n: int, i: Column) -> Column:
    """Preload of even keys only: odd probes lie in range and are absent."""
    return key(i * 2 % n)
