"""Byte encodings and hashes. What built-in functions express exactly is built from them; the others are vectorised Arrow
functions that work down the columns of a byte matrix, a batch of rows at a time."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The Castagnoli polynomial, reflected; the multiplier and seed of the 64-bit hash.
CASTAGNOLI = 0x82F63B78
HASH_FACTOR, HASH_SEED = 0xC6A4A7935BD1E995, 0x9E3779B97F4A7C15
#: Bits a key to probes, and the bounds of the number of probes.
PROBE_FACTOR, LEAST_PROBES, MOST_PROBES = 0.69, 1, 30


def packed(seq: Column, kind: Column) -> Column:
    """Sequence number and type in one integer."""
    return F.shiftleft(seq, 8).bitwiseOR(kind.cast("bigint"))


def unpacked(tag: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(tag, 8), tag.bitwiseAND(F.lit(255)).cast("int")


def little_endian(n: Column, size: int) -> Column:
    """n as `size` little-endian bytes."""
    hexed = F.lpad(F.hex(n), 16, "0")
    return F.unhex(F.concat(*(F.substring(hexed, 15 - 2 * i, 2) for i in range(size))))


def internal_key(user_key: Column, seq: Column, kind: Column) -> Column:
    return F.concat(user_key.cast("binary"), little_endian(packed(seq, kind), 8))


def valid_internal_key(key: Column) -> Column:
    """At least the eight tag bytes, and a known type in the lowest of them."""
    kind = F.conv(F.hex(F.substring(key, F.length(key) - 7, 1)), 16, 10).cast("int")
    return (F.length(key) >= 8) & F.coalesce(kind <= 1, F.lit(False))


def varint(n: Column) -> Column:
    """n in groups of seven bits, lowest first, the high bit on all but the last."""
    from ..operators.wal import varint_bytes

    size = varint_bytes(n)
    group = lambda i: F.call_function("shiftrightunsigned", n, (i * 7).cast("int")).bitwiseAND(F.lit(127))
    hexed = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.lpad(F.hex(group(i) + F.when(i < size - 1, 128).otherwise(0)), 2, "0"))
    return F.unhex(F.array_join(hexed, ""))


def printable(text: Column, most: int = 48) -> Column:
    """ASCII as it is, any other byte as \\xNN, cut after `most` bytes with three dots."""
    hexed = F.lower(F.hex(text.cast("binary")))
    pairs = F.transform(F.sequence(F.lit(0), F.least(F.octet_length(text), F.lit(most)) - 1), lambda i: F.call_function("substring", hexed, 2 * i + 1, F.lit(2)))
    shown = F.transform(pairs, lambda p: F.when((p >= "20") & (p < "7f"), F.decode(F.unhex(p), "US-ASCII")).otherwise(F.concat(F.lit("\\x"), p)))
    whole = F.when(F.octet_length(text) > 0, F.array_join(shown, "")).otherwise("")
    return F.concat(whole, F.when(F.octet_length(text) > most, "...").otherwise(""))


def _matrix(values: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    data = [v.encode() if isinstance(v, str) else bytes(v or b"") for v in values]
    size = np.array([len(x) for x in data], np.int64)
    flat = np.frombuffer(b"".join(data), np.uint8)
    out = np.zeros((len(data), int(size.max(initial=0)) + 8), np.uint8)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out, size


@lru_cache(maxsize=1)
def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(CASTAGNOLI), c >> 1)
    return c


def crc32c_of(values: pd.Series, initial: np.ndarray | int = 0) -> np.ndarray:
    """CRC-32C of each value; initial: of the bytes before it."""
    data, size = _matrix(values)
    crc = np.full(len(size), 0xFFFFFFFF, np.uint32) ^ np.asarray(initial, np.uint32)
    order = np.argsort(-size, kind="stable")
    longer = np.searchsorted(-size[order], -np.arange(data.shape[1]), side="left")
    for i in range(int(size.max(initial=0))):
        rows = order[: longer[i]]
        crc[rows] = _crc_table()[(crc[rows] ^ data[rows, i]) & 255] ^ (crc[rows] >> 8)
    return crc ^ np.uint32(0xFFFFFFFF)


def hash64_of(values: pd.Series, seed: int = HASH_SEED) -> np.ndarray:
    """64-bit multiply and xor-shift hash: eight bytes a step, then a short tail."""
    data, size = _matrix(values)
    m = np.uint64(HASH_FACTOR)
    with np.errstate(over="ignore"):
        h = np.uint64(seed) ^ (size.astype(np.uint64) * m)
        words = np.ascontiguousarray(data[:, : data.shape[1] // 8 * 8]).view("<u8").astype(np.uint64)
        for i in range(words.shape[1]):
            left = size - 8 * i
            whole, tail = left >= 8, (left > 0) & (left < 8)
            k = words[:, i] * m
            k = (k ^ (k >> np.uint64(47))) * m
            h = np.where(whole, (h ^ k) * m, np.where(tail, (h ^ words[:, i]) * m, h))
        h = (h ^ (h >> np.uint64(47))) * m
        return h ^ (h >> np.uint64(47))


def _udf(of: Callable[[pd.Series], np.ndarray]):
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(of(values).astype(np.int64) if of is crc32c_of else of(values).view(np.int64))

    # Spark reads the types of the wrapped function from these.
    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "bigint")


def crc32c(value: Column) -> Column:
    """CRC-32C as a non-negative integer."""
    return _udf(crc32c_of)(value)


def hash64(value: Column) -> Column:
    """The 64-bit hash, as the signed integer of the same bits."""
    return _udf(hash64_of)(value)


def probe_count(bits_per_key: int) -> int:
    return min(MOST_PROBES, max(LEAST_PROBES, int(bits_per_key * PROBE_FACTOR)))


def probe_positions(h: Column, bits: int, k: int) -> Column:
    """Bit positions of a hash: its low half plus multiples of its high half made odd."""
    low = h.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1).cast("bigint"))
    return F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")), lambda i: F.pmod(low + i * high, F.lit(bits)))


def filter_bits(keys: int, bits_per_key: int) -> int:
    return (max(64, keys * bits_per_key) + 7) // 8 * 8


def bloom_words(keys: DataFrame, bits: int, k: int) -> DataFrame:
    """(word, mask): the filter over keys (key) as 63-bit words, built by one partial and one final aggregate."""
    at = keys.select(hash64(F.col("key")).alias("h")).select(F.explode(probe_positions(F.col("h"), bits, k)).alias("p"))
    return at.groupBy(F.floor(F.col("p") / 63).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % 63).cast("int"))).alias("mask"))


BROADCAST_BITS = 1 << 29


def may_contain(probes: DataFrame, words: DataFrame, bits: int, k: int) -> DataFrame:
    """probes (key) with maybe: false only for keys that were not added. Filters over 64 to 2**40 bits.

    A filter of at most BROADCAST_BITS bits (64 MB) is sent whole and every probe is tested in place, in the pass that
    hashes it; a larger one is joined by word. A filter that is no filter (fewer than two bytes, or a number of probes
    outside 1 to 30) excludes nothing.
    """
    if bits < 16 or not LEAST_PROBES <= k <= MOST_PROBES:
        return probes.select("key", F.lit(True).alias("maybe"))
    if bits <= BROADCAST_BITS:
        held = np.zeros(-(-bits // 63), np.int64)
        got = words.toPandas()
        held[got["word"].to_numpy(np.int64)] = got["mask"].to_numpy(np.int64)
        sent = probes.sparkSession.sparkContext.broadcast(held)

        def test(values: pd.Series) -> pd.Series:
            filter_words, h = sent.value, hash64_of(values)
            low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
            maybe = np.ones(len(h), bool)
            for i in range(k):
                at = ((low + np.uint64(i) * high) % np.uint64(bits)).astype(np.int64)
                maybe &= (filter_words[at // 63] >> (at % 63)) & 1 == 1
            return pd.Series(maybe)

        test.__annotations__ = {"values": pd.Series, "return": pd.Series}
        return probes.select("key", F.pandas_udf(test, "boolean")(F.col("key")).alias("maybe"))
    hashed = probes.select("key", hash64(F.col("key")).alias("h"))
    at = hashed.select("key", F.explode(probe_positions(F.col("h"), bits, k)).alias("p")).withColumn("word", F.floor(F.col("p") / 63))
    hit = F.coalesce(F.call_function("shiftright", F.col("mask"), (F.col("p") % 63).cast("int")).bitwiseAND(F.lit(1)), F.lit(0))
    return at.join(words, "word", "left").groupBy("key").agg((F.min(hit) == 1).alias("maybe"))


def shared_prefix(before: Column, key: Column) -> Column:
    """Bytes of the common prefix of two keys, text or binary: the place of the first byte that differs."""
    a, b = before.cast("binary"), key.cast("binary")
    n = F.least(F.length(a), F.length(b))
    byte = lambda x, i: F.call_function("substring", x, i, F.lit(1))
    differs = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (byte(a, i) != byte(b, i)))
    return F.coalesce(F.get(differs, F.lit(0)) - 1, n).cast("bigint")


def in_file_order(entries: DataFrame) -> DataFrame:
    """Entries with pos, their place in the file (key up, sequence down), and the key before."""
    w = Window.partitionBy("file_no").orderBy("user_key", F.col("seq").desc())
    nothing = F.lit(b"" if entries.schema["user_key"].dataType.simpleString() == "binary" else "")
    return entries.withColumn("pos", F.row_number().over(w).cast("bigint") - 1).withColumn("before", F.coalesce(F.lag("user_key").over(w), nothing))


def cut_blocks(sized: DataFrame, block_size: int) -> DataFrame:
    """(file_no, pos, block_no) from (file_no, pos, size): a block ends with the entry that fills it. A running sum that
    starts anew, so a fold over a file's entries in order; a file is bounded in size."""
    files = sized.groupBy("file_no").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("size").cast("bigint").alias("size")))).alias("es"))
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("block"), zero.alias("used"), F.array().cast("array<bigint>").alias("out"))

    def step(a: Column, e: Column) -> Column:
        used = a["used"] + e["size"]
        full = used >= block_size
        return F.struct(F.when(full, a["block"] + 1).otherwise(a["block"]).alias("block"), F.when(full, 0).otherwise(used).cast("bigint").alias("used"), F.concat(a["out"], F.array(a["block"])).alias("out"))

    folded = files.select("file_no", "es", F.aggregate("es", start, step)["out"].alias("blocks"))
    each = folded.select("file_no", F.explode(F.arrays_zip(F.col("es.pos").alias("pos"), F.col("blocks").alias("block_no"))).alias("z"))
    return each.select("file_no", "z.pos", "z.block_no")


def block_layout(entries: DataFrame, block_size: int, restart_interval: int) -> DataFrame:
    """(file_no, pos, block_no, shared, restart, size): the byte-exact layout, in which prefixes are shared between whole
    internal keys, tag bytes included. One file at a time in an Arrow group; a file is bounded by the flush size."""
    keyed = entries.select("file_no", internal_key(F.col("user_key"), F.col("seq"), F.col("type")).alias("ikey"), "user_key", "seq", F.coalesce(F.octet_length("value"), F.lit(0)).alias("value_bytes"))

    def lay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["user_key", "seq"], ascending=[True, False])
        length = lambda n: max(1, -(-int(n).bit_length() // 7))
        rows, block, used, restarts, since, last = [], 0, 0, 1, 0, b""
        for pos, (key, size) in enumerate(zip(pdf["ikey"], pdf["value_bytes"])):
            restart = since == 0 or since >= restart_interval
            shared = 0
            if not restart:
                while shared < min(len(last), len(key)) and last[shared] == key[shared]:
                    shared += 1
            elif since:
                restarts, since = restarts + 1, 0
            entry = length(shared) + length(len(key) - shared) + length(size) + len(key) - shared + int(size)
            rows.append((pos, block, shared, restart, entry))
            used, since, last = used + entry, since + 1, key
            if used + 4 * restarts + 4 >= block_size:
                block, used, restarts, since, last = block + 1, 0, 1, 0, b""
        out = pd.DataFrame(rows, columns=["pos", "block_no", "shared", "restart", "size"])
        out.insert(0, "file_no", pdf["file_no"].iloc[0])
        return out

    return keyed.groupBy("file_no").applyInPandas(lay, "file_no bigint, pos bigint, block_no bigint, shared bigint, restart boolean, size bigint")


def separators(cut: DataFrame) -> DataFrame:
    """(file_no, block_no, last_key, last_seq, entries) from entries with pos and block_no: a block's index key is its
    last key."""
    last = F.max_by(F.struct("user_key", "seq"), "pos").alias("k")
    return cut.groupBy("file_no", "block_no").agg(last, F.count("*").alias("entries")).select("file_no", "block_no", F.col("k.user_key").alias("last_key"), F.col("k.seq").alias("last_seq"), "entries")
