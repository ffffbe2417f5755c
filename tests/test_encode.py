"""Byte encodings against published vectors and plain Python."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import encode
from palimpsest.operators import metrics


def test_crc32c_vectors():
    values = pd.Series([b"123456789", bytes(32), b"\xff" * 32, bytes(range(32)), b""])
    assert encode.crc32c_of(values).tolist() == [0xE3069283, 0x8A9136AA, 0x62A8AB43, 0x46DD794E, 0]
    assert encode.crc32c_of(pd.Series([b"6789"]), encode.crc32c_of(pd.Series([b"12345"]))).tolist() == [0xE3069283]


def plain_varint(n):
    out = b""
    while n >= 128:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def test_varints_and_fixed(spark):
    numbers = [0, 1, 127, 128, 16383, 16384, 2**32 - 1, 2**56 - 1, 2**62]
    rows = spark.createDataFrame([(n,) for n in numbers], "n bigint").select("n", encode.varint(F.col("n")).alias("v"), encode.little_endian(F.col("n"), 8).alias("f")).collect()
    for r in rows:
        assert bytes(r.v) == plain_varint(r.n)
        assert bytes(r.f) == r.n.to_bytes(8, "little")


def test_internal_keys(spark):
    df = spark.createDataFrame([("a\0", 7, 1), ("", 1, 0)], "k string, s bigint, t int")
    rows = df.select(encode.internal_key(F.col("k"), F.col("s"), F.col("t")).alias("i")).select("i", encode.valid_internal_key(F.col("i")).alias("ok")).collect()
    assert [bytes(r.i) for r in rows] == [b"a\0" + (7 << 8 | 1).to_bytes(8, "little"), (1 << 8).to_bytes(8, "little")]
    assert all(r.ok for r in rows)
    bad = spark.createDataFrame([(b"short",), (b"k" + b"\x02" + bytes(7),)], "i binary").select(encode.valid_internal_key(F.col("i")).alias("ok"))
    assert [r.ok for r in bad.collect()] == [False, False]


@pytest.mark.parametrize("v", [0, 255, 256, 257, 511, 512, 1023, 10**6, 2**40 + 12345, 2**62])
def test_histogram_bounds(spark, v):
    df = spark.createDataFrame([(v,)], "v bigint").select(metrics.bucket_of(F.col("v")).alias("b"))
    bucket, low = df.select("b", metrics.lower_of(F.col("b")).alias("l")).first()
    assert low <= v
    if v >= 256:
        assert (v - low) * 256 <= v
    assert 0 <= bucket <= 57 * 256 - 1


def test_percentile_is_a_lower_bound(spark):
    s = spark.createDataFrame([(n,) for n in range(256)] * 100, "v bigint")
    got = {r.per_mille: r.v for r in metrics.percentiles(metrics.histogram(s), [500, 990, 1000]).collect()}
    assert got == {500: 127, 990: 253, 1000: 255}


def test_bloom_never_loses_a_key(spark):
    keys = spark.range(500).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    bits, k = encode.filter_bits(500, 10), encode.probe_count(10)
    assert encode.may_contain(keys, encode.bloom_words(keys, bits, k), bits, k).where("not maybe").count() == 0
    none = keys.limit(0)
    assert encode.may_contain(keys, encode.bloom_words(none, 64, 6), 64, 6).where("maybe").count() == 0


def test_blocks_share_prefixes_between_restarts(spark):
    e = spark.createDataFrame([(n + 1, 1, f"user:{n:08d}:name", "v" * 40, 0) for n in range(200)], "seq bigint, type int, user_key string, value string, file_no bigint")
    laid = encode.block_layout(e, 512, 16).orderBy("pos").collect()
    assert laid[0].restart and laid[0].shared == 0 and len({r.block_no for r in laid}) > 10
    for a, b in zip(laid, laid[1:]):
        assert b.block_no - a.block_no in (0, 1)
        assert b.restart or b.shared > 0
