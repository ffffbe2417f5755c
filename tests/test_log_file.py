"""Log bytes: every truncation and every flipped bit, zero holes, and batches that are cut or lie about their size."""

import pytest

from palimpsest.sources import log_file as l
from palimpsest.sources import workload


def test_batches():
    ops = [(1, b"a", b"1"), (0, b"", None), (1, b"k" * 300, b""), (1, b"\0\xff", b"v" * 20000)]
    assert l.decode_batch(l.encode_batch(7, ops)) == (7, ops)
    data = l.encode_batch(7, ops)
    for cut in range(len(data)):
        with pytest.raises(ValueError):
            l.decode_batch(data[:cut])
    with pytest.raises(ValueError, match="unknown type"):
        l.decode_batch(data[:12] + b"\x07" + data[13:])


def test_every_truncation_and_bit_flip():
    payloads = [b"alpha", b"b" * 40, b"charlie"]
    data = l.encode_log(9, payloads)
    ends = [16]
    for p in payloads:
        ends.append(ends[-1] + 9 + len(p))
    assert l.scan_log(data) == (9, payloads, l.CLEAN, len(data))
    for cut in range(16, len(data)):
        whole = sum(e <= cut for e in ends[1:])
        _, got, why, at = l.scan_log(data[:cut])
        assert got == payloads[:whole] and at == ends[whole]
        assert why == (l.CLEAN if cut == ends[whole] else l.TORN_HEADER if cut - ends[whole] < 9 else l.TORN_PAYLOAD)
    for byte in range(16, len(data)):
        for bit in range(8):
            broken = bytearray(data)
            broken[byte] ^= 1 << bit
            _, got, why, _ = l.scan_log(bytes(broken))
            good = sum(e <= byte for e in ends[1:])
            assert got == payloads[:good] and why != l.CLEAN


def test_holes_and_other_logs():
    data = l.encode_log(3, [b"x"])
    assert l.scan_log(data + bytes(4096))[1:3] == ([b"x"], l.ZERO_LENGTH)
    moved = data[:8] + (4).to_bytes(8, "little") + data[16:]
    assert l.scan_log(moved)[1:3] == ([], l.BAD_CRC)
    for bad in (b"", b"no log at all...."):
        with pytest.raises(ValueError, match="not a log"):
            l.scan_log(bad)
    with pytest.raises(ValueError):
        l.encode_log(0, [])
    with pytest.raises(ValueError):
        l.encode_log(1, [b""])


def test_streams_equal_step_by_step():
    seed = (2 * workload.WRITE_SEED[0] + 1) % 2**64
    want = []
    for _ in range(50):
        seed = (seed * workload.LCG_FACTOR + workload.LCG_STEP) % 2**64
        want.append(seed >> 20)
    assert workload.write_stream(2, 50).tolist() == want
    assert len(set(workload.read_stream(1, 1000).tolist())) == 1000
    assert workload.heights(1, 2) == [48271, 182605794]
    h = workload.hot(workload.read_stream(0, 5000), 10_000)
    assert 0.88 < (h <= 100).mean() < 0.93 and h.max() < 10_000


def test_counter_kinds(spark):
    from palimpsest.operators import metrics

    rows = [(s, n, s * 100) for s in range(8) for n in ("writes", "max-stall-ms", "orphan-files")]
    got = {r["name"]: r.total for r in metrics.reduce_counters(metrics.with_kinds(spark.createDataFrame(rows, "shard int, name string, v bigint"))).collect()}
    assert got == {"writes": 2800, "max-stall-ms": 700, "orphan-files": 0}
    with pytest.raises(Exception, match="no counter"):
        metrics.with_kinds(spark.createDataFrame([(0, "x", 1)], "shard int, name string, v bigint")).collect()
