"""The block of every probe in every file against bisection of each file's sorted separators."""

from bisect import bisect_left

import pytest

from palimpsest.operators import files
from palimpsest.plans.catalog import QUERIES
from palimpsest.sources import carriers


def test_every_probe_is_looked_up(spark):
    data = "/root/testdata/sf0.01"  # sf0.001 has fewer than 20 probes
    ends: dict = {}
    for r in QUERIES["index_separators"](spark, data).collect():
        ends.setdefault(r.file_no, []).append((r.block_no, r.last_key))
    probes = carriers.probes(spark, data).collect()
    want = []
    for file_no, blocks in ends.items():
        blocks.sort()
        keys = [k for _, k in blocks]
        for p in probes:
            at = bisect_left(keys, p.user_key)
            if at < len(keys):
                want.append((file_no, p.probe_id, blocks[at][0]))
    got = sorted((r.file_no, r.probe_id, r.block_no) for r in QUERIES["block_lookup"](spark, data).collect())
    assert got == sorted(want)
    assert max(p for _, p, _ in got) >= 20


@pytest.mark.parametrize("chunk", [1, 3, 100])
def test_stretches_of_probes(spark, chunk):
    """Equal probe keys, equal last keys of neighbouring blocks, files whose keys end before the last probe, blocks without
    probes; the result is made without a shuffle or sort of its rows."""
    probes = [(n, f"k{key:02d}") for n, key in enumerate([5, 5, 9, 0, 20, 7, 7, 31, 12, 20])]
    ends = {0: [3, 5, 5, 9, 30], 1: [6, 7], 2: [40, 41], 7: [1], 9: [0, 0, 12, 12]}
    index = spark.createDataFrame([(f, b, f"k{k:02d}") for f, keys in ends.items() for b, k in enumerate(keys)], "file_no bigint, block_no bigint, last_key string")
    df = files.looked_up(spark.createDataFrame(probes, "probe_id bigint, user_key string"), index, chunk)
    want = [(f, n, next(b for b, k in enumerate(keys) if f"k{k:02d}" >= key)) for f, keys in ends.items() for n, key in probes if f"k{keys[-1]:02d}" >= key]
    assert sorted((r.file_no, r.probe_id, r.block_no) for r in df.collect()) == sorted(want)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")
