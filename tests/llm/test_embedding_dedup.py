"""p-stable hashing against all cosines."""

import math

import numpy as np
import pytest

from palimpsest.llm import embedding_dedup as e


def plain(rows, threshold=e.THRESHOLD):
    ok = [i is not None and v is not None and lab is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v, lab in rows]
    best = list(range(len(rows)))
    links = [0] * len(rows)

    def root(a):
        while best[a] != a:
            a = best[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], np.float32).astype(float), np.array(rows[b][1], np.float32).astype(float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    best[root(a)] = root(b)
    low: dict = {}
    for a, (i, _, _) in enumerate(rows):
        if i is not None:
            low[root(a)] = min(i, low.get(root(a), i))
    return sorted(((i, links[a], low.get(root(a)), i is not None and i == low.get(root(a))) for a, (i, _, _) in enumerate(rows)), key=repr)


def vectors(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumns({c: F.lit(0) for c in ("rep", "n", "bucket", "keys", "vector")})


def answer(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block,small", [(8, 48), (512, 4), (512, 48)])
def test_against_all_cosines(spark, block, small, monkeypatch):
    monkeypatch.setattr(e, "_SMALL", small)
    rng = np.random.default_rng(2)
    rows = []
    for k in range(40):
        centre = rng.standard_normal(32)
        for _ in range(60 if k == 0 else rng.integers(1, 5)):
            near = centre + rng.standard_normal(32) * (0.06 if k % 2 else 0.02)
            rows.append((len(rows), [float(x) for x in near.astype(np.float32)], int(k % 3)))
    for i in range(0, 30, 3):
        rows.append((len(rows), rows[i][1], rows[i][2]))  # exact copies
        rows.append((len(rows), rows[i][1], 7))  # of another label
        rows.append((len(rows), [2 * x for x in rows[i][1]], rows[i][2]))  # another length, same direction
    nan, inf = float("nan"), float("inf")
    for v in (None, [], [0.0] * 32, [nan] * 32, [inf] + [1.0] * 31, [None] + [1.0] * 31, [1.0] * 5, [1.0] * 5, [3e38] * 4, [3e38] * 4):
        rows.append((len(rows), v, 1))
    rows += [(len(rows), rows[0][1], None), (None, rows[0][1], 0), (3, rows[3][1], 0), (3, rows[3][1], 0)]
    got, want = answer(e.near_vectors(vectors(spark, rows), block=block)), plain(rows)
    assert [r[0] for r in got] == [r[0] for r in want]
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert found <= there and found >= 0.98 * there
    assert sum(a != b for a, b in zip(got, want)) <= 0.05 * len(want)


def test_no_vectors(spark):
    assert e.near_vectors(vectors(spark, [(1, [1.0], 1)]).limit(0)).count() == 0
    assert answer(e.near_vectors(vectors(spark, [(1, None, 1)]))) == [(1, 0, 1, True)]


def test_recall_at_the_threshold():
    """Pairs at exactly the threshold meet in some table about as often as planned, for few and many classes."""
    rng = np.random.default_rng(5)
    a = rng.standard_normal((1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise = rng.standard_normal(a.shape)
    noise -= (noise * a).sum(axis=1, keepdims=True) * a
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    for classes in (50, 5_000):
        k, t = e.plan(classes)
        met = (e.buckets(a, k, t) == e.buckets(b, k, t)).any(axis=1).mean()
        assert met >= 0.96
