"""Entropy balancing against plain arithmetic."""

import random
import re
from fractions import Fraction

from palimpsest.llm import mixing

from odd import ODD


def plain_targets(sizes):
    """Deal by weight, cap, deal the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, out, free = Fraction(3, 2) * sum(sizes.values()), {}, set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level >= 2 * sizes[s]}
        if not full:
            out |= {s: float(weight[s] * level) for s in free}
            break
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= 2 * sizes[s]
        free -= full
    return out


def corpus(rng, n=900):
    rows = []
    for i in range(n):
        source = rng.choice(["b", "a", None, "é", "z", "B"] + ["hot"] * 5)
        rows.append((i, "w " * int(rng.paretovariate(0.9) * 5 % 4000), source))
    return rows + [(10_000 + i, t, "odd") for i, t in enumerate(ODD)] + [(5, "same row", "a")] * 3


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_copies_and_reruns(make):
    rows = corpus(random.Random(6))
    docs = make(rows)
    got = mixing.mix(docs).collect()
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = plain_targets(sizes)
    taken: dict = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) <= 1e-6 * max(1, want[r.source])
        assert 0 <= r.copies <= 2 * r.n
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
    for s, n in taken.items():
        assert abs(n - want[s]) <= max(0.01 * want[s], 8), (s, n, want[s])
    assert sum(r.n for r in got) == len(rows)
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.source or "", r.size, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_the_dual_is_solved(spark, make):
    rows = mixing.sized(make(corpus(random.Random(2), 300)))
    sources = rows.groupBy("source").agg({"*": "count"}).drop("count(1)")
    from pyspark.sql import functions as F

    sources = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    aims = mixing.targets(sources)
    state = mixing.balance(rows, aims)
    sums = mixing._with_state(rows, state, 20).groupBy("source", "target").agg(F.sum(F.col("n") * F.col("size") * mixing._rate()).alias("got")).collect()
    for r in sums:
        assert abs(r.got - r.target) <= 1e-5 * max(r.target, 1), r


def test_copies_of_documents(make):
    rows = corpus(random.Random(9), 120)
    docs = make(rows)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    want = {(r.doc_id, r.source, r.size): r.copies for r in mixing.mix(docs).collect() if r.copies}
    got: dict = {}
    for r in out.collect():
        k = (r.doc_id, r.source, words(r.text))
        got[k] = got.get(k, 0) + 1
    assert got == want


def test_no_documents_and_no_words(make):
    docs = make([(1, "", "a"), (2, None, None), (None, None, "b")])
    assert [r.copies for r in mixing.mix(docs).collect()] == [1, 1, 1]
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


def test_places_by_code_point(spark):
    names = ["b", "a", None, "é", "Z", "𝄞", "ￜ"]
    got = mixing.ranked(spark.createDataFrame([(n,) for n in names], "source string")).collect()
    want = sorted(names, key=lambda s: (s is None, (s or "").encode()))
    assert [r.source for r in sorted(got, key=lambda r: r.place)] == want


def test_internal_names_do_not_clash_and_null_ids_are_told_apart(make):
    from pyspark.sql import functions as F

    rows = [(None, f"w{i} " * (i % 7), "s") for i in range(60)] + [(5, "a b c", "s"), (5, "d e f", "s"), (6, "g " * 20000, "t"), (None, "same", "t"), (None, "same", "t")]
    docs = make(rows, **{n: F.lit("y") for n in ("__key", "__n", "__nth", "__each", "__copies", "__copy", "_key0", "_n0", "own", "target")})
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    copies = {(r.doc_id, r.source, r.size, r.own): (r.copies, r.n) for r in mixing.mix(docs).collect()}
    assert sum(n for _, n in copies.values()) == len(rows) and sum(c for c, _ in copies.values()) == out.count()
    assert all(0 <= c <= 2 * n for c, n in copies.values())
    assert len([k for k in copies if k[0] is None]) == len({(t, s) for i, t, s in rows if i is None})
