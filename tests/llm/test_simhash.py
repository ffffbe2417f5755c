"""Multi-index hashing against comparing all pairs."""

import random

import pytest
import xxhash

from palimpsest.llm import common, simhash

from odd import ODD


def plain_print(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), seed=42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    best = {i: i for i in prints}

    def root(i):
        while best[i] != i:
            i = best[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                best[max(x, y)] = min(x, y)
    return {i: root(i) for i in prints}


@pytest.mark.parametrize("cap", [1, 64])
def test_against_all_pairs(make, cap):
    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 5) for _ in range(80)) for _ in range(12)]
    texts = [*ODD, *base]
    for t in base:
        for _ in range(6):
            w = t.split()
            w[rng.randrange(len(w))] = "zz"
            texts.append(" ".join(w))
    texts += base[:4]
    got = {r.doc_id: r for r in simhash.near_duplicates(make(list(enumerate(texts))), cap).collect()}
    prints = {i: plain_print(t) for i, t in enumerate(texts)}
    assert {i: r.fp & (1 << 64) - 1 for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == plain_components(prints)


def test_a_chain_and_a_ball_of_fingerprints(spark):
    """Fingerprints in a row of two-bit steps, and all within one bit of a value, in one crowded bucket."""
    chain = [sum(1 << j for j in range(2 * i)) for i in range(20)]
    ball = [0b10101 << 59] + [(0b10101 << 59) ^ (1 << j) for j in range(40)]
    rows = [(100 + i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(chain + ball)]
    distinct = spark.createDataFrame(rows, "rep bigint, fp bigint")
    for cap in (3, 1000):
        labels = {r.node: r.component for r in simhash.connected_components(simhash.links(distinct, cap)).collect()}
        assert {labels[100 + i] for i in range(20)} == {100}
        assert {labels[120 + i] for i in range(41)} == {120}


def test_null_ids_repeated_rows_and_empty_tables(make):
    rows = [(5, "one two three four"), (5, "one two three four"), (None, "one two three four"), (None, "only here, by null"), (9, None), (8, "")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(make(rows)).collect()), key=repr)
    assert got == sorted([(5, 5), (5, 5), (None, 5), (None, None), (9, 8), (8, 8)], key=repr)
    docs = make(rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.where("doc_id is not null").collect())) == [5, 8]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def test_one_row_of_each_group_stays_whatever_its_id(make):
    one, other = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(None, one), (None, one), (5, one), (5, other), (7, other), (None, "by null alone"), (None, "by null alone"), (5, None), (None, "")]
    kept = simhash.keep_one(make(rows))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(5, one), (5, other), (None, "by null alone"), (5, None)], key=repr)


def test_passes_over_long_paths_stars_grids_and_cliques(spark):
    rng = random.Random(9)
    n = 10_000
    path = [(i, i + 1) for i in range(n - 1)]
    shuffled = rng.sample(range(n), n)
    graphs = {
        "path in id order": path,
        "path in any order": [(shuffled[a], shuffled[b]) for a, b in path],
        "star around its largest": [(n, i) for i in range(3000)],
        "grid": [(60 * r + c, 60 * r + c + d) for r in range(60) for c in range(60) for d in (1, 60) if (c < 59 or d == 60) and (r < 59 or d == 1)],
        "clique and a tail": [(a, b) for a in range(40) for b in range(a)] + [(i, i + 1) for i in range(39, 300)],
    }
    for name, edges in graphs.items():
        passes = []
        got = simhash.connected_components(spark.createDataFrame(edges, "u bigint, v bigint"), passes).collect()
        assert {r.component for r in got} == {0} and len(got) == len({x for e in edges for x in e}), name
        assert sum(passes) <= 15, (name, passes)
        print(name, passes)


@pytest.mark.parametrize("cap", [1, 64])
def test_no_table_of_unknown_size_is_broadcast(make, monkeypatch, cap):
    """Probes are 66 rows a fingerprint, which the planner doesn't count; only the sifting filter may go through the driver."""
    plans = []
    monkeypatch.setattr(simhash, "materialize", lambda df, name: plans.append(df) or common.materialize(df, name))
    monkeypatch.setattr(simhash, "connected_components", lambda edges: plans.append(edges) or common.connected_components(edges))
    plans.append(simhash.near_duplicates(make([(i, f"one two three four w{i % 9}") for i in range(40)]), cap))
    lines = [x for df in plans for x in df._jdf.queryExecution().executedPlan().toString().split("\n")]
    assert any("SortMergeJoin" in x for x in lines)
    assert all("_word" in x for x in lines if "BroadcastHashJoin" in x)
