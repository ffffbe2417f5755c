"""MinHash bands with verified sets against comparing all pairs of five-word shingle sets."""

import random

import corpus_pipeline
import pytest
from palimpsest.llm import common, shingles, simhash

from odd import ODD
from test_simhash import plain_print


def plain(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_groups(texts):
    sets = [plain(t) for t in texts]
    best = list(range(len(texts)))

    def root(i):
        while best[i] != i:
            i = best[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                best[max(x, y)] = min(x, y)
    return {i: root(i) for i in range(len(texts))}


def near_copies():
    rng = random.Random(6)
    texts = [*ODD]
    for _ in range(10):
        w = [f"w{rng.randrange(3000)}" for _ in range(300)]
        texts.append(" ".join(w))
        for changes in (1, 1, 2, 3, 5, 9, 30):
            v = list(w)
            for _ in range(changes):
                v[rng.randrange(len(v))] = "zz"
            texts.append(" ".join(v))
    return texts


@pytest.mark.parametrize("cap", [2, 16])
def test_against_all_pairs(make, cap):
    texts = near_copies()
    got = {r.doc_id: r.component_id for r in shingles.near_duplicates(make(list(enumerate(texts))), cap).collect()}
    assert got == plain_groups(texts)


def test_the_stage_keeps_one_of_near_copies(spark, make):
    texts = near_copies()
    docs = make(list(enumerate(texts)))
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(plain_groups(texts).values()))
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_no_table_of_unknown_size_is_broadcast(spark, make, monkeypatch):
    """The planner takes these tables for small ones; only the sifting filter, which is bounded, may go through the driver."""
    plans = []

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common.materialize(df, name)

    for module in (shingles, simhash):
        monkeypatch.setattr(module, "materialize", noted)
    found = []
    monkeypatch.setattr(shingles, "connected_components", lambda edges: found.append(edges) or common.connected_components(edges))
    kept = corpus_pipeline.near_duplicates(spark, make(list(enumerate(near_copies()))), "")
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in (kept, *found)]
    joins = [x for p in plans for x in p.split("\n") if "BroadcastHashJoin" in x]
    assert any("SortMergeJoin" in p for p in plans) and all("_word" in x for x in joins), joins


def test_the_stage_takes_links_of_fingerprints_and_of_shingles(spark, make):
    """Against all pairs by either rule: texts that repeat a phrase have one fingerprint, whatever short tail follows."""
    rng = random.Random(8)
    phrase = " ".join(f"p{i}" for i in range(9)) + " "
    tails = [" ".join(f"t{rng.randrange(10**6)}" for _ in range(10)) for _ in range(3)]
    texts = [*near_copies()[::3], phrase * 50, *(phrase * 50 + t for t in tails)]
    texts.append(" ".join([*texts[-1].split()[:-1], "zz"]))
    sets, prints = [plain(t) for t in texts], [plain_print(t) for t in texts]
    best = list(range(len(texts)))
    by_print = 0
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                alike = sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
                near = (prints[a] ^ prints[b]).bit_count() <= 2
                by_print += near and not alike
                if alike or near:
                    best[a] = best[b] = min(best[a], best[b])
    assert by_print
    got = {r.doc_id: r.component_id for r in shingles.near_copies(make(list(enumerate(texts)))).collect()}
    assert got == dict(enumerate(best))
    kept = corpus_pipeline.near_duplicates(spark, make(list(enumerate(texts))), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(best))
