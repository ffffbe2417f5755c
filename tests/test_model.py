"""Random operations on a store against a dictionary of versions: reads at snapshots before and after compaction."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import compact, files, ordered, read
from palimpsest.options import Options
from palimpsest.store import StatusError, Store


def model_scan(log, snap):
    live = {}
    for seq, kind, key, value in log:
        if seq <= snap:
            live[key] = (kind, value)
    return {k: v for k, (kind, v) in live.items() if kind == 1}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_operations(spark, seed):
    rng = random.Random(seed)
    store, log, seq = Store(spark, Options(tier_trigger=2, max_tiers=3)), [], 0
    pinned = []
    for step in range(6):
        for _ in range(rng.randint(1, 25)):
            key, kind = f"k{rng.randint(0, 14):02d}", int(rng.random() > 0.35)
            seq += 1
            value = f"v{seq}" if kind else None
            log.append((seq, kind, key, value))
            store.put(key, value) if kind else store.delete(key)
        if step == 2:
            manager = store.snapshot()
            pinned.append((manager, manager.__enter__()))
        store.flush() if step % 2 else store.compact()
        for snap in [seq, *(s for _, s in pinned)]:
            got = {r.user_key: r.value for r in store.scan(snap).collect()}
            assert got == model_scan(log, snap), (step, snap)
    back = [r.user_key for r in read.reverse_scan(store.log()).orderBy("rank").collect()]
    assert back == sorted(model_scan(log, seq), reverse=True)
    for manager, _ in pinned:
        manager.__exit__(None, None, None)
    before = store.entries.count()
    store.compact()
    assert {r.user_key: r.value for r in store.scan().collect()} == model_scan(log, seq)
    assert store.entries.count() <= before
    assert not [r for r in files.first_hit(store.entries).join(read.newest(store.entries).withColumnRenamed("seq", "n").select("user_key", "n"), "user_key").collect() if r.seq != r.n]


def test_store_status(spark):
    store = Store(spark)
    store.put("a", "")
    assert store.get("a") == ""
    store.delete("a")
    with pytest.raises(StatusError, match="NotFound"):
        store.get("a")
    with pytest.raises(StatusError, match="InvalidArgument"):
        store.put("k" * 4097, "v")
    with pytest.raises(KeyError):
        store.property("no-such")
    assert store.property("num-files-at-tier0") == 0
    store.flush()
    assert store.property("live-entries") == 2
    store.close()
    store.close()
    with pytest.raises(StatusError, match="IOError"):
        store.put("b", "x")


def entries(spark, rows):
    return spark.createDataFrame(rows, "seq bigint, type int, user_key string, value string, file_no bigint, tier int")


def ranges(spark, rows):
    return spark.createDataFrame(rows, "smallest string, largest string")


def kept(df):
    return sorted(r.seq for r in df.collect())


def test_drop_rules(spark):
    e = entries(spark, [(10, 1, "a", "x", 0, 0), (20, 0, "a", None, 0, 0), (30, 1, "a", "y", 0, 0), (5, 1, "b", "p", 0, 0), (6, 0, "b", None, 0, 0)])
    none, over = ranges(spark, [("x", "x")]).where("false"), ranges(spark, [("a", "c")])
    assert kept(compact.merged(e, none, 100)) == [30]
    assert kept(compact.merged(e, over, 100)) == [6, 30]  # the deletion of b may still hide an older value
    assert kept(compact.merged(e, none, 15)) == [10, 20, 30]  # a snapshot at 15 needs the version at 10; b is gone for all
    assert kept(compact.merged(e, over, 5)) == [5, 6, 10, 20, 30]


def test_superseded_counts_from_any_input_version(spark):
    """A value under a dropped deletion must not come back."""
    e = entries(spark, [(1, 1, "k", "old", 0, 0), (2, 0, "k", None, 1, 0)])
    assert kept(compact.merged(e, ranges(spark, [("x", "x")]).where("false"), 2)) == []


def test_choice_takes_the_oldest_files_and_folds_the_last_tier(spark):
    rows = [(0, n) for n in (9, 7, 8)] + [(1, 1), (1, 2)]
    pick = compact.choose(rows, Options(tier_trigger=2, max_tiers=3))
    assert (pick.input_tier, pick.output_tier, pick.inputs) == (0, 1, (7, 8))
    pick = compact.choose(rows[3:], Options(tier_trigger=2, max_tiers=2))
    assert (pick.input_tier, pick.output_tier, pick.inputs) == (1, 1, (1, 2))
    pick = compact.choose(rows, Options(tier_trigger=2, max_tiers=1))
    assert (pick.input_tier, pick.output_tier, pick.inputs) == (0, 0, (7, 8, 9))
    pick = compact.choose(rows[:3], Options(tier_trigger=3, max_tiers=2))
    assert pick.output_tier == 1
    assert compact.choose(rows, Options(tier_trigger=4)) is None
    meta = spark.createDataFrame(rows, "tier int, file_no bigint")
    for o in (Options(tier_trigger=2, max_tiers=3), Options(tier_trigger=2, max_tiers=2), Options(tier_trigger=3, max_tiers=7)):
        pick = compact.choose(rows, o)
        got = {(r.file_no, r.output_tier) for r in compact.picked(meta, o).collect()}
        assert got == {(n, pick.output_tier) for n in pick.inputs}


def test_the_loop_against_a_simulation(spark):
    """Compaction over many flushes: the same files, tiers and entries as merging lists one after another."""
    rng, o = random.Random(3), Options(tier_trigger=3, max_tiers=4)
    rows = [(s, int(rng.random() > 0.4), f"k{rng.randint(s // 40, 20 + s // 20):03d}", "v", (s - 1) // 9, 0) for s in range(1, 400)]
    live: dict = {}
    for r in rows:
        live.setdefault((0, r[4]), []).append(r)
    number, oldest = max(n for _, n in live), 300
    while pick := compact.choose(live, o):
        mine = [r for n in pick.inputs for t, m in list(live) if m == n for r in live.pop((t, n))]
        others = [(min(x[2] for x in e), max(x[2] for x in e)) for (t, _), e in live.items() if t >= pick.output_tier]
        number += 1
        kept = []
        for key in {r[2] for r in mine}:
            newer = 1 << 60
            for r in sorted((r for r in mine if r[2] == key), reverse=True):
                hidden = any(a <= key <= b for a, b in others)
                if newer > oldest and not (r[1] == 0 and r[0] <= oldest and not hidden):
                    kept.append(r)
                newer = r[0]
        if kept:
            live[pick.output_tier, number] = kept
        if pick.input_tier == pick.output_tier == o.max_tiers - 1:
            break
    got: dict = {}
    for r in compact.compact_all(entries(spark, rows), oldest, o).collect():
        got.setdefault((r.tier, r.file_no), []).append(r.seq)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(r[0] for r in v) for k, v in live.items()}
    assert len({t for t, _ in got}) > 1


@pytest.mark.parametrize("few", [1000, 0])
def test_a_round_is_the_same_as_its_compactions_one_by_one(spark, monkeypatch, few):
    """Deletions are held back by the ranges of the outputs before, also where those come from held back deletions alone."""
    monkeypatch.setattr(compact, "FEW_RANGES", few)
    rng, oldest = random.Random(5), 200
    rows = [(s, int(rng.random() > 0.7), f"k{rng.randint(0, 60):02d}", "v", (s - 1) // 4, 0) for s in range(1, 241)]
    picks = compact.choose_round(((0, n) for n in range(60)), Options(tier_trigger=2))
    assert len(picks) == 30 and picks[0] == compact.choose(((0, n) for n in range(60)), Options(tier_trigger=2))
    others, want = [("k58", "k60")], {}
    for number, pick in enumerate(picks, 1000):
        mine, kept = [r for r in rows if r[4] in pick.inputs], []
        for r in mine:
            newer = any(x[2] == r[2] and r[0] < x[0] <= oldest for x in mine)
            free = r[1] == 0 and r[0] <= oldest and not any(a <= r[2] <= b for a, b in others)
            if not newer and not free:
                kept.append(r)
        if kept:
            want[number] = sorted(r[0] for r in kept)
            others.append((min(r[2] for r in kept), max(r[2] for r in kept)))
    goes = spark.createDataFrame(compact.outputs_of(picks, list(range(1000, 1030))), "file_no bigint, made bigint")
    got: dict = {}
    for r in compact.merged_apart(entries(spark, rows).join(goes, "file_no"), [("k58", "k60")], oldest).collect():
        got.setdefault(r.made, []).append(r.seq)
    assert {k: sorted(v) for k, v in got.items()} == want


def test_jobs_grow_with_tiers_not_with_files(spark):
    spark.sparkContext.setJobGroup("rounds", "")
    compact.compact_all(entries(spark, [(s, 1, f"k{s % 50:02d}", "v", s, 0) for s in range(64)]), 64).collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # 21 compactions in 3 rounds.
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds")) < 60


def test_a_store_compacts_a_tier_in_one_round(spark):
    """40 files: under a snapshot, 20 + 10 + 5 + 2 + 1 compactions are counted, but only some jobs run; reads stay the same."""
    rng = random.Random(7)
    log = [(s, int(rng.random() > 0.3), f"k{rng.randint(0, 30):02d}", f"v{s}", (s - 1) // 5, 0) for s in range(1, 201)]
    log = [(s, kind, key, v if kind else None, n, t) for s, kind, key, v, n, t in log]
    store = Store(spark, Options(tier_trigger=2), entries=entries(spark, log))
    with store.snapshot() as at:
        store.delete("k00")
        spark.sparkContext.setJobGroup("store", "")
        store.compact()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("store")) < 150
        got = {r.user_key: r.value for r in store.scan(at).collect()}
        assert got == model_scan([r[:4] for r in log], at)
        assert "k00" not in {r.user_key for r in store.scan().collect()}
    assert store.counters["compactions"] == 38
    assert sorted((m["tier"], m["num_entries"]) for m in store.live.values()) == sorted((r.tier, r["count"]) for r in store.entries.groupBy("tier", "file_no").count().collect())
    again = Store(spark, Options(tier_trigger=2), path=store.folder.path)
    assert {r.user_key: r.value for r in again.scan(at).collect()} == got


def test_empty_log(spark):
    e = entries(spark, []).limit(0)
    assert read.scan(e).count() == 0 and compact.compact_all(e, 0).count() == 0
    assert read.reverse_scan(e).count() == 0


def test_seeks_against_bisection(spark):
    keys = [f"k{n:03d}" for n in range(0, 100, 3)]
    view = spark.createDataFrame([(k, "v") for k in keys], "user_key string, value string")
    asked = [f"k{n:03d}" for n in range(0, 103)]
    targets = spark.createDataFrame([(t,) for t in asked + asked[:5]], "target string")
    ahead = {(r.target, r.found_key) for r in read.seek_all(view, targets).collect()}
    assert ahead == {(t, next((k for k in keys if k >= t), None)) for t in asked}
    back = {(r.target, r.found_key) for r in read.seek_all(view, targets, backwards=True).collect()}
    assert back == {(t, max((k for k in keys if k < t), default=None)) for t in asked}
    steps = {(r.target, r.step): r.user_key for r in read.seek_next(view, targets, 2).collect()}
    assert steps == {(t, i): k for t in asked for i, k in enumerate([k for k in keys if k >= t][:2])}


def test_orders_over_many_stretches(spark):
    """One hot key over several tasks: places, running totals and values carried from stretch to stretch."""
    rng = random.Random(8)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randint(0, 9)}", i, rng.choice([None, None, i]), rng.randint(0, 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "user_key string, seq bigint, v bigint, n bigint").repartition(7)
    line = sorted(rows)
    got = {r.seq: r.rank for r in ordered.ranked(df, "user_key", "seq").collect()}
    assert got == {r[1]: i + 1 for i, r in enumerate(line)}
    got, total = {r.seq: r.s for r in ordered.running_total(df, "n", "s", "user_key", "seq", inclusive=False).collect()}, 0
    for r in line:
        assert got[r[1]] == total
        total += r[3]
    for group in ("user_key", None):
        got, last, before = {r.seq: r.v for r in ordered.carried(df, group, "v", *(["seq"] if group else ["user_key", "seq"])).collect()}, None, None
        for r in line:
            last = r[2] if r[2] is not None else last if group is None or r[0] == before else None
            before = r[0]
            assert got[r[1]] == last
    m = df.select("seq", F.lit(1).alias("type"), "user_key", F.lit("x").alias("value"))
    newer = {}
    for r in sorted(rows, key=lambda r: -r[1]):
        newer.setdefault(r[0], []).append(r[1])
    want = {(k, s, i + 1, seqs[i - 1] if i else None) for k, seqs in newer.items() for i, s in enumerate(seqs)}
    assert {(r.user_key, r.seq, r.version, r.superseded_by) for r in read.history(m).collect()} == want


def test_ranges_over_points(spark):
    rng = random.Random(2)
    ranges_ = [(i, *sorted((f"k{rng.randint(0, 30):02d}", f"k{rng.randint(0, 30):02d}"))) for i in range(40)]
    meta = spark.createDataFrame(ranges_, "file_no bigint, smallest string, largest string")
    points = [(i, f"k{i % 33:02d}") for i in range(90)]
    probes = spark.createDataFrame(points, "probe_id bigint, user_key string")
    got = {r.probe_id: r.files for r in files.consulted(probes, meta).collect()}
    assert got == {i: sum(a <= k <= b for _, a, b in ranges_) for i, k in points}
    got = {r.file_no: r.overlaps for r in files.overlaps(meta).collect()}
    assert got == {i: sum(a <= d and c <= b for j, c, d in ranges_ if j != i) for i, a, b in ranges_}


def test_a_store_opened_again(spark, tmp_path):
    path, o = f"file://{tmp_path}/s", Options(tier_trigger=2, write_buffer_bytes=300)
    rng, model = random.Random(5), {}
    for session in range(3):
        s = Store(spark, o, path=path)
        assert {r.user_key: r.value for r in s.scan().collect()} == model
        for _ in range(15):
            k, v = f"k{rng.randint(0, 9)}", f"v{rng.random()}"
            if rng.random() < 0.3:
                s.delete(k)
                model.pop(k, None)
            else:
                s.put(k, v)
                model[k] = v
        if session == 1:
            s.compact()
            s.rotate_manifest()
        assert all(s.get(k) == v for k, v in list(model.items())[:2])
        assert s.property("writes") == 15 and "wal-syncs" in s.property("stats") and s.property("memtable-bytes") <= 300
        last = s.last_sequence
        # left without closing: what was written must come back from the logs
    s = Store(spark, o, path=path)
    assert s.last_sequence == last == 45
    names = s.folder.names()
    assert sum(n.startswith("MANIFEST") for n in names) == 1 and sum(n.endswith(".log") for n in names) <= 1
    with pytest.raises(StatusError, match="InvalidArgument"):
        Store(spark, o, path=path, fresh=True)
    with pytest.raises(StatusError, match="NotFound"):
        Store(spark, o, path=f"{path}-none", create=False)
    two = Store(spark, o, path=path)
    two.put("a", "b")
    two.flush()
    s.put("a", "c")
    with pytest.raises(StatusError, match="another writer"):
        s.flush()
    s.folder.write("CURRENT", b"MANIFEST-000002", replace=True)
    with pytest.raises(StatusError, match="Corruption"):
        Store(spark, o, path=path)


def test_a_torn_log_and_byte_keys(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    s = Store(spark, path=path, binary=True)
    keys = [b"\x00", b"\xff\xfe", b"a", b"a\x00", b"\x80"]
    for i, k in enumerate(keys):
        s.put(k, bytes([i, 255 - i]))
    log = next(n for n in s.folder.names() if n.endswith(".log"))
    part = s.folder.names(log)[-1]
    s.folder.write(f"{log}/{part}", s.folder.read(f"{log}/{part}")[:-1], replace=True)
    again = Store(spark, path=path, binary=True)
    assert [bytes(r.user_key) for r in read.ordered_scan(again.log()).orderBy("rank").collect()] == sorted(keys[:-1])
    assert again.get(b"\xff\xfe") == bytes([1, 254]) and again.last_sequence == 4
    with pytest.raises(StatusError, match="NotFound"):
        again.get(b"\x80")
    again.put(b"\x80", b"")
    again.compact()
    assert again.get(b"\x80") == b"" and {m["largest"] for m in again.live.values()} >= {b"\xff\xfe"}
    assert Store(spark, path=path, binary=True).get(b"a\x00") == bytes([3, 252])
