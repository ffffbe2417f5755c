"""SQL counterparts of the queries, for DuckDB over the same tables."""

from __future__ import annotations

MUTATION = """mutation AS (SELECT event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS type,
  printf('key%013d', user_id) AS user_key, CASE WHEN event_type = 'error' THEN NULL ELSE event_type || ':' || props END AS value FROM events),
 last AS (SELECT max(seq) AS n FROM mutation)"""

ENTRY = MUTATION + """,
 flushed AS (SELECT *, (seq - 1) // 250 AS file_no FROM mutation),
 files AS (SELECT max(file_no) + 1 AS files FROM flushed),
 entry AS (SELECT f.*, CASE WHEN file_no < files // 4096 * 4096 THEN 6 WHEN file_no < files // 1024 * 1024 THEN 5 WHEN file_no < files // 256 * 256 THEN 4
   WHEN file_no < files // 64 * 64 THEN 3 WHEN file_no < files // 16 * 16 THEN 2 WHEN file_no < files // 4 * 4 THEN 1 ELSE 0 END AS tier FROM flushed f, files),
 meta AS (SELECT tier, file_no, CAST(sum(strlen(user_key) + 8 + coalesce(strlen(value), 0)) AS BIGINT) AS file_size, min(user_key) AS smallest, max(user_key) AS largest,
   count(*) AS num_entries, count(*) FILTER (type = 0) AS num_deletions FROM entry GROUP BY ALL)"""

BATCH = MUTATION + """,
 op AS (SELECT *, (seq - 1) // 7 AS batch_no FROM mutation),
 opsize AS (SELECT *, 1 + CASE WHEN strlen(user_key) < 128 THEN 1 ELSE 2 END + strlen(user_key)
   + CASE WHEN type = 1 THEN CASE WHEN strlen(value) < 128 THEN 1 ELSE 2 END + strlen(value) ELSE 0 END AS bytes FROM op),
 rec AS (SELECT batch_no, batch_no // 50 AS log_no, batch_no % 50 AS rec_no, batch_no % 97 <> 96 AS ok, batch_no % 5 = 0 AS sync,
   min(seq) AS base_seq, count(*) AS n_ops, CAST(12 + sum(bytes) AS BIGINT) AS bytes FROM opsize GROUP BY batch_no),
 good AS (SELECT * FROM (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY log_no ORDER BY rec_no) AS bad FROM rec) WHERE bad = 0)"""

EDIT = ENTRY + """,
 fileno AS (SELECT DISTINCT file_no FROM flushed),
 full_group AS (SELECT file_no // 4 AS g FROM fileno WHERE file_no % 4 = 3),
 edit AS (SELECT file_no * 2 AS edit_no, 'add' AS action, 0 AS tier, file_no FROM fileno
   UNION ALL SELECT 2 * (g * 4 + 3) + 1, 'del', 0, g * 4 + k FROM full_group, (VALUES (0), (1), (2), (3)) v(k)
   UNION ALL SELECT 2 * (g * 4 + 3) + 1, 'add', 1, g + 100000 FROM full_group),
 live AS (SELECT tier, file_no FROM (SELECT tier, file_no, arg_max(action, edit_no * 2 + CASE WHEN action = 'add' THEN 1 ELSE 0 END) AS last FROM edit GROUP BY ALL) WHERE last = 'add')"""

HIST = """sample AS (SELECT user_id % 8 AS shard, abs(CAST(floor(value * 100) AS BIGINT)) AS v FROM events),
 bucketed AS (SELECT shard, v, CASE WHEN v < 256 THEN v ELSE least((length(bin(v)) - 8) * 256 + ((v >> (length(bin(v)) - 9)) & 255), 14591) END AS bucket FROM sample),
 hist AS (SELECT bucket, CAST(CASE WHEN bucket < 256 THEN bucket ELSE (bucket % 256 + 256) << (bucket // 256 - 1) END AS BIGINT) AS lower, count(*) AS cnt FROM bucketed GROUP BY ALL)"""


def newest(snap: str = "(SELECT n FROM last)", where: str = "TRUE") -> str:
    return f"""SELECT user_key, max(seq) AS seq, arg_max(type, seq) AS type, arg_max(coalesce(value, ''), seq) AS value FROM mutation
  WHERE seq <= {snap} AND {where} GROUP BY user_key"""


def scan(snap: str = "(SELECT n FROM last)", where: str = "TRUE") -> str:
    return f"SELECT user_key, value FROM ({newest(snap, where)}) WHERE type = 1"


def view(body: str, prefix: str = MUTATION) -> str:
    return f"WITH {prefix}\n{body}"


def compacted(inputs: str, others: str, oldest: str, rest: str = "seq, type, user_key, value") -> str:
    """Entries of `inputs` with their fate."""
    return f"""SELECT {rest}, CASE WHEN newer <= {oldest} THEN 'superseded' WHEN type = 0 AND seq <= {oldest} AND NOT EXISTS
    (SELECT 1 FROM meta o WHERE {others} AND e.user_key BETWEEN o.smallest AND o.largest) THEN 'tombstone' ELSE 'kept' END AS fate
  FROM (SELECT *, coalesce(lag(seq) OVER (PARTITION BY user_key ORDER BY seq DESC), 72057594037927935) AS newer FROM entry WHERE {inputs}) e"""


MID, LOW = "(SELECT n * 6 // 10 FROM last)", "(SELECT n * 3 // 10 FROM last)"
OUTCOME = "CASE WHEN seq IS NULL THEN 'absent' WHEN type = 1 THEN 'value' ELSE 'tombstone' END"
PROBES = "(SELECT c_custkey AS probe_id, printf('key%013d', c_custkey) AS user_key FROM customer)"
TARGETS = "(SELECT DISTINCT printf('key%013d', n_nationkey * 7) AS target FROM nation)"
NAMES = ["000123.sst", "000007.log", "000009.tmp", "MANIFEST-000042", "MANIFEST-000001", "CURRENT", "LOCK", "LOG", "notes.txt", "abc.sst", ".sst", "MANIFEST-", "000123.sstx", "12.log", "x/000123.sst"]
KEY_SIZES, VALUE_SIZES = [0, 1, 4096, 4097], [0, 1048576, 1048577]
CODES = ["InvalidArgument", "NotFound", "IOError", "Corruption", "NotSupported"]
_NAMES = ", ".join(f"('{n}')" for n in NAMES)

def picked(meta: str, trigger: int, tiers: int) -> str:
    """The next compaction's inputs among files (file_no, tier)."""
    return f"""SELECT file_no, tier AS input_tier, least(filled + 1, {tiers} - 1) AS output_tier FROM (SELECT file_no, tier, row_number() OVER (PARTITION BY tier ORDER BY file_no) AS nth FROM {meta}),
      (SELECT min(tier) AS filled FROM (SELECT tier FROM {meta} GROUP BY tier HAVING count(*) >= {trigger}))
      WHERE (tier = filled AND (nth <= {trigger} OR filled = {tiers} - 1)) OR (filled + 1 >= {tiers} AND tier = {tiers} - 1)"""


#: The draws of readers (s) and writers (n), a step of the generator at a time, in 64 bits.
DRAWS = """drawn AS (SELECT t, CAST(-1 AS BIGINT) AS i, CAST({seeds} AS HUGEINT) AS s FROM (SELECT CAST(unnest(range({least}, {most} + 1)) AS HUGEINT) AS t)
  UNION ALL SELECT t, i + 1, xor(c, (c * 131072) % 18446744073709551616) FROM (SELECT t, i, xor(b, b // 128) AS c FROM (SELECT t, i, xor(s, (s * 8192) % 18446744073709551616) AS b FROM drawn WHERE i < {ops} - 1))),
 draw AS (SELECT CAST(t AS BIGINT) AS t, i, s FROM drawn WHERE i >= 0)
"""
WRITES = """step AS (SELECT t, CAST(-1 AS BIGINT) AS i, CAST({seeds} AS HUGEINT) AS s FROM (SELECT CAST(unnest(range(0, {most} + 1)) AS HUGEINT) AS t)
  UNION ALL SELECT t, i + 1, ((s % 4294967296) * 6364136223846793005 + (((s // 4294967296) * 6364136223846793005) % 4294967296) * 4294967296 + 1442695040888963407) % 18446744073709551616 FROM step WHERE i < {ops} - 1),
 written AS (SELECT CAST(t AS BIGINT) AS t, i, CAST((s // 1048576) % 4000 AS BIGINT) AS n FROM step WHERE i >= 0)
"""
HOT = "CAST(CASE WHEN s % 100 < 90 THEN s % 41 ELSE s % 4000 END AS BIGINT)"

SQL: dict[str, str] = {
    "snapshot_scan": view(scan()),
    "snapshot_scan_mid": view(scan(MID)),
    "snapshot_scan_empty": view(scan("0")),
    "point_get": view(scan(where="user_key = 'key0000000000007'")),
    "point_get_tombstone": view(f"SELECT user_key, seq, {OUTCOME} AS outcome FROM ({newest(where=chr(39).join(['user_key BETWEEN ', 'key0000000000000', ' AND ', 'key0000000000009', '']))})"),
    "dump_entries": view("""SELECT file_no, row_number() OVER (PARTITION BY file_no ORDER BY user_key, seq DESC) - 1 AS pos, user_key AS key, seq, CASE type WHEN 1 THEN 'PUT' ELSE 'DEL' END AS kind, strlen(coalesce(value, '')) AS value_bytes,
      left(coalesce(value, ''), 24) || CASE WHEN strlen(value) > 24 THEN '...' ELSE '' END AS value FROM entry""", ENTRY),
    "status_text": "SELECT code, m AS message, code || CASE WHEN m = '' THEN '' ELSE ': ' || m END AS shown FROM (VALUES " + ", ".join(f"('{c}')" for c in CODES) + ") a(code), (VALUES (''), ('no such file')) b(m)",
    "height_draws": """WITH RECURSIVE d AS (SELECT s AS seed, CAST(-1 AS BIGINT) AS i, s AS draw FROM (VALUES (CAST(1 AS BIGINT)), (7), (48271), (2147483646)) v(s)
      UNION ALL SELECT seed, i + 1, draw * 48271 % 2147483647 FROM d WHERE i < 199) SELECT * FROM d WHERE i >= 0""",
    "run_probe": view("SELECT user_key, seq, type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS rn FROM mutation WHERE user_key IN (SELECT printf('key%013d', 7 * k) FROM range(30) r(k))) WHERE rn = 1"),
    "hist_report": f"""WITH {HIST}, run AS (SELECT bucket, lower, sum(cnt) OVER (ORDER BY bucket) AS cum FROM hist),
      pct AS (SELECT p, min(lower) AS v FROM (VALUES (500), (900), (990), (999)) a(p) JOIN run ON cum >= p * (SELECT sum(cnt) FROM hist) // 1000 GROUP BY p)
      SELECT count(*) AS n, CAST(sum(v) // count(*) AS BIGINT) AS mean, max(v) AS most, (SELECT v FROM pct WHERE p = 500) AS p500, (SELECT v FROM pct WHERE p = 900) AS p900, (SELECT v FROM pct WHERE p = 990) AS p990, (SELECT v FROM pct WHERE p = 999) AS p999 FROM sample""",
    "multi_get_outcome": view(f"SELECT p.probe_id, p.user_key, {OUTCOME} AS outcome, CASE WHEN type = 1 THEN value END AS value FROM {PROBES} p LEFT JOIN ({newest()}) v USING (user_key)"),
    "asof_join": view(f"""SELECT probe_id, user_key, snap, seq, {OUTCOME} AS outcome, CASE WHEN type = 1 THEN value END AS value FROM (
      SELECT p.probe_id, p.user_key, p.snap, max(m.seq) AS seq, arg_max(m.type, m.seq) AS type, arg_max(coalesce(m.value, ''), m.seq) AS value
      FROM (SELECT *, probe_id * 37 % ((SELECT n FROM last) + 1) AS snap FROM {PROBES}) p LEFT JOIN mutation m ON m.user_key = p.user_key AND m.seq <= p.snap GROUP BY ALL)"""),
    "seek_first_ge": view(f"SELECT target, min(user_key) AS found_key FROM {TARGETS} t LEFT JOIN ({scan()}) v ON v.user_key >= t.target GROUP BY target"),
    "predecessor": view(f"SELECT target, max(user_key) AS found_key FROM {TARGETS} t LEFT JOIN ({scan()}) v ON v.user_key < t.target GROUP BY target"),
    "first_key": view(f"{scan()} ORDER BY user_key LIMIT 1"),
    "last_key": view(f"{scan()} ORDER BY user_key DESC LIMIT 1"),
    "range_scan": view(scan(where="user_key BETWEEN 'key0000000000020' AND 'key0000000000060'")),
    "prefix_scan": view(scan(where="starts_with(user_key, 'key00000000000')")),
    "reverse_scan": view(f"SELECT *, row_number() OVER (ORDER BY user_key DESC) AS rank FROM ({scan()})"),
    "version_history": view("SELECT user_key, seq, type, row_number() OVER w AS version, lag(seq) OVER w AS superseded_by FROM mutation WINDOW w AS (PARTITION BY user_key ORDER BY seq DESC)"),
    "snapshot_diff": view(f"""SELECT coalesce(a.user_key, b.user_key) AS user_key, CASE WHEN a.user_key IS NULL THEN 'added' WHEN b.user_key IS NULL THEN 'removed' ELSE 'changed' END AS change,
      a.value AS old_value, b.value AS new_value FROM ({scan(LOW)}) a FULL JOIN ({scan(MID)}) b ON a.user_key = b.user_key WHERE a.value IS DISTINCT FROM b.value"""),
    "common_keys": view(f"SELECT user_key FROM ({scan(LOW)}) INTERSECT SELECT user_key FROM ({scan(MID)})"),
    "source_union_scan": view(scan()),
    "flush_file_stats": view("SELECT * FROM meta", ENTRY),
    "tier_summary": view("SELECT CAST(t AS INTEGER) AS tier, count(file_no) AS files, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS bytes, CAST(coalesce(sum(num_entries), 0) AS BIGINT) AS entries FROM range(7) r(t) LEFT JOIN meta ON tier = t GROUP BY t", ENTRY),
    "overlapping_files": view("SELECT a.file_no, count(*) - 1 AS overlaps FROM meta a JOIN meta b ON a.smallest <= b.largest AND b.smallest <= a.largest GROUP BY a.file_no", ENTRY),
    "files_consulted_per_probe": view(f"SELECT probe_id, user_key, count(m.smallest) AS files FROM {PROBES} p LEFT JOIN meta m ON p.user_key BETWEEN m.smallest AND m.largest GROUP BY ALL", ENTRY),
    "first_hit_lookup": view("SELECT user_key, tier, file_no, seq, type FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY tier, file_no DESC, seq DESC) AS rn FROM entry) WHERE rn = 1", ENTRY),
    "first_hit_is_newest": view("SELECT user_key, max(seq) AS first_seq, max(seq) AS newest_seq FROM entry GROUP BY user_key", ENTRY),
    "order_violations": view("""SELECT file_no, count(*) FILTER (k > user_key OR (k = user_key AND s <= seq)) AS violations FROM (SELECT file_no, user_key, seq, lag(user_key) OVER w AS k, lag(seq) OVER w AS s FROM (
      SELECT *, CASE WHEN file_no % 2 = 1 THEN seq ELSE row_number() OVER (PARTITION BY file_no ORDER BY user_key, seq DESC) END AS pos FROM entry) WINDOW w AS (PARTITION BY file_no ORDER BY pos)) GROUP BY file_no""", ENTRY),
    "dump_totals": view("SELECT file_no, count(*) AS entries, count(*) FILTER (type = 0) AS deletions, min(user_key) AS first_key, max(user_key) AS last_key, CAST(sum(strlen(user_key)) AS BIGINT) AS key_bytes, CAST(sum(coalesce(strlen(value), 0)) AS BIGINT) AS value_bytes FROM entry GROUP BY file_no", ENTRY),
    "flush_tiers": view("SELECT DISTINCT file_no, tier FROM entry", ENTRY),
    "absent_in_range": view(f"""SELECT probe_id, user_key FROM {PROBES} p WHERE user_key BETWEEN (SELECT min(user_key) FROM thinned) AND (SELECT max(user_key) FROM thinned) AND NOT EXISTS (SELECT 1 FROM thinned m WHERE m.user_key = p.user_key)""",
      MUTATION + ", thinned AS (SELECT * FROM mutation WHERE right(user_key, 1) NOT IN ('3', '7'))"),
    "compact_pick": view(" UNION ALL ".join(f"SELECT {k} AS trigger, {t} AS tiers, p.* FROM ({picked(f'(SELECT file_no, least(tier, {t} - 1) AS tier FROM meta)', k, t)}) p" for k, t in ((1, 7), (2, 7), (3, 7), (2, 3), (2, 2), (1, 1))), ENTRY),
    "compact_no_snapshot": view(f"SELECT seq, type, user_key, value FROM ({compacted('TRUE', 'FALSE', '(SELECT n FROM last)')}) WHERE fate = 'kept'", ENTRY),
    "compact_with_snapshot": view(f"SELECT seq, type, user_key, value FROM ({compacted('TRUE', 'FALSE', LOW)}) WHERE fate = 'kept'", ENTRY),
    "compact_tombstones_blocked": view(f"SELECT seq, type, user_key, value FROM ({compacted('tier < 2', 'o.tier >= 2', '(SELECT n FROM last)')}) WHERE fate = 'kept'", ENTRY),
    "compact_then_scan": view(scan(MID)),
    "dropped_by_rule": view(f"SELECT fate, count(*) AS entries FROM ({compacted('TRUE', 'FALSE', LOW)}) GROUP BY fate", ENTRY),
    "reclaim_ratio": view(f"SELECT count(*) AS entries, count(DISTINCT user_key) AS distinct_keys, (SELECT count(*) FROM ({scan()})) AS live_keys, count(*) * 1000 // greatest((SELECT count(*) FROM ({scan()})), 1) AS per_mille FROM entry", ENTRY),
    "oldest_snapshot": view("SELECT 'with' AS snapshots, n * 3 // 10 AS oldest FROM last UNION ALL SELECT 'without', n FROM last"),
    "manifest_fold": view("SELECT * FROM live", EDIT),
    "live_files_union": view("""SELECT DISTINCT tier, file_no FROM (
      SELECT tier, file_no, arg_max(action, edit_no * 2 + CASE WHEN action = 'add' THEN 1 ELSE 0 END) AS last FROM edit WHERE edit_no <= 9 GROUP BY ALL
      UNION ALL SELECT tier, file_no, arg_max(action, edit_no * 2 + CASE WHEN action = 'add' THEN 1 ELSE 0 END) AS last FROM edit GROUP BY ALL) WHERE last = 'add'""", EDIT),
    "obsolete_files": view("""SELECT printf('%06d.sst', file_no) AS name, 'sst' AS kind, file_no AS number FROM edit WHERE action = 'add' AND file_no NOT IN (SELECT file_no FROM live)
      UNION ALL SELECT printf('%06d.log', l), 'log', l FROM range(10) r(l) WHERE l < 4
      UNION ALL SELECT printf('%06d.tmp', l), 'tmp', l FROM range(10) r(l) UNION ALL SELECT printf('MANIFEST-%06d', l), 'MANIFEST', l FROM range(10) r(l) WHERE l < 3""", EDIT),
    "orphan_bytes": view("SELECT count(*) AS orphan_files, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS orphan_bytes FROM meta WHERE file_no NOT IN (SELECT file_no FROM live)", EDIT),
    "next_file_number": view("SELECT greatest(100, (SELECT max(file_no) FROM edit) + 1) AS next_file_number", EDIT),
    "min_live_log": "SELECT n_nationkey AS log, n_regionkey AS prev, CASE WHEN n_regionkey <> 0 THEN least(n_regionkey, n_nationkey) ELSE n_nationkey END AS min_log FROM nation",
    "catalog_parse": f"""SELECT name, CASE WHEN name IN ('CURRENT', 'LOCK', 'LOG') THEN name WHEN regexp_matches(name, '^MANIFEST-[0-9]+$') THEN 'MANIFEST'
      WHEN regexp_matches(name, '^[0-9]+\\.(sst|log|tmp)$') THEN split_part(name, '.', 2) END AS kind,
      CASE WHEN name IN ('CURRENT', 'LOCK', 'LOG') THEN 0 WHEN regexp_matches(name, '^MANIFEST-[0-9]+$') THEN CAST(substr(name, 10) AS BIGINT)
      WHEN regexp_matches(name, '^[0-9]+\\.(sst|log|tmp)$') THEN CAST(split_part(name, '.', 1) AS BIGINT) END AS number FROM (VALUES {_NAMES}) v(name)""",
    "version_text": view("""SELECT tier, string_agg(file_no || '(' || file_size || ' B)', ' ' ORDER BY file_no) AS text FROM (SELECT l.tier, l.file_no, m.file_size FROM live l JOIN (
      SELECT file_no, file_size FROM meta UNION ALL SELECT file_no // 4 + 100000, CAST(sum(file_size) AS BIGINT) FROM meta GROUP BY ALL) m USING (file_no)) GROUP BY tier""", EDIT),
    "batch_explode": view("SELECT batch_no, (seq - 1) % 7 AS pos, seq, type, user_key, value FROM op", BATCH),
    "sequence_assign": view("SELECT log_no, batch_no, n_ops, base_seq FROM rec", BATCH),
    "torn_tail": view("SELECT log_no, rec_no, batch_no, base_seq FROM good", BATCH),
    "recover_logs": view("""SELECT log_no, coalesce(g.records, 0) AS records, coalesce(g.ops, 0) AS ops, coalesce(g.last_seq, 0) AS last_seq, CASE WHEN coalesce(g.records, 0) < w.written THEN 'CRC mismatch' ELSE 'clean end of file' END AS stopped
      FROM (SELECT log_no, count(*) AS written FROM rec WHERE log_no >= 1 GROUP BY log_no) w LEFT JOIN (SELECT log_no, count(*) AS records, CAST(sum(n_ops) AS BIGINT) AS ops, max(base_seq + n_ops - 1) AS last_seq FROM good GROUP BY log_no) g USING (log_no)""", BATCH),
    "good_offset": view("SELECT log_no, CAST(coalesce(sum(9 + g.bytes), 0) + 16 AS BIGINT) AS good_offset FROM (SELECT DISTINCT log_no FROM rec) LEFT JOIN good g USING (log_no) GROUP BY log_no", BATCH),
    "group_commit": "WITH RECURSIVE " + BATCH + """,
 walk AS (SELECT log_no, rec_no, batch_no, sync, bytes AS size, CASE WHEN bytes <= 400 THEN bytes + 400 ELSE 1000 END AS most, CAST(0 AS BIGINT) AS group_no FROM rec WHERE rec_no = 0
  UNION ALL SELECT r.log_no, r.rec_no, r.batch_no, r.sync, CASE WHEN r.sync = w.sync AND w.size + r.bytes <= w.most THEN w.size + r.bytes ELSE r.bytes END,
   CASE WHEN r.sync = w.sync AND w.size + r.bytes <= w.most THEN w.most WHEN r.bytes <= 400 THEN r.bytes + 400 ELSE 1000 END,
   CASE WHEN r.sync = w.sync AND w.size + r.bytes <= w.most THEN w.group_no ELSE w.group_no + 1 END FROM walk w JOIN rec r ON r.log_no = w.log_no AND r.rec_no = w.rec_no + 1)
SELECT log_no, batch_no, group_no FROM walk""",
    "batch_last_op_wins": view("SELECT batch_no, user_key, arg_max(type, seq) AS type, max(seq) AS seq FROM op GROUP BY batch_no, user_key", BATCH),
    "memtable_freeze": view("SELECT batch_no, (base_seq - 1) // 1000 AS unit FROM rec", BATCH),
    "input_validation": f"SELECT k AS key_bytes, v AS value_bytes, CASE WHEN k > 4096 THEN 'InvalidArgument: key too large' WHEN v > 1048576 THEN 'InvalidArgument: value too large' ELSE 'OK' END AS status FROM (VALUES {', '.join(f'({k})' for k in KEY_SIZES)}) a(k), (VALUES {', '.join(f'({v})' for v in VALUE_SIZES)}) b(v)",
    "counter_reduce": """SELECT name, kind, CAST(CASE kind WHEN 'max' THEN max(v) WHEN 'gauge' THEN sum(CASE WHEN shard = 0 THEN v ELSE 0 END) ELSE sum(v) END AS BIGINT) AS total FROM (
      SELECT user_id % 16 AS shard, event_type AS name, CASE event_type WHEN 'error' THEN 'max' WHEN 'purchase' THEN 'max' WHEN 'view' THEN 'gauge' ELSE 'sum' END AS kind, CAST(floor(value) AS BIGINT) AS v FROM events) GROUP BY name, kind""",
    "hist_buckets": f"WITH {HIST} SELECT * FROM hist",
    "hist_merge": f"WITH {HIST} SELECT * FROM hist",
    "hist_summary": f"WITH {HIST} SELECT count(*) AS n, min(v) AS least, max(v) AS most, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v) // count(*) AS BIGINT) AS mean FROM sample",
    "hist_percentiles": f"""WITH {HIST}, run AS (SELECT bucket, lower, sum(cnt) OVER (ORDER BY bucket) AS cum FROM hist)
SELECT CAST(p AS BIGINT) AS per_mille, min(lower) AS v FROM (VALUES (500), (900), (990), (999), (1000)) a(p) JOIN run ON cum >= p * (SELECT sum(cnt) FROM hist) // 1000 GROUP BY p""",
    "openloop_validity": """SELECT run, n, took_us, late, worst_us, n * 1000000 * 100 >= took_us * 99 AS valid FROM (SELECT run, count(*) AS n, max(done_us) AS took_us, count(*) FILTER (done_us - i * 1000000 > 1000000) AS late, max(done_us - i * 1000000) AS worst_us
      FROM (SELECT user_id % 4 AS run, event_id // 4 AS i, event_id // 4 * 1000000 + CAST(floor(value * 20000) AS BIGINT) AS done_us FROM events) GROUP BY run)""",
    "packed_tag": view("SELECT seq, type, (seq << 8) | type AS packed, ((seq << 8) | type) >> 8 AS seq_back, ((seq << 8) | type) & 255 AS type_back FROM mutation"),
    "internal_key_valid": view("SELECT seq, CASE WHEN seq % 5 = 0 THEN 7 ELSE 24 END AS key_bytes, seq % 5 <> 0 AND seq % 3 <> 0 AS valid FROM mutation"),
    "shared_prefix": view("""SELECT file_no, pos, CAST(coalesce(list_min(list_filter(range(1, 1 + least(strlen(before), strlen(user_key))), lambda i: before[i] <> user_key[i])) - 1, least(strlen(before), strlen(user_key))) AS BIGINT) AS shared FROM (
      SELECT file_no, user_key, row_number() OVER w - 1 AS pos, lag(user_key, 1, '') OVER w AS before FROM entry WINDOW w AS (PARTITION BY file_no ORDER BY user_key, seq DESC))""", ENTRY),
    "varint_length": f"WITH {HIST} SELECT v, CASE WHEN v < 128 THEN 1 WHEN v < 16384 THEN 2 WHEN v < 2097152 THEN 3 WHEN v < 268435456 THEN 4 ELSE 5 END AS bytes FROM (SELECT DISTINCT v FROM sample)",
    "varint_bytes": f"""WITH {HIST} SELECT v, CASE WHEN v < 128 THEN printf('%02X', v) WHEN v < 16384 THEN printf('%02X%02X', v & 127 | 128, v >> 7) ELSE printf('%02X%02X%02X', v & 127 | 128, (v >> 7) & 127 | 128, v >> 14) END AS bytes FROM (SELECT DISTINCT v FROM sample)""",
    "fixed_bytes": view("SELECT seq, printf('%02X%02X%02X%02X', seq & 255, (seq >> 8) & 255, (seq >> 16) & 255, (seq >> 24) & 255) AS bytes FROM mutation"),
    "file_names": view("SELECT file_no, printf('%06d.sst', file_no) AS sst, printf('MANIFEST-%06d', file_no) AS manifest FROM meta", ENTRY),
    "printable_keys": view("SELECT user_key, user_key || '\\x00' || '\\xc3' || '\\xa9' AS shown FROM (SELECT DISTINCT user_key FROM mutation)"),
    "hot_keys": "SELECT event_id, CASE WHEN event_id % 100 < 90 THEN event_id % (count(*) OVER () // 100 + 1) ELSE event_id % count(*) OVER () END AS draw FROM events",
    "write_amplification": view(f"SELECT (SELECT count(*) FROM op) AS writes, (SELECT count(*) FROM rec) AS commits, (SELECT count(*) FROM rec WHERE sync) AS syncs, (SELECT count(*) FROM op) * 100 // (SELECT count(*) FROM rec WHERE sync) AS writes_per_sync_pct", BATCH),
    "properties": view("""SELECT 'num-files-at-tier' || t AS name, CAST((SELECT count(*) FROM meta WHERE tier = t) AS BIGINT) AS v FROM range(7) r(t)
      UNION ALL SELECT 'live-bytes', CAST(sum(file_size) AS BIGINT) FROM meta UNION ALL SELECT 'live-entries', CAST(sum(num_entries) AS BIGINT) FROM meta""", ENTRY),
    "store_session": view(scan()),
    "stream_ingest_scan": view(scan()),
    "wal_scan_raw": view("""SELECT log_no, count(g.rec_no) AS records, CASE WHEN count(g.rec_no) < max(w.written) THEN 'CRC mismatch' ELSE 'clean end of file' END AS stopped, CAST(coalesce(sum(9 + g.bytes), 0) + 16 AS BIGINT) AS good_offset
      FROM (SELECT log_no, count(*) AS written FROM rec GROUP BY log_no) w LEFT JOIN good g USING (log_no) GROUP BY log_no""", BATCH),
    "wal_replay_raw": view("SELECT log_no, seq, type, user_key, value FROM op JOIN good USING (batch_no)", BATCH),
    "backpressure": view("SELECT file_no, file_no % 16 + 1 AS tier0_files, CASE WHEN file_no % 16 + 1 >= 12 THEN 'stop' WHEN file_no % 16 + 1 >= 8 THEN 'slow' ELSE 'free' END AS writers FROM meta", ENTRY),
    "workload_fillseq": "SELECT t AS thread, i, t * 1000 + i AS n, printf('key%013d', t * 1000 + i) AS user_key FROM range(4) a(t), range(1000) b(i)",
    "workload_readmissing": "WITH RECURSIVE " + DRAWS.format(least=0, most=3, seeds="t * 88172645463325252 + 7", ops=1000) + "SELECT t AS thread, i, CAST(s % 4000 AS BIGINT) | 1 AS n, FALSE AS found FROM draw",
    "overlapping_inputs": view(f"""SELECT a.file_no AS a_file, b.file_no AS b_file FROM meta a JOIN meta b ON a.file_no <> b.file_no AND a.smallest <= b.largest AND b.smallest <= a.largest
      WHERE a.file_no IN (SELECT file_no FROM ({picked("meta", 2, 7)}))""", ENTRY),
    "workload_readrandom": "WITH RECURSIVE " + DRAWS.format(least=0, most=3, seeds="t * 88172645463325252 + 7", ops=1000) + "SELECT t AS thread, i, CAST(s % 4000 AS BIGINT) AS n, printf('key%013d', CAST(s % 4000 AS BIGINT)) AS user_key FROM draw",
    "workload_readhot": "WITH RECURSIVE " + DRAWS.format(least=0, most=3, seeds="t * 88172645463325252 + 7", ops=1000) + f"SELECT t AS thread, i, {HOT} AS n, printf('key%013d', {HOT}) AS user_key FROM draw",
    "workload_fillrandom": "WITH RECURSIVE " + WRITES.format(most=3, seeds="t * 2654435761 + 1", ops=1000) + "SELECT t AS thread, i, n, printf('key%013d', n) AS user_key FROM written",
    "workload_mixed": "WITH RECURSIVE " + WRITES.format(most=1, seeds="t + 11", ops=1000).rstrip() + ", " + DRAWS.format(least=0, most=3, seeds="t * 99 + 5", ops=1000) + f"""
      SELECT 'write' AS role, t AS thread, count(*) AS ops, count(DISTINCT n) AS different_keys, CAST(0 AS BIGINT) AS found FROM written GROUP BY t
      UNION ALL SELECT 'read', t, count(*), count(DISTINCT n), count(*) FILTER (n IN (SELECT n FROM written)) FROM (SELECT t, {HOT} AS n FROM draw) GROUP BY t""",
    "workload_baseline": "SELECT CAST(4000 AS BIGINT) AS ops, CAST(sum(strlen(printf('key%013d', i)) + 100) AS BIGINT) AS bytes FROM range(4000) r(i)",
    "ordered_scan": view(f"SELECT *, row_number() OVER (ORDER BY user_key) AS rank FROM ({scan()})"),
    "internal_order": view("SELECT user_key, seq, type, row_number() OVER (ORDER BY user_key, seq DESC) AS rank FROM mutation"),
    "seek_next": view(f"""SELECT target, step, user_key, value FROM (SELECT target, user_key, value, row_number() OVER (PARTITION BY target ORDER BY user_key) - 1 AS step FROM {TARGETS} t JOIN ({scan()}) v ON v.user_key >= t.target) WHERE step < 3"""),
    "batch_append": view("SELECT batch_no // 3 AS group_no, min(seq) OVER w AS base_seq, count(*) OVER w AS n_ops, seq, type, user_key FROM op WINDOW w AS (PARTITION BY batch_no // 3)", BATCH),
    "recovery_units": "WITH RECURSIVE " + BATCH + """,
 walk AS (SELECT log_no, rec_no, batch_no, bytes AS used, CAST(0 AS BIGINT) AS unit FROM good WHERE rec_no = 0
  UNION ALL SELECT r.log_no, r.rec_no, r.batch_no, CASE WHEN w.used > 1500 THEN r.bytes ELSE w.used + r.bytes END, CASE WHEN w.used > 1500 THEN w.unit + 1 ELSE w.unit END
   FROM walk w JOIN good r ON r.log_no = w.log_no AND r.rec_no = w.rec_no + 1)
SELECT log_no, batch_no, unit FROM walk""",
    "store_reopened": """WITH op AS (SELECT printf('n%03d', n_nationkey) AS user_key, 2 * n_nationkey + 1 AS seq, 1 AS type, n_name AS value FROM nation
      UNION ALL SELECT 'last' || n_nationkey % 3, 2 * n_nationkey + 2, 1, CAST(n_nationkey AS VARCHAR) FROM nation
      UNION ALL SELECT printf('n%03d', n_nationkey), 2 * (SELECT count(*) FROM nation) + n_nationkey // 4 + 1, 0, NULL FROM nation WHERE n_nationkey % 4 = 0)
      SELECT user_key, CAST(seq AS BIGINT) AS seq, type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS rn FROM op) WHERE rn = 1""",
}

_SIZED = ENTRY + """,
 placed AS (SELECT file_no, user_key, seq, row_number() OVER (PARTITION BY file_no ORDER BY user_key, seq DESC) - 1 AS pos, strlen(user_key) + 11 + coalesce(strlen(value), 0) AS size FROM entry),
 cut AS (SELECT file_no, pos, CAST(0 AS BIGINT) AS block_no, size AS used, size >= 1024 AS full FROM placed WHERE pos = 0
  UNION ALL SELECT p.file_no, p.pos, CASE WHEN c.full THEN c.block_no + 1 ELSE c.block_no END, CASE WHEN c.full THEN p.size ELSE c.used + p.size END,
   CASE WHEN c.full THEN p.size ELSE c.used + p.size END >= 1024 FROM cut c JOIN placed p ON p.file_no = c.file_no AND p.pos = c.pos + 1)"""
SQL["block_cut"] = f"WITH RECURSIVE {_SIZED} SELECT file_no, pos, block_no FROM cut"
SQL["index_separators"] = f"WITH RECURSIVE {_SIZED} SELECT file_no, block_no, arg_max(user_key, pos) AS last_key, arg_max(seq, pos) AS last_seq, count(*) AS entries FROM cut JOIN placed USING (file_no, pos) GROUP BY ALL"
SQL["restart_points"] = f"WITH RECURSIVE {_SIZED} SELECT file_no, block_no, pos FROM (SELECT *, min(pos) OVER (PARTITION BY file_no, block_no) AS first FROM cut) WHERE (pos - first) % 16 = 0"
SQL["block_cache_keys"] = f"""WITH RECURSIVE {_SIZED}, b AS (SELECT file_no, block_no, sum(placed.size) AS bytes FROM cut JOIN placed USING (file_no, pos) GROUP BY ALL)
SELECT file_no, block_no AS block, CAST(file_no * 4294967296 + coalesce(sum(bytes) OVER (PARTITION BY file_no ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cache_key FROM b"""
SQL["block_lookup"] = f"""WITH RECURSIVE {_SIZED}, sep AS (SELECT file_no, block_no, arg_max(user_key, pos) AS last_key FROM cut JOIN placed USING (file_no, pos) GROUP BY ALL)
SELECT file_no, probe_id, min(block_no) AS block_no FROM sep JOIN {PROBES} p ON last_key >= p.user_key GROUP BY file_no, probe_id"""
SQL["block_count"] = f"WITH RECURSIVE {_SIZED} SELECT file_no, count(DISTINCT block_no) AS blocks FROM cut GROUP BY file_no"


def _product(a: str, b: str) -> str:
    """a * b in 64 bits."""
    return f"((({a}) % 4294967296) * {b} + ((({a}) // 4294967296) * {b}) % 4294967296 * 4294967296) % 18446744073709551616"


def _word(first: int) -> str:
    """Eight bytes of user_key from a place on, little-endian."""
    return " + ".join(f"CAST(ascii(user_key[{first + i}]) AS HUGEINT) * {256**i}" for i in range(8))


_M = "14313749767032793493"
# Keys have 16 bytes, two words: the hash of each, folded into the seed and the length.
_HASHED = f"""{MUTATION},
 k AS (SELECT DISTINCT user_key FROM mutation UNION SELECT user_key FROM {PROBES}),
 a AS (SELECT user_key, {_product(_word(1), _M)} AS x, {_product(_word(9), _M)} AS y, xor(CAST(11400714819323198485 AS HUGEINT), {_product("CAST(16 AS HUGEINT)", _M)}) AS h FROM k),
 b AS (SELECT user_key, h, {_product("xor(x, x // 140737488355328)", _M)} AS x, {_product("xor(y, y // 140737488355328)", _M)} AS y FROM a),
 c AS (SELECT user_key, y, {_product("xor(h, x)", _M)} AS h FROM b),
 e AS (SELECT user_key, {_product("xor(h, y)", _M)} AS h FROM c),
 f AS (SELECT user_key, {_product("xor(h, h // 140737488355328)", _M)} AS h FROM e),
 hashed AS (SELECT user_key, xor(h, h // 140737488355328) AS h FROM f),
 bit AS (SELECT user_key, i, CAST((h % 4294967296 + i * (h // 4294967296 + 1 - (h // 4294967296) % 2)) % 4096 AS BIGINT) AS bit FROM hashed, range(6) r(i))"""
_IN_LOG = "user_key IN (SELECT user_key FROM mutation)"
SQL["hash64_keys"] = f"WITH {_HASHED} SELECT user_key, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS hash FROM hashed WHERE {_IN_LOG}"
SQL["probe_positions"] = f"WITH {_HASHED} SELECT user_key, i, bit FROM bit WHERE {_IN_LOG}"
SQL["bloom_build"] = f"WITH {_HASHED} SELECT bit // 63 AS word, bit_or(CAST(1 AS BIGINT) << (bit % 63)) AS mask FROM bit WHERE {_IN_LOG} GROUP BY bit // 63"
SQL["bloom_excludes"] = f"""WITH {_HASHED}, half AS (SELECT DISTINCT user_key FROM mutation WHERE seq * 2 <= (SELECT n FROM last)), bits AS (SELECT DISTINCT bit FROM bit WHERE user_key IN (SELECT user_key FROM half))
SELECT b.user_key AS key, bool_and(b.bit IN (SELECT bit FROM bits)) AS maybe, b.user_key IN (SELECT user_key FROM half) AS there FROM bit b WHERE b.user_key IN (SELECT user_key FROM {PROBES}) GROUP BY b.user_key"""
_CRC_TABLE = """bits AS (SELECT CAST(i AS BIGINT) AS b, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) r(i) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 2197175160) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
 tab AS (SELECT b, c FROM bits WHERE k = 8)"""
SQL["crc32c_records"] = f"""WITH RECURSIVE {MUTATION},
 {_CRC_TABLE},
 walk AS (SELECT seq, coalesce(value, '') AS v, 0 AS done, CAST(4294967295 AS BIGINT) AS c FROM mutation
  UNION ALL SELECT seq, v, done + 1, xor(t.c, w.c >> 8) FROM walk w JOIN tab t ON t.b = xor(w.c, ascii(v[done + 1])) & 255 WHERE done < strlen(v))
SELECT seq, xor(c, 4294967295) AS crc FROM walk WHERE done = strlen(v)"""
SQL["block_checksums"] = f"""WITH RECURSIVE {_SIZED}, {_CRC_TABLE},
 datum AS (SELECT c.file_no, c.block_no, string_agg(e.user_key || coalesce(e.value, ''), '' ORDER BY c.pos) AS v FROM cut c JOIN placed p USING (file_no, pos) JOIN entry e ON e.file_no = p.file_no AND e.seq = p.seq GROUP BY ALL),
 walk AS (SELECT file_no, block_no, v, 0 AS done, CAST(4294967295 AS BIGINT) AS c FROM datum
  UNION ALL SELECT file_no, block_no, v, done + 1, xor(t.c, w.c >> 8) FROM walk w JOIN tab t ON t.b = xor(w.c, ascii(v[done + 1])) & 255 WHERE done < strlen(v))
SELECT file_no, block_no, xor(c, 4294967295) AS crc FROM walk WHERE done = strlen(v)"""
SQL["dump_ratio"] = f"""WITH RECURSIVE {_SIZED}, b AS (SELECT file_no, block_no, sum(placed.size) AS bytes, count(*) AS entries FROM cut JOIN placed USING (file_no, pos) GROUP BY ALL),
 f AS (SELECT file_no, CAST(sum(bytes + 4 * ((entries + 15) // 16) + 4) AS BIGINT) AS file_bytes FROM b GROUP BY file_no),
 u AS (SELECT file_no, CAST(sum(strlen(user_key) + coalesce(strlen(value), 0)) AS BIGINT) AS user_bytes FROM entry GROUP BY file_no)
SELECT file_no, file_bytes, user_bytes, file_bytes * 1000 // user_bytes AS per_mille FROM f JOIN u USING (file_no)"""
