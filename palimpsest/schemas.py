"""Schemas of the log's tables. Keys and values are BINARY in general; the carriers here use ASCII strings."""

from __future__ import annotations

MUTATION = "seq bigint, type int, user_key string, value string"
ENTRY = f"{MUTATION}, file_no bigint, tier int"
BATCH = "batch_no bigint, sync boolean, base_seq bigint, ops array<struct<seq: bigint, type: int, user_key: string, value: string>>"
WAL_RECORD = "log_no bigint, rec_no bigint, len bigint, ok boolean, payload binary"
FILE_META = "tier int, file_no bigint, file_size bigint, smallest string, largest string, num_entries bigint, num_deletions bigint"
VERSION_EDIT = "edit_no bigint, action string, tier int, file_no bigint"
COUNTER = "shard int, name string, kind string, v bigint"

DELETION, VALUE = 0, 1
MAX_SEQ = (1 << 56) - 1
