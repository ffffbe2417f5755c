"""The settings that change results."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    tier_trigger: int = 4
    max_tiers: int = 7
    block_size: int = 4096
    restart_interval: int = 16
    bloom_bits_per_key: int = 10
    flush_rows: int = 250
    write_buffer_bytes: int = 4 << 20
    max_key_bytes: int = 4 << 10
    max_value_bytes: int = 1 << 20
    max_batch_bytes: int = 8 << 20
    #: Tables of file metadata are broadcast only up to this many rows.
    broadcast_files: int = 100_000


DEFAULT = Options()
