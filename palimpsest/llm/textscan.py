"""Words and lines of many texts at once, as numpy arrays over one byte buffer."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from .common import binary_values

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


@lru_cache(maxsize=1)
def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased byte (A-Z only), and whether a byte belongs to a word: letters, digits, all non-ASCII bytes."""
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    word = np.zeros(256, bool)
    for part in ((48, 58), (65, 91), (97, 123), (128, 256)):
        word[slice(*part)] = True
    return low, word


@lru_cache(maxsize=1)
def visible_table() -> np.ndarray:
    """Words as runs of anything but space and x09 to x0D."""
    word = np.ones(256, bool)
    word[[32, *range(9, 14)]] = False
    return word


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i <= n; kept up to 8 Mi entries."""
    if len(_powers[0]) > n:
        return _powers[0], _powers[1]
    size = max(n + 1, 1 << 20)
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    out = []
    for factor in (_BASE, inverse):
        steps = np.full(size, factor, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps))
    if size <= 8 << 20:
        _powers[:] = out
    return out[0], out[1]


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


class Scan:
    """Words are runs of the bytes marked in is_word, letters and digits by default.

    buf: bytes of all texts in a row; off: their n+1 offsets; starts, ends: places of words; doc: text of each word;
    word_off: n+1 offsets of the texts' words."""

    def __init__(self, texts: pa.Array, is_word: np.ndarray | None = None):
        self.buf, self.off = binary_values(texts)
        low, letters = letter_tables()
        is_word = letters if is_word is None else is_word
        n = len(self.buf)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = is_word[self.buf]
        begin = inside[1:-1] & ~inside[:-2]
        finish = inside[1:-1] & ~inside[2:]
        cuts = self.off[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        begin[cuts] |= inside[1:-1][cuts]
        finish[cuts - 1] |= inside[1:-1][cuts - 1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        self.word_off = np.searchsorted(self.starts, self.off)
        self.doc = np.repeat(np.arange(len(self.off) - 1), np.diff(self.word_off))
        self.lowered = low[self.buf]

    def hashes(self, *most_bytes: int) -> list[np.ndarray]:
        """A hash of each lower-cased word, and of its first bytes for each number of most_bytes."""
        power, inverse = _power_tables(len(self.buf))
        with np.errstate(over="ignore"):
            sums = np.zeros(len(self.buf) + 1, np.uint64)
            np.cumsum((self.lowered.astype(np.uint64) + np.uint64(1)) * power[: len(self.buf)], out=sums[1:])
            at, scale = sums[self.starts], inverse[self.starts]
            ends = [self.ends, *(np.minimum(self.ends, self.starts + m) for m in most_bytes)]
            return [mixed((sums[e] - at) * scale) for e in ends]
