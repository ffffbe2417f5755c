"""Whole-text encoding with the tokenizers library, through a cache of text chunks.

The vocabularies here cut texts into pre-tokens with patterns that never join a visible character to white space that
follows it. So a text may be cut before white space, and the encodings of the chunks in a row are the encoding of the
whole. Most chunks repeat; each different one goes through the library once, many at a time: chunks of letters with
optional punctuation are encoded as one text, and the pieces are found by the vocabulary's mark of a word's begin or
end. Other chunks go through the library one by one, and texts with rarer white space whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import binary_values, text_array

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PUNCTUATION = r"!-&(-/:-@\[-`{-~"  # without the apostrophe, which may start a contraction
_CHUNK = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
_PART = re.compile(rf"[ \t\n\r]*[{_LETTERS}]+(?=[ \t\n\r{_PUNCTUATION}]|$)|[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
_SIMPLE = re.compile(rf"[ \n]?[{_LETTERS}]+([{_PUNCTUATION}]*)")
#: White space of Unicode besides space, tab, line feed and carriage return, with the separators that some engines add.
_RARE_SPACE = "[\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200f}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
_DOUBLE_SPACE = "[ \\t\\n\\r][ \\t\\n\\r]|[\\t\\r]|[ \\n]$"


_SPACED = np.arange(256, dtype=np.uint8)
_SPACED[[9, 10, 13]] = 32
_SPACED_LOW = _SPACED.copy()
_SPACED_LOW[65:91] += 32


_TOGETHER = 384  # chunks in a text: larger ones take the library longer for each chunk


def short_keys(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(chunks, 2) words: up to 15 bytes, zeros, and the length as the last byte."""
    size = np.diff(off)
    padded = np.concatenate([buf, np.zeros(16, np.uint8)])
    eights = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(padded) - 7, 8), (1, 1))
    out = np.empty((len(size), 2), np.uint64)
    for half in (0, 1):
        word = eights[off[:-1] + 8 * half].view(np.uint64)[:, 0]
        kept = np.clip(size - 8 * half, 0, 8).astype(np.uint64) * np.uint64(8)
        full = kept == 64
        out[:, half] = np.where(full, word, word & ((np.uint64(1) << np.where(full, np.uint64(0), kept)) - np.uint64(1)))
    out[:, 1] |= size.astype(np.uint64) << np.uint64(56)
    return out


class _Table:
    """Chunks of up to 15 bytes to places, by open addressing over their exact bytes; whole arrays at a time."""

    def __init__(self, bits: int = 22):
        self.mask = np.uint64((1 << bits) - 1)
        self.where = np.full(1 << bits, -1, np.int32)
        self.key = np.zeros((1 << 16, 2), np.uint64)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (keys[:, 0] ^ (keys[:, 0] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + keys[:, 1]
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((h ^ (h >> np.uint64(31))) & self.mask).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            e = self.where[at]
            used = e >= 0
            left, at, e = left[used], at[used], e[used]
            same = (self.key[e] == keys[left]).all(axis=1)
            out[left[same]] = e[same]
            left, at = left[~same], (at[~same] + 1) & int(self.mask)
        return out

    def add(self, keys: np.ndarray, places: np.ndarray) -> None:
        """Different keys that the table doesn't hold."""
        while int(places.max(initial=0)) >= len(self.key):
            self.key = np.concatenate([self.key, np.zeros_like(self.key)])
        self.key[places] = keys
        left, at = places.astype(np.int32), self._home(keys)
        while len(left):
            free = self.where[at] < 0
            self.where[at[free]] = left[free]
            put = self.where[at] == left
            left, at = left[~put], (at[~put] + 1) & int(self.mask)


class Encoder:
    """Ids of whole texts, equal to encode(text, add_special_tokens=False).ids of the tokenizer file."""

    def __init__(self, path: str, most_chunks: int = 1_200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most_chunks = most_chunks
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(vocabulary.values()) + 1
        #: Ids that end a pre-token, where the vocabulary marks that; else ids that begin with a space or line feed.
        self.begins, self.ends = np.zeros(size, bool), np.zeros(size, bool)
        for token, i in vocabulary.items():
            self.begins[i] = token[0] in "ĠĊ"
            self.ends[i] = token.endswith("</w>")
        self.drops_space = bool(self.ends.any())
        self._reset()

    def _reset(self) -> None:
        self.table = _Table()
        self.others: dict[str, int] = {}  # long chunks, and first ones of texts
        self.flat = np.zeros(1 << 20, np.uint32)
        self.start, self.length = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int32)
        self.entries = self.used = 0

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _divided(self, ids: np.ndarray, pretokens: np.ndarray) -> np.ndarray | None:
        """Numbers of ids of simple chunks that were encoded as one text, or None if the marks don't add up."""
        if self.drops_space:
            marks = np.flatnonzero(self.ends[ids]) + 1
            if len(marks) != pretokens.sum():
                return None
            return np.diff(np.concatenate([[0], marks[np.cumsum(pretokens) - 1]]))
        marks = np.flatnonzero(self.begins[ids])
        return np.diff(np.append(marks, len(ids))) if len(marks) == len(pretokens) and marks[0] == 0 else None

    def _append(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """New entries with these ids in a row; their places."""
        k, n = self.entries, len(sizes)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while k + n > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[k : k + n] = self.used + np.cumsum(sizes) - sizes
        self.length[k : k + n] = sizes
        self.used += len(ids)
        self.entries += n
        return np.arange(k, k + n)

    def _learn(self, chunks: list[str]) -> np.ndarray:
        """Entries for different chunks, by the library."""
        out = np.empty(len(chunks), np.int64)
        match = _SIMPLE.fullmatch
        tails, plain, rest = [], [], []
        for i, c in enumerate(chunks):
            if (m := match(c)) and (self.drops_space or c[0] in " \n"):
                plain.append(i)
                tails.append(2 if m[1] else 1)
            else:
                rest.append(i)
        pretokens = np.array(tails, np.int64)
        groups = range(0, len(plain), _TOGETHER)
        between = " " if self.drops_space else ""
        texts = [between.join([chunks[i] for i in plain[at : at + _TOGETHER]]) for at in groups]
        for at, ids in zip(groups, self._library(texts)):
            part, ids = plain[at : at + _TOGETHER], np.array(ids, np.uint32)
            sizes = self._divided(ids, pretokens[at : at + _TOGETHER])
            if sizes is None:
                rest += part
            else:
                out[part] = self._append(ids, sizes)
        if rest:
            split = [_PART.findall(chunks[i]) for i in rest]
            new = list(dict.fromkeys(p for parts in split for p in parts))
            ids = dict(zip(new, self._library(new)))
            lists = [[i for p in parts for i in ids[p]] for parts in split]
            sizes = np.array([len(x) for x in lists], np.int64)
            out[rest] = self._append(np.array([i for x in lists for i in x], np.uint32), sizes)
        return out

    def _others_at(self, chunks: list[str]) -> np.ndarray:
        get = self.others.get
        found = np.fromiter((get(c, -1) for c in chunks), np.int64, len(chunks))
        if (missing := np.flatnonzero(found < 0)).size:
            new = list(dict.fromkeys(chunks[i] for i in missing))
            self.others.update(zip(new, self._learn(new).tolist()))
            found[missing] = [self.others[chunks[i]] for i in missing]
        return found

    def _entries_of(self, words: pa.Array) -> np.ndarray:
        """Entries of different words, each with its space before it (if the vocabulary keeps it and the word doesn't
        begin with a line feed)."""
        buf, off = binary_values(words)
        short = np.diff(off) <= 15
        out = np.full(len(words), -1, np.int64)
        keys = short_keys(buf, off)
        out[short] = self.table.find(keys[short])

        def chunks(places: np.ndarray) -> list[str]:
            texts = words.take(pa.array(places)).to_pylist()
            return texts if self.drops_space else [w if w[:1] == "\n" else f" {w}" for w in texts]

        if (missing := np.flatnonzero((out < 0) & short)).size:
            out[missing] = self._learn(chunks(missing))
            self.table.add(keys[missing], out[missing])
        if (long := np.flatnonzero(~short)).size:
            out[long] = self._others_at(chunks(long))
        return out

    def _gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.length[entries].astype(np.int64)
        ends = np.cumsum(n)
        at = np.repeat(self.start[entries] - (ends - n), n)
        at += np.arange(len(at))
        return self.flat[at], np.concatenate([[0], ends])

    def words(self, words: pa.Array, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words[where] in a row, each encoded alone with a space before it, and their offsets. The words differ."""
        self._trim()
        if not len(where):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        return self._gather(self._entries_of(words)[where])

    def _trim(self) -> None:
        if self.entries > self.most_chunks or self.used > 8 * self.most_chunks or len(self.others) > self.most_chunks // 10:
            self._reset()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (uint32), and n+1 offsets of the texts in them. Nulls are empty texts."""
        texts = text_array(*binary_values(texts))
        self._trim()
        rare = np.asarray(pc.match_substring_regex(texts, _RARE_SPACE))
        if self.drops_space:
            plain = ~rare
        else:
            plain = ~rare & ~np.asarray(pc.match_substring_regex(texts, _DOUBLE_SPACE))
        if plain.all():
            return self._plain(texts)
        pieces: list[np.ndarray | None] = [None] * len(texts)
        if plain.any():
            ids, off = self._plain(texts.filter(pa.array(plain)))
            for k, i in enumerate(np.flatnonzero(plain)):
                pieces[i] = ids[off[k] : off[k + 1]]
        for i in np.flatnonzero(~plain):
            text = texts[int(i)].as_py()
            if rare[i]:
                pieces[i] = np.array(self._library([text])[0], np.uint32)
            else:
                pieces[i] = self._gather(self._others_at(_CHUNK.findall(text)))[0]
        off = np.concatenate([[0], np.cumsum([len(x) for x in pieces])]).astype(np.int64)
        return np.concatenate(pieces), off

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts without rare white space and, where the vocabulary keeps white space, with single spaces and line
        feeds only, none at the end: each starts a chunk."""
        if self.drops_space:
            buf, off = binary_values(texts)
            # The vocabulary is lower case. A special token's name in capitals must not become one, though.
            special = bool(pc.any(pc.match_substring(texts, "<|")).as_py())
            texts = text_array((_SPACED if special else _SPACED_LOW)[buf], off)
        else:
            texts = pc.replace_substring(texts, "\n", " \n")
        lists = pc.split_pattern(texts, " ")
        bounds = np.asarray(lists.offsets)
        bounds = bounds - bounds[0]
        coded = lists.flatten().dictionary_encode()
        where = np.asarray(coded.indices).astype(np.int64)
        if not len(where):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        entries = self._entries_of(coded.dictionary)[where]
        if not self.drops_space:
            first = bounds[:-1]
            entries[first] = self._others_at(coded.dictionary.take(pa.array(where[first])).to_pylist())
        ids, off = self._gather(entries)
        return ids, off[bounds]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer file in a worker process."""
    return Encoder(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def id_bytes(ids: np.ndarray) -> bytes:
    """Ids as little-endian bytes, two for each if all fit, else four; the first byte says which."""
    narrow = not len(ids) or int(ids.max()) < 1 << 16
    return (b"\x02" + ids.astype("<u2").tobytes()) if narrow else (b"\x04" + ids.astype("<u4").tobytes())


def ids_from(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1).astype("<u4")
