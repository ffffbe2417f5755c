"""The cached encoder, the token store and packing against the library."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from palimpsest.llm import packing, token_store
from palimpsest.llm.common import new_path
from palimpsest.llm.tokens import Encoder, ids_from, id_bytes, tokenizer_path

from odd import ODD

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


def odd_texts():
    rng = random.Random(3)
    letters = "ab é,.!'\n \t1_ß 日<|endoftext|>"
    fixed = ["  ", "a\n", "\na", "a  b", "a \n b", "don't 's it's we'll", "x　 y", "a\r\nb c", "<|endoftext|> hi", "a.b c'd e''f 12 34.5", "é x ́y", "İ ẞ ΑΣ Σ", "end. ", "﻿abc", "a\x00 a\x00b"]
    return [*ODD, *fixed, *("".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(800))]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_the_library(path):
    texts = odd_texts()
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    small, whole = Encoder(path, most_chunks=500), pa.array(texts, pa.string())
    for at in range(0, len(texts), 150):
        ids, off = small.encode(whole.slice(at, 150))
        for k in range(len(off) - 1):
            assert ids[off[k] : off[k + 1]].tolist() == want[at + k], texts[at + k]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_store_round_trip(spark, make):
    rng = random.Random(8)
    passage = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 99)) for _ in range(1500))
    rows = list(enumerate([*ODD, passage, "before it " + passage, passage + " after it", passage]))
    rows += [(3, "the same id, another text"), (20, "twice"), (20, "twice")]
    store = token_store.TokenStore.write(make(rows), new_path(spark, "test-store"), WORD)
    t = Tokenizer.from_file(WORD)
    ids = {(i, x): t.encode(x or "", add_special_tokens=False).ids + [1] for i, x in rows}
    back = [(r.doc_id, tuple(r.ids)) for r in store.documents().collect()]
    assert sorted(back) == sorted((i, tuple(ids[i, x])) for i, x in rows)
    checks = sorted(store.checks().collect(), key=lambda r: r.start)
    assert [r.doc_id for r in checks] == sorted(i for i, _ in rows)
    at = 0
    for r in checks:
        assert r.start == at
        at += r.n_tokens
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in checks) == sorted((i, len(ids[i, x]), crc(ids[i, x])) for i, x in rows)
    chunks = store.chunks().collect()
    assert len({bytes(r.key) for r in chunks}) == len(chunks)
    assert sum(len(ids_from(bytes(r.payload))) for r in chunks) < 0.7 * at  # passages are stored once
    assert store.manifest().agg({"tokens": "sum"}).first()[0] == at


def test_store_notices_damage(spark, make, monkeypatch):
    store = token_store.TokenStore.write(make([(1, "some words here")]), new_path(spark, "test-store"), WORD)
    with pytest.raises(ValueError, match="damaged"):
        token_store._verified(hashlib.sha256(b"other").digest(), bytes(store.chunks().first().payload))
    key = bytes(store.chunks().first().key)
    with pytest.raises(ValueError, match="missing"):
        token_store._verified(key, None)


def test_store_of_nothing(spark, make):
    store = token_store.TokenStore.write(make([(1, "x")]).limit(0), new_path(spark, "test-store"), WORD)
    assert store.checks().count() == 0 and store.documents().count() == 0


def test_null_ids_in_the_store(spark, make):
    store = token_store.TokenStore.write(make([(None, "b"), (-4, "a"), (0, None)]), new_path(spark, "test-store"), WORD)
    assert [r.doc_id for r in sorted(store.checks().collect(), key=lambda r: r.start)] == [None, -4, 0]


@pytest.mark.parametrize("sizes", [(0,), (1,), (5, 0, 4), (300, 64, 2049, 4)])
def test_crc_of_joined_parts(sizes):
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in sizes]
    whole = 0
    for p in parts:
        whole = token_store.crc32_joined(whole, zlib.crc32(p), len(p))
    assert whole == zlib.crc32(b"".join(parts))


def test_chunks_depend_on_content_only():
    rng = np.random.default_rng(2)
    body = rng.integers(0, 50000, 6000).astype(np.uint32)
    moved = np.concatenate([rng.integers(0, 50000, 333).astype(np.uint32), body])

    def cut(ids):
        ends = token_store.cut_points(ids, np.array([0, len(ids)]))[0]
        return {tuple(ids[a:b]) for a, b in zip([0, *ends[:-1]], ends)}

    assert len(cut(body) & cut(moved)) >= len(cut(body)) - 3
    ends = token_store.cut_points(np.zeros(5000, np.uint32), np.array([0, 5000]))[0]
    assert ends[-1] == 5000 and max(np.diff([0, *ends])) <= token_store.MOST


def test_pieces_cover_every_id_once(spark, make):
    rows = list(enumerate([*ODD, *("w" + str(k) + " text" * k for k in range(60))])) + [(7, "again"), (7, "again"), (None, "null id")]
    got = packing.pack(make(rows), BYTE).collect()
    t = Tokenizer.from_file(BYTE)
    want = sorted((repr(i), tuple(t.encode(x or "", add_special_tokens=False).ids + [0])) for i, x in rows)
    by: dict = {}
    for r in got:
        assert 0 < r.length == len(ids_from(bytes(r.ids))) and r.ids_crc32 == crc(ids_from(bytes(r.ids)))
        by.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    rebuilt = []
    for (i, n), pieces in by.items():
        pieces.sort(key=lambda r: r.start)
        streams = [[p for p in pieces if p.start == 0]]
        texts = [list(ids_from(bytes(p.ids))) for p in streams[0]]
        for p in pieces:
            if p.start:
                k = next(j for j, x in enumerate(texts) if len(x) == p.start)
                texts[k] += list(ids_from(bytes(p.ids)))
        rebuilt += [(repr(i), tuple(int(v) for v in x)) for x in texts]
        assert all(len(x) == n for x in texts)
    assert sorted(rebuilt) == want
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0  # no padding at all
    assert packing.pack(make(rows).limit(0), BYTE).count() == 0


def test_hilbert_neighbours():
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = packing.hilbert_keys((cells + 0.5) / 8, levels=3)
    assert sorted(keys) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_id_bytes():
    for ids in ([], [0], [65535], [65536, 1]):
        assert ids_from(id_bytes(np.array(ids, np.uint32))).tolist() == ids
