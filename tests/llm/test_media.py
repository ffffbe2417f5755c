"""Progressive JPEG: exact round trips, the general decoder, and the inverse transform against its definition."""

import hashlib
import zlib

import numpy as np
import pytest

from palimpsest.llm import media

from odd import ODD


@pytest.fixture(scope="module")
def payloads():
    rng = np.random.default_rng(1)
    return [media.padded(rng.integers(0, 256, n, dtype=np.uint8).tobytes()) for n in (0, 1, 575, 576, 577, 1500, 5000, 40_000)]


def test_round_trip_by_both_decoders(payloads):
    files = media.encode_payloads(payloads)
    seen = set()
    for places, coefficients, _, _ in media.read_files(files):
        for i, c, data in zip(places, coefficients, media.payload_of(coefficients)):
            seen.add(i)
            assert data.tobytes()[: media.payload_length(files[i])] == payloads[i]
            if len(payloads[i]) < 10_000:
                general = np.concatenate([x.reshape(-1, 64) for x in media.decode_coefficients(media.Layout(files[i]))])
                assert (general == c).all()
    assert seen == set(range(len(payloads)))


def test_another_writers_tables_take_the_general_path(payloads):
    """The same image with a longer Huffman code for the first AC scans."""
    file = media.encode_payloads([payloads[3]])[0]
    old = media._huffman(1, 0, [media._FIRST_SIZE], 1)
    layout = media.Layout(file)
    words = []
    for s, (parts, lo, hi, before, left, data, *_) in enumerate(layout.scans):
        if lo and not before:
            cols, rows = layout.width // 16, layout.height // 16
            part = media._parts(cols * rows)[parts[0][0] - 1]
            n = (part.stop - part.start) * (hi - lo + 1)
            raw = media._unpack7(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)[None], n)[0]
            bits = np.unpackbits(raw[:, None], axis=1)[:, 2:]  # six value bits of each
            bits = np.concatenate([np.zeros((n, 2), np.uint8), bits], axis=1).ravel()
            data2 = media._padded_bits(bits[None])[0].tobytes().replace(b"\xff", b"\xff\x00")
            words.append((data, data2))
    for a, b in words:
        assert file.count(a) >= 1
        file = file.replace(a, b, 1)
    file = file.replace(old, media._huffman(1, 0, [media._FIRST_SIZE, 0], 2), 1)
    assert media._uniform(media.Layout(file)) is None
    (_, c, _, _), = media.read_files([file])
    assert media.payload_of(c)[0].tobytes()[: len(payloads[3])] == payloads[3]


def test_inverse_transform(payloads):
    (_, c, cols, rows), = media.read_files(media.encode_payloads([payloads[4]]))
    k = np.arange(8)
    basis = np.cos((2 * k[:, None] + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(0.5), 1) / 2
    natural = np.zeros((6 * cols * rows, 64))
    natural[:, media.zigzag()] = c[0]
    samples = np.clip(np.floor(basis @ natural.reshape(-1, 8, 8) @ basis.T + 128.5), 0, 255)
    y = samples[: 4 * cols * rows].reshape(2 * rows, 2 * cols, 8, 8).transpose(0, 2, 1, 3).reshape(16 * rows, 16 * cols)
    cb, cr = (samples[s].reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * cols).repeat(2, 0).repeat(2, 1) - 128 for s in media._parts(cols * rows)[1:])
    want = np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1), 0, 255)
    got = media.rgb(c, cols, rows)[0]
    assert got.shape == want.shape and np.abs(got - want).max() <= 4


def test_zigzag():
    assert media.zigzag()[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(media.zigzag()) == list(range(64))


@pytest.mark.parametrize("blocks", [1, 9, 18, 5000, 10**6])
def test_geometry_fits(blocks):
    cols, rows = media.geometry(blocks)
    assert 6 * cols * rows >= blocks and 16 * rows < 65536 and 16 * cols < 65536


def test_documents(make):
    rows = list(enumerate(ODD)) + [(3, "twice"), (3, "twice"), (None, "null id")]
    got = media.read_media(media.to_media(make(rows))).collect()
    want = {}
    for i, t in rows:
        data = (t or "").encode()
        p = data + b"\xff" * (-len(data) % 576 if data else 576)
        want.setdefault(i, set()).add((len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) in want[r.doc_id]
        assert len(r.rgb) == 3 * r.height * r.width and hashlib.sha256(bytes(r.payload)).hexdigest() == r.payload_sha256
    assert len({(r.media_sha256, bytes(r.rgb)) for r in got if r.doc_id == 3 and r.n_bytes == 5}) == 1
    assert media.read_media(media.to_media(make(rows).limit(0))).count() == 0


def test_stored_media_and_tensors(spark, make, tmp_path):
    """Features come from the files: a damaged file is noticed, and the query leaves only its result."""
    rows = list(enumerate(ODD)) + [(3, "twice"), (3, "twice"), (None, "null id")]
    tensors = media.store_media(make(rows), f"file://{tmp_path}/m")
    got = {(r.doc_id, r.n_bytes): r for r in media.features(tensors).collect()}
    stored = spark.read.parquet(f"file://{tmp_path}/m/media").collect()
    assert len(stored) == len(rows) == tensors.count()
    for r in stored:
        data = bytes(r.media)
        (_, coefficients, cols, high), = media.read_files([data])
        tensor = media.rgb(coefficients, cols, high)[0]
        row = got[r.doc_id, r.n_bytes]
        assert row.feature == media._feature(tensor) and row.media_sha256 == hashlib.sha256(data).hexdigest()
    assert media.features(media.store_media(make(rows).limit(0), f"file://{tmp_path}/n")).count() == 0
    docs = tmp_path / "sf" / "documents.parquet"
    make(rows).write.parquet(f"file://{docs}")
    out = media.op9_media(spark, f"file://{tmp_path}/sf").collect()
    assert sorted((repr(r.doc_id), r.feature, r.payload_sha256) for r in out) == sorted((repr(r.doc_id), r.feature, r.payload_sha256) for r in media.features(tensors).collect())
