"""Media columns in progressive JPEG.

A payload is stored losslessly in the quantised DCT coefficients of a 4:2:0 progressive JPEG (all quantisers 1): each
64-byte block of the payload is one 8x8 block of the image, its first byte the DC coefficient, the others AC
coefficients in zigzag order with magnitudes of 128 to 255. The scan script uses both of the format's ways to spread a
coefficient over scans: DC bits come one scan each, AC coefficients in two spectral bands at Al=2 and then two
successive-approximation scans for each component.

Reading accumulates the scans of a file into coefficient arrays, recovers the payload from them, applies the inverse
DCT, upsamples chroma and yields the full-resolution RGB tensor. decode_coefficients() reads any progressive Huffman
file symbol by symbol. Files in which every symbol of a scan has the same length, as those made here, take a bulk path
that reads a whole scan of many equally large files at once, after it has checked each code word.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, new_path, sliced, table

PAD_TO = 576
PAD_BYTE = 255
MOST_RUN = 32767
MOST_MCUS = 4095
DC_BITS = 8
#: AC bands and the low bits left to refinement, of the first AC scans.
BANDS = ((1, 9), (10, 63))
AC_LOW = 2
_FIRST_SIZE = 6  # every AC coefficient shifted by AC_LOW lies in 32..63


@lru_cache(maxsize=1)
def zigzag() -> np.ndarray:
    """Natural index of each zigzag position."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


@lru_cache(maxsize=1)
def _inverse() -> np.ndarray:
    """Zigzag coefficients to samples, scaled by 2**13 and rounded: products and sums are exact in float64, so a block's
    samples don't depend on what is multiplied with it."""
    k = np.arange(8)
    basis = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(0.5), 1) / 2
    full = np.einsum("yv,xu->vuyx", basis, basis).reshape(64, 64)
    return np.round(full[zigzag()] * (1 << 13))


@lru_cache(maxsize=4096)
def geometry(blocks: int) -> tuple[int, int]:
    """MCU columns and rows (16x16 pixels, 6 blocks each) for at least so many blocks: least waste, then squarest."""
    need = max(1, -(-blocks // 6))
    least = -(-need // MOST_MCUS)
    most = max(least, min(int(need**0.5), 64))
    return min(((w, -(-need // w)) for w in range(least, most + 1)), key=lambda g: (g[0] * g[1], -g[0]))


@lru_cache(maxsize=64)
def _mcu_order(cols: int, rows: int) -> np.ndarray:
    """Places of blocks (all Y in raster order, then Cb, then Cr) in the order of interleaved scans."""
    n = cols * rows
    r, c = np.divmod(np.arange(n), cols)
    y = [(2 * r + i) * 2 * cols + 2 * c + j for i in (0, 1) for j in (0, 1)]
    return np.stack([*y, 4 * n + np.arange(n), 5 * n + np.arange(n)], axis=1).ravel()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(table_class: int, ident: int, symbols: list[int], length: int) -> bytes:
    """DHT segment with all symbols at one code length."""
    counts = [len(symbols) if k + 1 == length else 0 for k in range(16)]
    return _segment(0xC4, bytes([table_class << 4 | ident, *counts, *symbols]))


@lru_cache(maxsize=4096)
def _head(cols: int, rows: int) -> bytes:
    quant = _segment(0xDB, bytes([0]) + b"\x01" * 64)
    frame = struct.pack(">BHHB", 8, 16 * rows, 16 * cols, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    tables = _huffman(0, 0, [0], 1) + _huffman(1, 0, [_FIRST_SIZE], 1) + _huffman(1, 1, [r << 4 for r in range(15)], 4)
    jfif = _segment(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00")
    return b"\xff\xd8" + jfif + quant + _segment(0xC2, frame) + tables


def _scan_head(components: list[int], ac_table: int, low: int, high: int, before: int, left: int) -> bytes:
    body = bytes([len(components)]) + b"".join(bytes([c, ac_table]) for c in components)
    return _segment(0xDA, body + bytes([low, high, before << 4 | left]))


def _pack7(values: np.ndarray) -> np.ndarray:
    """Rows of 7-bit values to bytes, padded with ones."""
    n, k = values.shape
    full = np.full((n, -(-k // 8) * 8), 127, np.uint8)
    full[:, :k] = values
    eights = full.reshape(n, -1, 8).astype(np.uint64)
    word = np.zeros(eights.shape[:2], np.uint64)
    for i in range(8):
        word |= eights[:, :, i] << np.uint64(49 - 7 * i)
    return word.astype(">u8").view(np.uint8).reshape(n, -1, 8)[:, :, 1:].reshape(n, -1)[:, : -(-7 * k // 8)]


def _unpack7(data: np.ndarray, k: int) -> np.ndarray:
    n = len(data)
    full = np.zeros((n, -(-k // 8), 8), np.uint8)
    flat = np.zeros((n, full.shape[1] * 7), np.uint8)
    flat[:, : data.shape[1]] = data
    full[:, :, 1:] = flat.reshape(n, -1, 7)
    word = full.reshape(n, -1).view(">u8").astype(np.uint64)
    out = np.empty((n, full.shape[1], 8), np.uint8)
    for i in range(8):
        out[:, :, i] = (word >> np.uint64(49 - 7 * i)) & np.uint64(127)
    return out.reshape(n, -1)[:, :k]


@lru_cache(maxsize=1)
def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """AC coefficient of each payload byte, and its 7-bit first-scan code word (0, then six value bits)."""
    v = np.arange(256)
    coefficient = np.where(v < 128, -(v + 128), v)
    top = np.abs(coefficient) >> AC_LOW
    return coefficient.astype(np.int16), np.where(coefficient > 0, top, 63 - top).astype(np.uint8)


def _runs(blocks: int) -> list[int]:
    return [MOST_RUN] * (blocks // MOST_RUN) + ([blocks % MOST_RUN] if blocks % MOST_RUN else [])


def _run_bits(blocks: int) -> np.ndarray:
    """End-of-band run of so many blocks: a 4-bit code, then the bits below the run's highest."""
    r = blocks.bit_length() - 1
    return np.array([int(x) for x in f"{r:04b}" + (f"{blocks - (1 << r):0{r}b}" if r else "")], np.uint8)


def _padded_bits(bits: np.ndarray) -> np.ndarray:
    n, k = bits.shape
    if k % 8:
        bits = np.concatenate([bits, np.ones((n, 8 - k % 8), np.uint8)], axis=1)
    return np.packbits(bits, axis=1)


def _parts(n: int) -> list[slice]:
    """Blocks of Y, Cb and Cr for n MCUs."""
    return [slice(0, 4 * n), slice(4 * n, 5 * n), slice(5 * n, 6 * n)]


def script(cols: int, rows: int) -> list[tuple]:
    """The scans of a file: (components, first and last coefficient, Ah, Al)."""
    dc = [((1, 2, 3), 0, 0, 0, DC_BITS)] + [((1, 2, 3), 0, 0, a, a - 1) for a in range(DC_BITS, 0, -1)]
    first = [((c,), lo, hi, 0, AC_LOW) for c in (1, 2, 3) for lo, hi in BANDS]
    return dc + first + [((c,), 1, 63, a, a - 1) for c in (1, 2, 3) for a in range(AC_LOW, 0, -1)]


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A JPEG file for each payload (its length a multiple of 64)."""
    out: list[bytes] = [b""] * len(payloads)
    alike: dict[tuple[int, int], list[int]] = {}
    for i, p in enumerate(payloads):
        alike.setdefault(geometry(len(p) // 64), []).append(i)
    for (cols, rows), members in alike.items():
        n = cols * rows
        step = max(1, (4 << 20) // (384 * n))
        for at in range(0, len(members), step):
            part = members[at : at + step]
            data = np.full((len(part), 6 * n * 64), PAD_BYTE, np.uint8)
            for row, i in zip(data, part):
                row[: len(payloads[i])] = np.frombuffer(payloads[i], np.uint8)
            for i, body in zip(part, _entropy(data.reshape(len(part), 6 * n, 64), cols, rows)):
                note = _segment(0xFE, b"payload " + struct.pack(">Q", len(payloads[i])))
                out[i] = _head(cols, rows) + note + body + b"\xff\xd9"
    return out


def _entropy(data: np.ndarray, cols: int, rows: int) -> list[bytes]:
    n = cols * rows
    coefficient, first = _byte_tables()
    dc = data[:, _mcu_order(cols, rows), 0]
    size = np.abs(coefficient).astype(np.uint8)[data]
    scans = []
    for components, lo, hi, before, left in script(cols, rows):
        blocks = _parts(n)[components[0] - 1]
        if lo == 0:
            bits = np.zeros_like(dc) if not before else (dc >> left) & 1
            scans.append((_scan_head([*components], 0, 0, 0, before, left), _padded_bits(bits)))
        elif not before:
            values = first[data[:, blocks, lo : hi + 1]].reshape(len(data), -1)
            scans.append((_scan_head([*components], 0, lo, hi, before, left), _pack7(values)))
        else:
            bits = ((size[:, blocks, lo : hi + 1] >> left) & 1).reshape(len(data), -1)
            pieces, at = [], 0
            for run in _runs(blocks.stop - blocks.start):
                pieces += [np.tile(_run_bits(run), (len(data), 1)), bits[:, at : at + 63 * run]]
                at += 63 * run
            scans.append((_scan_head([*components], 1, lo, hi, before, left), _padded_bits(np.concatenate(pieces, axis=1))))
    files = []
    for k in range(len(data)):
        files.append(b"".join(x for head, body in scans for x in (head, body[k].tobytes().replace(b"\xff", b"\xff\x00"))))
    return files


_NEXT_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.DOTALL)


class Layout:
    """A parsed file: frame, tables as they stand at each scan, and entropy-coded bytes of the scans."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        self.comments: list[bytes] = []
        self.quant: dict[int, np.ndarray] = {}
        self.scans: list[tuple] = []
        self.components: list[tuple[int, int, int, int]] = []
        self.height = self.width = self.restart = 0
        tables: dict[tuple[int, int], bytes] = {}
        at = 2
        while True:
            marker = data[at + 1]
            if marker == 0xD9:
                break
            length = int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + length]
            at += 2 + length
            if marker == 0xFE:
                self.comments.append(body)
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int64)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    k = 17 + sum(body[1:17])
                    tables[body[0] >> 4, body[0] & 15] = body[1:k]
                    body = body[k:]
            elif marker == 0xDD:
                self.restart = int.from_bytes(body, "big")
            elif marker == 0xC2:
                _, self.height, self.width, k = struct.unpack(">BHHB", body[:6])
                self.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(k)]
            elif 0xC0 <= marker <= 0xCF and marker != 0xC8:
                raise ValueError("only progressive Huffman files are read")
            elif marker == 0xDA:
                k = body[0]
                parts = tuple((body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(k))
                lo, hi, approx = body[1 + 2 * k : 4 + 2 * k]
                end = _NEXT_MARKER.search(data, at)
                if not end:
                    raise ValueError("a scan doesn't end")
                self.scans.append((parts, lo, hi, approx >> 4, approx & 15, data[at : end.start()], dict(tables), self.restart))
                at = end.start()

    def blocks(self, index: int, interleaved: bool) -> tuple[int, int]:
        """Block columns and rows of a component: in its own scans, or padded to whole MCUs."""
        _, h, v, _ = self.components[index]
        most_h, most_v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        if interleaved:
            return -(-self.width // (8 * most_h)) * h, -(-self.height // (8 * most_v)) * v
        return -(-(-(-self.width * h // most_h)) // 8), -(-(-(-self.height * v // most_v)) // 8)


def _codes(spec: bytes) -> dict[tuple[int, int], int]:
    out, code, at = {}, 0, 16
    for length in range(1, 17):
        for _ in range(spec[length - 1]):
            out[length, code] = spec[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


class _Bits:
    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)).tolist()
        self.at = 0

    def one(self) -> int:
        self.at += 1
        return self.bits[self.at - 1] if self.at <= len(self.bits) else 1

    def take(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | self.one()
        return v

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.one()
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("no such code")

    def value(self, size: int) -> int:
        v = self.take(size)
        return v if size == 0 or v >> (size - 1) else v - (1 << size) + 1


def decode_coefficients(layout: Layout) -> list[np.ndarray]:
    """Coefficients of each component, (block rows, block columns, 64) in zigzag order, of any progressive file."""
    out = [np.zeros((*layout.blocks(i, True)[::-1], 64), np.int64) for i in range(len(layout.components))]
    places = {c[0]: i for i, c in enumerate(layout.components)}
    for parts, lo, hi, before, left, data, tables, restart in layout.scans:
        units: list[list[tuple[int, int, int]]] = []
        if len(parts) == 1:
            i = places[parts[0][0]]
            cols, rows = layout.blocks(i, False)
            units = [[(0, r, c)] for r in range(rows) for c in range(cols)]
        else:
            shape = [layout.components[places[p[0]]][1:3] for p in parts]
            cols, rows = (x // f for x, f in zip(layout.blocks(places[parts[0][0]], True), shape[0]))
            units = [
                [(k, r * v + y, c * h + x) for k, (h, v) in enumerate(shape) for y in range(v) for x in range(h)]
                for r in range(rows) for c in range(cols)
            ]
        streams = re.split(rb"\xff[\xd0-\xd7]", data) if restart else [data]
        step = restart or len(units)
        for s, stream in enumerate(streams):
            bits, last, run = _Bits(stream), [0] * len(parts), 0
            for unit in units[s * step : (s + 1) * step]:
                for k, r, c in unit:
                    block = out[places[parts[k][0]]][r, c]
                    if lo == 0:
                        if before:
                            block[0] |= bits.one() << left
                        else:
                            last[k] += bits.value(bits.symbol(_codes_of(tables[0, parts[k][1]])))
                            block[0] = last[k] << left
                    elif before:
                        run = _refine(block, bits, _codes_of(tables[1, parts[k][2]]), lo, hi, 1 << left, run)
                    else:
                        run = _first(block, bits, _codes_of(tables[1, parts[k][2]]), lo, hi, left, run)
    return out


@lru_cache(maxsize=64)
def _codes_of(spec: bytes) -> dict[tuple[int, int], int]:
    return _codes(spec)


def _first(block, bits: _Bits, codes, lo: int, hi: int, left: int, run: int) -> int:
    if run:
        return run - 1
    k = lo
    while k <= hi:
        zeros, size = divmod(bits.symbol(codes), 16)
        if size:
            k += zeros
            block[k] = bits.value(size) * (1 << left)
        elif zeros < 15:
            return (1 << zeros) + bits.take(zeros) - 1
        else:
            k += 15
        k += 1
    return 0


def _refine(block, bits: _Bits, codes, lo: int, hi: int, unit: int, run: int) -> int:
    def correct(k: int) -> None:
        if bits.one() and not abs(int(block[k])) & unit:
            block[k] += unit if block[k] > 0 else -unit

    k = lo
    if not run:
        while k <= hi:
            zeros, size = divmod(bits.symbol(codes), 16)
            new = (unit if bits.one() else -unit) if size else 0
            if not size and zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                break
            while k <= hi:
                if block[k]:
                    correct(k)
                elif zeros == 0:
                    break
                else:
                    zeros -= 1
                k += 1
            if new and k <= hi:
                block[k] = new
            k += 1
    if run:
        for j in range(k, hi + 1):
            if block[j]:
                correct(j)
        run -= 1
    return run


def _uniform(layout: Layout) -> tuple[int, int] | None:
    """MCU columns and rows if the file follows script() and its tables, so that _bulk can try it."""
    if [c[1:3] for c in layout.components] != [(2, 2), (1, 1), (1, 1)] or layout.height % 16 or layout.width % 16 or layout.restart:
        return None
    cols, rows = layout.width // 16, layout.height // 16
    said = [(tuple(p[0] for p in parts), lo, hi, a, b) for parts, lo, hi, a, b, *_ in layout.scans]
    first, more = bytes([1] + [0] * 15 + [_FIRST_SIZE]), bytes([0, 0, 0, 15] + [0] * 12 + [r << 4 for r in range(15)])
    dc = bytes([1] + [0] * 15 + [0])
    for parts, lo, _, before, _, _, tables, _ in layout.scans:
        for _, d, a in parts:
            if (tables.get((0, d)) != dc) if lo == 0 else (tables.get((1, a)) != (more if before else first)):
                return None
    return (cols, rows) if said == script(cols, rows) else None


def _bulk(layouts: list[Layout], cols: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (files, blocks, 64) of equally large files, and for which files every code word was as supposed."""
    n, files = cols * rows, len(layouts)
    out = np.zeros((files, 6 * n, 64), np.int16)
    fine = np.ones(files, bool)
    order = _mcu_order(cols, rows)
    sign = np.ones((files, 6 * n, 64), bool)
    for s, (components, lo, hi, before, left) in enumerate(script(cols, rows)):
        blocks = _parts(n)[components[0] - 1]
        count = blocks.stop - blocks.start
        width = hi - lo + 1
        runs = [(r, _run_bits(r)) for r in _runs(count)]
        if lo == 0:
            n_bits = 6 * n
        else:
            n_bits = sum(len(b) + 63 * r for r, b in runs) if before else 7 * count * width
        size = -(-n_bits // 8)
        raw = [x.scans[s][5].replace(b"\xff\x00", b"\xff") for x in layouts]
        fit = np.array([len(x) == size for x in raw])
        fine &= fit
        data = np.frombuffer(b"".join(x if ok else b"\x00" * size for x, ok in zip(raw, fit)), np.uint8).reshape(files, size)
        if lo == 0:
            bits = np.unpackbits(data, axis=1)[:, : 6 * n]
            if not before:
                fine &= ~bits.any(axis=1)
            else:
                out[:, order, 0] |= bits.astype(np.int16) << left
        elif not before:
            words = _unpack7(data, count * width)
            fine &= ~(words > 63).any(axis=1)
            words = words.reshape(files, count, width)
            up = words > 31
            sign[:, blocks, lo : hi + 1] = up
            out[:, blocks, lo : hi + 1] = np.where(up, words, 63 - words).astype(np.int16) << left
        else:
            bits, at, done = np.unpackbits(data, axis=1), 0, blocks.start
            for run, head in runs:
                fine &= (bits[:, at : at + len(head)] == head).all(axis=1)
                at += len(head)
                low = bits[:, at : at + 63 * run].reshape(files, run, 63)
                out[:, done : done + run, 1:] |= low.astype(np.int16) << left
                at, done = at + 63 * run, done + run
    np.negative(out, out=out, where=~sign)
    return out, fine


@lru_cache(maxsize=1)
def _colour_tables() -> tuple[np.ndarray, ...]:
    """What each chroma sample adds to red, green (of Cr, of Cb; in 1/65536) and blue."""
    c = np.arange(256) - 128
    red, blue = (91881 * c + 32768) >> 16, (116130 * c + 32768) >> 16
    return red.astype(np.int16), (-46802 * c).astype(np.int32), (-22554 * c + 32768).astype(np.int32), blue.astype(np.int16)


def rgb(coefficients: np.ndarray, cols: int, rows: int) -> np.ndarray:
    """(files, height, width, 3) uint8 tensors from zigzag coefficients (files, blocks, 64) with quantisers 1."""
    files, n = len(coefficients), cols * rows
    samples = coefficients.reshape(-1, 64).astype(np.float64) @ _inverse()
    samples = np.clip(np.floor(samples / (1 << 13) + 128.5), 0, 255).astype(np.uint8).reshape(files, 6 * n, 8, 8)

    def plane(part: slice, wide: int, high: int) -> np.ndarray:
        x = samples[:, part].reshape(files, high, wide, 8, 8)
        return x.transpose(0, 1, 3, 2, 4).reshape(files, high * 8, wide * 8)

    y, cb, cr = (plane(p, f * cols, f * rows) for p, f in zip(_parts(n), (2, 1, 1)))
    red, green_cr, green_cb, blue = _colour_tables()
    adds = (red[cr], ((green_cr[cr] + green_cb[cb]) >> 16).astype(np.int16), blue[cb])
    out = np.empty((*y.shape, 3), np.uint8)
    luma = y.astype(np.int16)
    for k, add in enumerate(adds):
        out[..., k] = np.clip(luma + add.repeat(2, axis=1).repeat(2, axis=2), 0, 255)
    return out


def read_files(files: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, int, int]]:
    """(places in files, coefficients, MCU columns, MCU rows) for groups of equally large files."""
    layouts = [Layout(x) for x in files]
    alike: dict[tuple[int, int], list[int]] = {}
    odd: list[int] = []
    for i, x in enumerate(layouts):
        if shape := _uniform(x):
            alike.setdefault(shape, []).append(i)
        else:
            odd.append(i)
    for (cols, rows), members in alike.items():
        step = max(1, (2 << 20) // (384 * cols * rows))
        for at in range(0, len(members), step):
            part = members[at : at + step]
            got, fine = _bulk([layouts[i] for i in part], cols, rows)
            odd += [i for i, ok in zip(part, fine) if not ok]
            if fine.all():
                yield part, got, cols, rows
            elif fine.any():
                yield [i for i, ok in zip(part, fine) if ok], got[fine], cols, rows
    for i in odd:
        x = layouts[i]
        if [c[1:3] for c in x.components] != [(2, 2), (1, 1), (1, 1)] or any((q != 1).any() for q in x.quant.values()):
            raise ValueError("a media column holds 4:2:0 files with quantisers 1")
        whole = np.concatenate([c.reshape(-1, 64) for c in decode_coefficients(x)])
        yield [i], whole[None].astype(np.int16), -(-x.width // 16), -(-x.height // 16)


def payload_length(file: bytes) -> int:
    at = file.index(b"payload ")
    return struct.unpack(">Q", file[at + 8 : at + 16])[0]


def payload_of(coefficients: np.ndarray) -> np.ndarray:
    """Payload bytes (files, bytes) back from coefficients: DC as it is, AC by sign and low seven bits."""
    c = coefficients
    out = np.where(c < 0, -c - 128, c).astype(np.uint8)
    out[:, :, 0] = c[:, :, 0].astype(np.uint8)
    return out.reshape(len(c), -1)


def padded(text: bytes) -> bytes:
    short = -len(text) % PAD_TO if text else PAD_TO
    return text + bytes([PAD_BYTE]) * short


def _encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text", 2 << 20):
        texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
        media = pa.array(encode_payloads([padded(x) for x in texts]), pa.large_binary())
        sizes = pa.array([len(x) for x in texts], pa.int64())
        yield pa.record_batch([batch.column("doc_id"), sizes, media.cast(pa.binary())], names=["doc_id", "n_bytes", "media"])


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every row's text as UTF-8 (null: empty), padded and stored as a progressive JPEG.
    Other columns are ignored; repeated rows give repeated results, equal texts equal files; a long text is one large file;
    an empty table gives an empty result."""
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ids.mapInArrow(_encode_batches, "doc_id bigint, n_bytes bigint, media binary")


def _feature(tensor: np.ndarray) -> str:
    h, w, _ = tensor.shape
    means = ",".join(f"{int(s) / (h * w):.3f}" for s in tensor.reshape(-1, 3).sum(axis=0, dtype=np.int64))
    return f"{h}x{w}x3 rgb mean {means} crc32 {zlib.crc32(tensor.tobytes()):08x}"


_READ = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string"
_TENSOR = "height bigint, width bigint, rgb binary"


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in f"{_READ}, {_TENSOR}, payload binary".split(", ")]
    for batch in sliced(batches, "media", 2 << 20):
        files = batch.column("media").to_pylist()
        rows: list[tuple] = [()] * len(files)
        for places, coefficients, cols, height in read_files(files):
            payloads, tensors = payload_of(coefficients), rgb(coefficients, cols, height)
            for i, payload, tensor in zip(places, payloads, tensors):
                data = payload.tobytes()[: payload_length(files[i])]
                digests = (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(files[i]), hashlib.sha256(files[i]).hexdigest())
                rows[i] = (*digests, tensor.shape[0], tensor.shape[1], tensor.tobytes(), data)
        yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c) for c in zip(*rows))], names=["doc_id", "n_bytes", *names])


def read_media(media: DataFrame) -> DataFrame:
    """Reads the bytes of a media column back: digests of payload and file, the tensor (height, width and rgb, row-major
    height x width x 3 bytes) and the payload. An empty table gives an empty result."""
    return media.mapInArrow(_read_batches, f"doc_id bigint, n_bytes bigint, {_READ}, {_TENSOR}, payload binary")


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "rgb", 4 << 20):
        shapes = zip(batch.column("height").to_pylist(), batch.column("width").to_pylist(), batch.column("rgb").to_pylist())
        features = [_feature(np.frombuffer(data, np.uint8).reshape(h, w, 3)) for h, w, data in shapes]
        kept = [i for i, n in enumerate(batch.schema.names) if n not in ("height", "width", "rgb")]
        yield pa.record_batch([*(batch.column(i) for i in kept), pa.array(features, pa.string())], names=[*(batch.schema.names[i] for i in kept), "feature"])


def features(tensors: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, digests, feature) of stored tensors, as store_media() writes them."""
    return tensors.mapInArrow(_feature_batches, f"doc_id bigint, n_bytes bigint, {_READ}, feature string")


def store_media(docs: DataFrame, path: str) -> DataFrame:
    """Writes the media column of docs to path/media, reads it back from there, and writes the tensors with the digests
    of what was read to path/tensors. Returns the stored tensors."""
    spark = docs.sparkSession
    to_media(docs).write.option("compression", "zstd").parquet(f"{path}/media")
    media = spark.read.schema("doc_id bigint, n_bytes bigint, media binary").parquet(f"{path}/media")
    read_media(media).drop("payload").write.option("compression", "zstd").parquet(f"{path}/tensors")
    return spark.read.schema(f"doc_id bigint, n_bytes bigint, {_READ}, {_TENSOR}").parquet(f"{path}/tensors")


SLICES = 8


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media and tensors are stored for one slice of the documents after another, by a hash of the text; a slice's files
    are deleted when its features, read from them, are stored. So they take the disk of one slice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = []
    for k in range(SLICES):
        path = new_path(spark, "media")
        mine = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SLICES)) == k)
        tensors = store_media(mine, path)
        tensors._stored_at = path  # noqa: SLF001
        done.append(materialize(features(tensors), "media-features"))
        discard(tensors)
    return spark.read.schema(done[0].schema).parquet(*(d._stored_at for d in done))  # noqa: SLF001
