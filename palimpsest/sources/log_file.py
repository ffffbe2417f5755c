"""The log as bytes: batches in framed, checksummed records, one file a log, and a scan that stops at the first bad one.

A file begins with a magic and its log number. A record is CRC-32C, length and type, then the payload; the checksum also
covers the log number, so a record of another log or a hole of zeros never passes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encode import crc32c_of
from ..schemas import DELETION, VALUE

MAGIC = b"PALILOG\x01"
FILE_HEAD, RECORD_HEAD = "<8sQ", "<IIB"
FULL = 1
#: How a scan can end.
CLEAN, TORN_HEADER, ZERO_LENGTH, TORN_PAYLOAD, BAD_CRC = "clean end of file", "torn record header", "zero-length record", "torn record payload", "CRC mismatch"


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("a length is cut off")
        n |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 128:
            return n, at


def encode_batch(base_seq: int, ops: list[tuple[int, bytes, bytes | None]]) -> bytes:
    out = [struct.pack("<QI", base_seq, len(ops))]
    for kind, key, value in ops:
        out += [bytes([kind]), varint(len(key)), key]
        if kind == VALUE:
            out += [varint(len(value)), value]
    return b"".join(out)


def decode_batch(data: bytes) -> tuple[int, list[tuple[int, bytes, bytes | None]]]:
    if len(data) < 12:
        raise ValueError("a batch is shorter than its header")
    base, count = struct.unpack_from("<QI", data)
    ops, at = [], 12

    def part(at: int) -> tuple[bytes, int]:
        n, at = read_varint(data, at)
        if at + n > len(data):
            raise ValueError("a batch is cut off")
        return data[at : at + n], at + n

    while at < len(data):
        kind = data[at]
        if kind not in (DELETION, VALUE):
            raise ValueError("an operation of unknown type")
        key, at = part(at + 1)
        value = None
        if kind == VALUE:
            value, at = part(at)
        ops.append((kind, key, value))
    if len(ops) != count:
        raise ValueError("a batch has another number of operations than it says")
    return base, ops


def record_crc(log_no: int, kind: int, payload: bytes) -> int:
    return int(crc32c_of(pd.Series([struct.pack("<QIB", log_no, len(payload), kind) + payload]))[0])


def encode_log(log_no: int, payloads: list[bytes]) -> bytes:
    if log_no <= 0:
        raise ValueError("log numbers begin at 1")
    if not all(payloads):
        raise ValueError("a record can't be empty")
    heads = pd.Series([struct.pack("<QIB", log_no, len(p), FULL) + p for p in payloads], dtype=object)
    crcs = crc32c_of(heads) if len(heads) else []
    return struct.pack(FILE_HEAD, MAGIC, log_no) + b"".join(struct.pack(RECORD_HEAD, int(c), len(p), FULL) + p for c, p in zip(crcs, payloads))


def scan_log(data: bytes) -> tuple[int, list[bytes], str, int]:
    """(log number, payloads before the first bad record, why it ended, its offset)."""
    head = struct.calcsize(FILE_HEAD)
    if len(data) < head or data[:8] != MAGIC:
        raise ValueError("not a log")
    log_no = struct.unpack_from(FILE_HEAD, data)[1]
    found, at, why = [], head, CLEAN
    step = struct.calcsize(RECORD_HEAD)
    while at < len(data):
        if at + step > len(data):
            why = TORN_HEADER
            break
        crc, size, kind = struct.unpack_from(RECORD_HEAD, data, at)
        if size == 0:
            why = ZERO_LENGTH
            break
        if at + step + size > len(data):
            why = TORN_PAYLOAD
            break
        found.append((crc, kind, data[at + step : at + step + size], at))
        at += step + size
    crcs = crc32c_of(pd.Series([struct.pack("<QIB", log_no, len(p), k) + p for _, k, p, _ in found], dtype=object)) if found else []
    for i, (got, (crc, _, _, start)) in enumerate(zip(crcs, found)):
        if int(got) != crc:
            return log_no, [p for _, _, p, _ in found[:i]], BAD_CRC, start
    return log_no, [p for _, _, p, _ in found], why, at


def write_logs(records: DataFrame) -> DataFrame:
    """(log_no, content) of each log of records (log_no, rec_no, ok, ops). A log is bounded in size; a damaged record is
    written with its last byte changed. Numbers on disk begin at 1, so a log's is one more."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rec_no")
        log_no = int(pdf["log_no"].iloc[0])
        payloads = []
        for ops in pdf["ops"]:
            each = [(int(o["type"]), o["user_key"].encode(), None if o["value"] is None else o["value"].encode()) for o in ops]
            payloads.append(encode_batch(int(ops[0]["seq"]), each))
        data, at = bytearray(encode_log(log_no + 1, payloads)), struct.calcsize(FILE_HEAD)
        for ok, p in zip(pdf["ok"], payloads):
            at += struct.calcsize(RECORD_HEAD) + len(p)
            if not ok:
                data[at - 1] ^= 0xFF
        return pd.DataFrame({"log_no": [log_no], "content": [bytes(data)]})

    return records.select("log_no", "rec_no", "ok", "ops").groupBy("log_no").applyInPandas(run, "log_no bigint, content binary")


def scan_logs(files: DataFrame) -> DataFrame:
    """(log_no, payloads, stopped, good_offset) of each file (content), as spark.read.format("binaryFile") reads them."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [scan_log(bytes(c)) for c in pdf["content"]]
            yield pd.DataFrame(rows, columns=["log_no", "payloads", "stopped", "good_offset"]).assign(log_no=lambda x: x["log_no"] - 1)

    return files.select("content").mapInPandas(run, "log_no bigint, payloads array<binary>, stopped string, good_offset bigint")


def replayed(scanned: DataFrame) -> DataFrame:
    """(log_no, seq, type, user_key, value) of every operation that the scans let through."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for log_no, payload in zip(pdf["log_no"], pdf["payload"]):
                base, ops = decode_batch(bytes(payload))
                rows += [(log_no, base + i, kind, key.decode(), None if value is None else value.decode()) for i, (kind, key, value) in enumerate(ops)]
            yield pd.DataFrame(rows, columns=["log_no", "seq", "type", "user_key", "value"])

    records = scanned.select("log_no", F.explode("payloads").alias("payload"))
    return records.mapInPandas(run, "log_no bigint, seq bigint, type int, user_key string, value string")
