"""Content-addressed store of token ids.

Layout of a store (all Parquet, in one folder that driver and executors share):

  blobs/kind=chunk/   key = SHA-256 of payload; payload = id bytes (width byte, then little-endian ids)
  blobs/kind=recipe/  as first written: key = record, payload = packed recipe, n = times that the record came
  recipes/            records in ascending doc_id order: part, local_start, n_tokens, copies, root, digests, sizes
  manifest/           one row for each part: first and last doc_id, records, tokens, Merkle root of the record roots

A rolling (gear) hash over the last 32 ids cuts an id stream where its top bits are zero, so equal passages give equal
chunks wherever they stand. Each different chunk is stored once, under its digest. A record's root is the Merkle root
of its chunk digests; a part's root is the Merkle root of its records' roots.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path, parts_for, sliced, table
from .tokens import encoder, id_bytes, ids_from, tokenizer_path

WINDOW = 32
LEAST, MOST = 64, 2048
CUT_BITS = 8
END_ID = 1
_SEEN_MOST = 200_000


@lru_cache(maxsize=1)
def _gear() -> np.ndarray:
    """A 64-bit value for each id, by the splitmix64 rule."""
    with np.errstate(over="ignore"):
        z = np.arange(1, (1 << 16) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def cut_points(ids: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Chunk ends of each stream ids[offsets[i]:offsets[i+1]], as places in ids. A chunk has LEAST to MOST ids, the
    last of a stream may be shorter. The window never reaches before a chunk's stream, as LEAST > WINDOW."""
    h = _gear()[ids & 0xFFFF]
    with np.errstate(over="ignore"):
        for step in (1, 2, 4, 8, 16):
            wide = h.copy()
            wide[step:] += h[:-step] << np.uint64(step)
            h = wide
    hits = np.flatnonzero(h >> np.uint64(64 - CUT_BITS) == 0) + 1
    out = []
    for a, b in zip(offsets[:-1], offsets[1:]):
        ends, at = [], a
        for hit in hits[np.searchsorted(hits, a, "right") : np.searchsorted(hits, b, "left")]:
            while hit - at > MOST:
                at += MOST
                ends.append(at)
            if hit - at >= LEAST:
                at = hit
                ends.append(at)
        while b - at > MOST:
            at += MOST
            ends.append(at)
        if b > at:
            ends.append(b)
        out.append(np.array(ends, np.int64))
    return out


def merkle_root(leaves: list[bytes]) -> bytes:
    """SHA-256 Merkle root with separated leaf and node prefixes; an odd last node moves up unchanged."""
    level = [hashlib.sha256(b"\x00" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        up = [hashlib.sha256(b"\x01" + a + b).digest() for a, b in zip(level[::2], level[1::2])]
        level = up + ([level[-1]] if len(level) % 2 else [])
    return level[0]


_RECIPE = "<?q"
_RECIPE_BYTES = struct.calcsize(_RECIPE)


def _blobs(path: str, end_id: int | None):
    """Batches of texts to blobs of both kinds. A task sends each chunk once, as long as its memory of digests holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        enc = encoder(path)
        for batch in sliced(batches, "text", 2 << 20):
            ids, off = enc.encode(batch.column("text"))
            if end_id is not None:
                ids = np.insert(ids, off[1:], end_id)
                off = off + np.arange(len(off))
            keys, payloads, kinds = [], [], []
            for doc_id, a, ends in zip(batch.column("doc_id").to_pylist(), off[:-1], cut_points(ids, off)):
                digests, sizes = [], []
                for b in ends:
                    data = id_bytes(ids[a:b])
                    digest = hashlib.sha256(data).digest()
                    digests.append(digest)
                    sizes.append(b - a)
                    a = b
                    if digest not in seen:
                        if len(seen) >= _SEEN_MOST:
                            seen.clear()
                        seen.add(digest)
                        keys.append(digest)
                        payloads.append(data)
                        kinds.append("chunk")
                head = struct.pack(_RECIPE, doc_id is None, doc_id or 0)
                root = merkle_root(digests)
                keys.append(head + root)
                payloads.append(head + root + np.array(sizes, "<u4").tobytes() + b"".join(digests))
                kinds.append("recipe")
            yield pa.record_batch(
                [pa.array(kinds), pa.array(keys, pa.binary()), pa.array(payloads, pa.binary())],
                names=["kind", "key", "payload"],
            )

    return run


_RECORD = "doc_id bigint, copies bigint, n_tokens bigint, root binary, digests array<binary>, sizes array<bigint>"


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for payload, n in zip(batch.column("payload").to_pylist(), batch.column("n").to_pylist()):
            null, doc_id = struct.unpack_from(_RECIPE, payload)
            at, rest = _RECIPE_BYTES + 32, len(payload) - _RECIPE_BYTES - 32
            k = rest // 36
            sizes = np.frombuffer(payload, "<u4", k, at).astype(np.int64)
            digests = [payload[at + 4 * k + 32 * i : at + 4 * k + 32 * (i + 1)] for i in range(k)]
            root = payload[_RECIPE_BYTES : at]
            rows.append((None if null else doc_id, n, int(sizes.sum()), root, digests, sizes.tolist()))
        cols = list(zip(*rows)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
        yield pa.record_batch(
            [pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in _RECORD.split(", ")]
        )


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds part and local_start, the ids of the part before the record."""
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        taken = np.asarray(batch.column("n_tokens")) * np.asarray(batch.column("copies"))
        start = before + np.cumsum(taken) - taken
        before += int(taken.sum())
        yield pa.record_batch(
            [pa.array(np.full(batch.num_rows, part, np.int64)), pa.array(start), *batch.columns],
            names=["part", "local_start", *batch.schema.names],
        )


def _manifest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each part that the task reads; parts come whole and in order."""
    parts: dict[int, list] = {}
    for batch in batches:
        for part, doc_id, copies, n, root in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "copies", "n_tokens", "root"))):
            p = parts.setdefault(part, [doc_id, doc_id, 0, 0, []])
            p[1], p[2], p[3] = doc_id, p[2] + copies, p[3] + n * copies
            p[4].append(root)
    rows = [(k, a, b, c, d, merkle_root(roots)) for k, (a, b, c, d, roots) in parts.items()]
    names = ["part", "first_doc", "last_doc", "records", "tokens", "merkle_root"]
    cols = list(zip(*rows)) or [()] * 6
    yield pa.record_batch([pa.array(c, pa.binary() if n == "merkle_root" else pa.int64()) for c, n in zip(cols, names)], names=names)


@dataclass(frozen=True)
class TokenStore:
    """A store's folder; write() makes one, the other methods only read its files."""

    spark: SparkSession
    path: str

    @classmethod
    def write(cls, docs: DataFrame, path: str, tokenizer: str, end_id: int | None = END_ID) -> TokenStore:
        """Encode every text of docs (null: empty) and store the ids.

        Reads doc_id and text only. Repeated rows are one record with a count; rows that share a doc_id and differ in
        text are separate records, in order of their roots; null ids come first. Long texts are stored whole, in chunks; an
        empty table makes a store without records.
        """
        spark = docs.sparkSession
        ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        blobs = ids.mapInArrow(_blobs(tokenizer, end_id), "kind string, key binary, payload binary")
        once = blobs.groupBy("kind", "key").agg(F.first("payload").alias("payload"), F.count("*").alias("n"))
        once.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/blobs")
        schema = "key binary, payload binary, n bigint, kind string"
        raw = spark.read.schema(schema).parquet(f"{path}/blobs").where("kind = 'recipe'").select("payload", "n")
        records = raw.mapInArrow(_unpack, _RECORD)
        parts = parts_for(spark, f"{path}/blobs")  # so a part's roots fit a task however many records there are
        ordered = records.repartitionByRange(parts, "doc_id", "root").sortWithinPartitions("doc_id", "root")
        ordered.mapInArrow(_placed, f"part bigint, local_start bigint, {_RECORD}").write.option("compression", "zstd").parquet(f"{path}/recipes")
        # Each part is one file here, or several read in order by one task after a regrouping by part.
        heads = cls(spark, path).recipes().select("part", "local_start", "doc_id", "copies", "n_tokens", "root")
        by_part = heads.repartition(parts, "part").sortWithinPartitions("part", "local_start", "doc_id", "root")
        kinds = "part bigint, first_doc bigint, last_doc bigint, records bigint, tokens bigint, merkle_root binary"
        by_part.mapInArrow(_manifest_rows, kinds).write.parquet(f"{path}/manifest")
        return cls(spark, path)

    def chunks(self) -> DataFrame:
        schema = "key binary, payload binary, n bigint, kind string"
        return self.spark.read.schema(schema).parquet(f"{self.path}/blobs").where("kind = 'chunk'").select("key", "payload")

    def recipes(self) -> DataFrame:
        return self.spark.read.schema(f"part bigint, local_start bigint, {_RECORD}").parquet(f"{self.path}/recipes")

    def manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/manifest")

    def part_starts(self) -> DataFrame:
        """(part, part_start): ids of all parts before a part. One row for each part, so bounded by the partitions."""
        rows = sorted((r["part"], r["tokens"]) for r in self.manifest().select("part", "tokens").collect())
        starts, at = [], 0
        for part, n in rows:
            starts.append((part, at))
            at += n
        return self.spark.createDataFrame(starts, "part bigint, part_start bigint")

    def documents(self) -> DataFrame:
        """(doc_id, root, ids array<bigint>) for every record, rebuilt from the stored chunks; raises if a chunk's
        bytes don't have its digest or a root doesn't fit."""
        lines = self.recipes().select("doc_id", "root", "copies", F.posexplode_outer("digests").alias("pos", "key"))
        joined = lines.join(self.chunks(), "key", "left")
        whole = joined.groupBy("doc_id", "root", "copies").agg(
            F.array_sort(F.collect_list(F.struct("pos", "key", "payload"))).alias("chunks")
        )
        plain = whole.select("doc_id", "root", "copies", F.col("chunks.key").alias("keys"), F.col("chunks.payload").alias("payloads"))
        ids = plain.mapInArrow(_rebuild, "doc_id bigint, root binary, copies bigint, ids array<bigint>")
        return ids.select("doc_id", "root", "ids", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")

    def checks(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32) for every record, from the files. Every chunk is read, compared with
        its digest and summed once; a record's checksum is the CRC combination of its chunks' in recipe order."""
        sums = materialize(self.chunks().mapInArrow(_chunk_sums, "key binary, crc bigint, size bigint"), "store-sums")
        recipes = self.recipes()
        unique = recipes.groupBy("root").agg(F.first("digests").alias("digests"))
        lines = materialize(unique.select("root", F.posexplode_outer("digests").alias("pos", "key")), "store-lines")
        summed = lines.join(sums, "key", "left").groupBy("root").agg(
            F.array_sort(F.collect_list(F.struct("pos", "key", "crc", "size"))).alias("c")
        )
        flat = summed.select("root", F.col("c.key").alias("keys"), F.col("c.crc").alias("crcs"), F.col("c.size").alias("sizes"))
        roots = materialize(flat.mapInArrow(_fold_sums, "root binary, ids_crc32 bigint, total bigint"), "store-roots")
        named = recipes.select("doc_id", "part", "local_start", "copies", "n_tokens", "root").join(roots, "root")
        starts = self.part_starts()
        placed = named.join(F.broadcast(starts), "part").select(
            "doc_id", "n_tokens", "ids_crc32", "total", (F.col("part_start") + F.col("local_start")).alias("at"),
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy"),
        )
        fits = F.assert_true(F.col("total") == F.col("n_tokens"), F.lit("a stored record doesn't add up"))
        return placed.where(fits.isNull()).select(
            "doc_id", (F.col("at") + F.col("copy") * F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32"
        )


def _verified(key: bytes, payload: bytes | None) -> np.ndarray:
    if payload is None or hashlib.sha256(payload).digest() != key:
        raise ValueError(f"chunk {key.hex()} is missing or damaged")
    return ids_from(payload)


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for root, keys, payloads in zip(*(batch.column(c).to_pylist() for c in ("root", "keys", "payloads"))):
            keys = [k for k in keys if k is not None]
            if merkle_root(keys) != root:
                raise ValueError(f"record {root.hex()} doesn't fit its chunks")
            out.append(np.concatenate([np.zeros(0, "<u4"), *(_verified(k, p) for k, p in zip(keys, payloads))]).astype(np.int64))
        cols = [batch.column("doc_id"), batch.column("root"), batch.column("copies"), pa.array(out, pa.list_(pa.int64()))]
        yield pa.record_batch(cols, names=["doc_id", "root", "copies", "ids"])


def _chunk_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column("key").to_pylist()
        ids = [_verified(k, p) for k, p in zip(keys, batch.column("payload").to_pylist())]
        crcs = pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())
        yield pa.record_batch([pa.array(keys, pa.binary()), crcs, pa.array([len(x) for x in ids], pa.int64())], names=["key", "crc", "size"])


@lru_cache(maxsize=None)
def _zeros_operator(n_bytes: int) -> tuple[int, ...]:
    """Effect of n_bytes zero bytes on each bit of a CRC-32 register, as 32 columns."""
    if n_bytes == 1:
        step = []
        for bit in range(32):
            c = 1 << bit
            for _ in range(8):
                c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
            step.append(c)
        return tuple(step)
    half = _zeros_operator(n_bytes // 2)
    out = tuple(_apply(half, c) for c in half)
    return tuple(_apply(_zeros_operator(1), c) for c in out) if n_bytes % 2 else out


def _apply(columns: tuple[int, ...], crc: int) -> int:
    out = 0
    for column in columns:
        if crc & 1:
            out ^= column
        crc >>= 1
        if not crc:
            break
    return out


def crc32_joined(first: int, second: int, second_bytes: int) -> int:
    """CRC-32 of two byte strings in a row from theirs."""
    return _apply(_zeros_operator(second_bytes), first) ^ second if second_bytes else first


def _fold_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crcs, totals = [], []
        for root, keys, cs, sizes in zip(*(batch.column(c).to_pylist() for c in ("root", "keys", "crcs", "sizes"))):
            keys = [k for k in keys if k is not None]
            if merkle_root(keys) != root or None in cs[: len(keys)]:
                raise ValueError(f"record {root.hex()} doesn't fit its chunks")
            crc = 0
            for c, size in zip(cs[: len(keys)], sizes):
                crc = crc32_joined(crc, c, 4 * size)
            crcs.append(crc)
            totals.append(sum(sizes[: len(keys)]))
        cols = [batch.column("root"), pa.array(crcs, pa.int64()), pa.array(totals, pa.int64())]
        yield pa.record_batch(cols, names=["root", "ids_crc32", "total"])


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-store")
    store = TokenStore.write(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return store.checks()
