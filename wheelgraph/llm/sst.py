"""Token ids in sorted-string-table shards.

A shard holds documents by ascending id. Entries share key prefixes within a
block (whole keys restart every `RESTART` entries); a sparse index names each
block's last key; a Bloom filter answers most absent ids; the footer locates
both. A lookup reads the footer, index and filter, binary-searches the index and
scans one block.

    file   := block* index bloom footer
    entry  := varint(shared) varint(rest) varint(value bytes) key-rest value
    block  := entry* crc32
    index  := (varint(key) key u64(offset) u32(length) u32(entries))*
    bloom  := bits, `PROBES` probes by double hashing
    footer := <QQQQQQBB4s  index offset, length, bloom offset, length, entries, ids, bytes an id, version, magic

Keys are the id's 8 bytes, big-endian with the sign flipped, so byte order is
number order; a null id has the empty key and comes first. Rows that share an
id stay separate entries, ordered by the hash of their texts. Null text counts as
empty and yields the end id alone.

Texts move once, in a range shuffle by id. Shards are published by a rename, so a
repeated task leaves whole files. Only shard totals are summed in one place.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import arrow_limits, open_fs, publish, shared_folder, small_rows, table, written
from ._tokens import encoder

BLOCK_BYTES = 1 << 16
SHARD_BYTES = 32 << 20
RESTART = 16
PROBES = 7
BITS_A_KEY = 10
FOOTER = struct.Struct("<QQQQQQBB4s")
MAGIC = b"wgST"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * (b | 1)) % bits for i in range(PROBES)]


class Writer:
    """add() entries by ascending key, then finish(); `out` is a binary stream."""

    def __init__(self, out, width: int = 2):
        self.out, self.width, self.offset, self.entries, self.ids = out, width, 0, 0, 0
        self.block, self.held, self.last, self.index, self.keys = [], 0, b"", [], []
        self.in_block = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.in_block % RESTART:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        value = ids.astype(f"<u{self.width}").tobytes()
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.block += [entry, value]
        self.held += len(entry) + len(value)
        self.in_block += 1
        self.entries += 1
        self.ids += len(ids)
        self.last = key
        self.keys.append(key)
        if self.held >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.in_block:
            body = b"".join(self.block)
            body += struct.pack("<I", zlib.crc32(body))
            self.out.write(body)
            self.index.append(_varint(len(self.last)) + self.last + struct.pack("<QII", self.offset, len(body), self.in_block))
            self.offset += len(body)
            self.block, self.held, self.in_block = [], 0, 0

    def finish(self) -> None:
        self._flush()
        bits = max(64, (len(self.keys) * BITS_A_KEY + 7) // 8 * 8)
        bloom = bytearray(bits // 8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index = b"".join(self.index)
        self.out.write(index + bytes(bloom))
        self.out.write(FOOTER.pack(self.offset, len(index), self.offset + len(index), len(bloom), self.entries, self.ids, self.width, 1, MAGIC))


class Reader:
    """Random access to a shard; `f` is a seekable binary file."""

    def __init__(self, f):
        self.f = f
        size = f.size() if hasattr(f, "size") and callable(f.size) else f.seek(0, 2)
        at, length, b_at, b_length, self.entries, self.ids, self.width, _, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        self.bloom, raw, i = self._at(b_at, b_length), self._at(at, length), 0
        self.last, self.blocks = [], []
        while i < len(raw):
            n, i = _read_varint(raw, i)
            self.last.append(raw[i : i + n])
            self.blocks.append(struct.unpack_from("<QII", raw, i + n))
            i += n + 16

    def _at(self, offset: int, length: int) -> bytes:
        self.f.seek(offset)
        return self.f.read(length)

    def block(self, i: int):
        offset, length, entries = self.blocks[i]
        raw = self._at(offset, length)
        if zlib.crc32(memoryview(raw)[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError(f"block {i} is damaged")
        at, key = 0, b""
        for _ in range(entries):
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            n, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, np.frombuffer(raw, f"<u{self.width}", n // self.width, at)
            at += n

    def __iter__(self):
        for i in range(len(self.blocks)):
            yield from self.block(i)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry with this key, by Bloom filter, index search and block scan."""
        key, out = key_of(doc_id), []
        bits = len(self.bloom) * 8
        if all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, bits)):
            i = bisect.bisect_left(self.last, key)
            while i < len(self.blocks):
                out += [v for k, v in self.block(i) if k == key]
                if self.last[i] != key:
                    break
                i += 1
        return out


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode `docs` (doc_id, text) into shards under `folder`; the manifest: part, nth, path, entries, ids, in id order by (part, nth)."""
    arrow_limits(docs.sparkSession)

    def write(batches):
        coder, part = encoder(tokenizer, words=False), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        filesystem, root = open_fs(folder)
        filesystem.create_dir(root, recursive=True)
        held, size, nth = [], 0, 0

        def close():
            path = f"{root}/part-{part:06d}-{nth:05d}.sst"
            total = sum(len(x) for _, x in held) // 4

            def fill(out):
                w = Writer(out, 2 if coder.library.get_vocab_size() <= 1 << 16 else 4)
                for key, ids in held:
                    w.add(key, np.frombuffer(ids, "<u4"))
                w.finish()

            publish(filesystem, path, fill)
            return pa.RecordBatch.from_pylist([{"part": part, "nth": nth, "path": path, "entries": len(held), "ids": total}])

        for b in batches:
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                held.append((key_of(doc_id), coder.ids(text or "") + end))
                size += len(held[-1][1])
                if size >= shard_bytes:
                    yield close()
                    held, size, nth = [], 0, nth + 1
        if held:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the number divides equal rows, whose order doesn't matter
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("row")]
    return written(rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order[:2]).select("doc_id", "text").mapInArrow(write, "part long, nth long, path string, entries long, ids long"), "sst-manifest")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per entry, read back from the files: doc_id, start (ids of all entries before it), n_tokens, ids_crc32."""
    # one small row per shard: the running sum needs no more than the manifest
    starts = manifest.withColumn("start", F.coalesce(F.sum("ids").over(Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def read(batches):
        filesystem, _ = open_fs(folder)
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for b in batches:
            for path, start in zip(b["path"].to_pylist(), b["start"].to_pylist(), strict=True):
                rows = []
                with filesystem.open_input_file(path) as f:
                    for key, ids in Reader(f):
                        rows.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    return small_rows(starts.select("path", "start"), "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_sst(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_folder(spark, "sst")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_shards(write_shards(docs, folder, public_tokenizers.path("byte_bpe_50k.json")), folder)
