"""Token ids as sorted-string-table shards: documents keyed by identifier, found by binary search.

A shard holds one range of identifiers:

* data blocks of about BLOCK bytes, each entry ``shared, unshared, size`` as varints, then the key's
  unshared bytes and the ids; a block starts with a whole key and is compressed by itself;
* the Bloom filter of its keys;
* the sparse index, one line for each block: its last key, place, stored size;
* a footer of fixed size that tells where those are.

Keys order as bytes as the identifiers order as numbers, nulls first. Documents are range partitioned by
identifier, so a task writes one shard, streaming; a manifest row for each written shard is kept as a
table, which names only the files of attempts that succeeded.

Defined results. Null and empty texts have the end id alone. Rows that repeat an identifier are all kept,
in order of their text. An empty table has no shards and no rows. Other input columns are not carried.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import encoder, shared_dir, slices, stored, strings

BLOCK = 1 << 16
BITS_A_KEY, HASHES = 10, 7
MAGIC = b"SSTIDS01"
FOOTER = struct.Struct("<QQQQQQB8s")  # index place, size; filter place, size; documents, ids; id bytes; magic
ENTRY = struct.Struct("<QI")
MANIFEST = "shard long, path string, first_id long, last_id long, n_docs long, n_tokens long, n_bytes long"


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(block: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = block[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def _bits(hashes: np.ndarray, size: int) -> np.ndarray:
    """The filter's bits of each key, a row for each of HASHES."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return (hashes[None, :] + np.arange(HASHES, dtype=np.uint64)[:, None] * step[None, :]) % np.uint64(size)


class Writer:
    """Streams entries in key order into one shard."""

    def __init__(self, out, wide: bool):
        self.out, self.wide, self.place = out, wide, 0
        self.block, self.last = bytearray(), b""
        self.index: list[bytes] = []
        self.hashes: list[int] = []
        self.n_tokens = 0
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        value = ids.astype("<u4" if self.wide else "<u2").tobytes()
        shared = 0
        if self.block:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.hashes.append(xxhash.xxh3_64_intdigest(key))
        self.n_tokens += len(ids)
        if len(self.block) >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.block:
            data = self.pack.compress(bytes(self.block))
            self.out.write(data)
            self.index.append(_varint(len(self.last)) + self.last + ENTRY.pack(self.place, len(data)))
            self.place += len(data)
            self.block = bytearray()

    def close(self) -> int:
        self.flush()
        size = max(64, BITS_A_KEY * len(self.hashes))
        flags = np.zeros(size, np.uint8)
        flags[_bits(np.array(self.hashes, np.uint64), size).ravel().astype(np.int64)] = 1
        bloom = np.packbits(flags).tobytes()
        index = b"".join(self.index)
        self.out.write(bloom + index + FOOTER.pack(self.place + len(bloom), len(index), self.place, size, len(self.hashes), self.n_tokens, 4 if self.wide else 2, MAGIC))
        return self.place + len(bloom) + len(index) + FOOTER.size


class Reader:
    """Reads one shard: ``get`` finds a key's entries, iteration gives all in order. ``file`` can seek."""

    def __init__(self, file, size: int):
        self.file = file
        where, length, bloom, self.bits, self.n_docs, self.n_tokens, width, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        self.kind = "<u4" if width == 4 else "<u2"
        self.filter = np.unpackbits(np.frombuffer(self._at(bloom, where - bloom), np.uint8))
        self.last_keys, self.blocks = [], []
        index, at = self._at(where, length), 0
        while at < length:
            n, at = _read_varint(index, at)
            self.last_keys.append(index[at : at + n])
            self.blocks.append(ENTRY.unpack_from(index, at + n))
            at += n + ENTRY.size
        self.unpack = zstandard.ZstdDecompressor()

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def entries(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        block, at, key = self.unpack.decompress(self._at(*self.blocks[k])), 0, b""
        while at < len(block):
            shared, at = _read_varint(block, at)
            unshared, at = _read_varint(block, at)
            size, at = _read_varint(block, at)
            key = key[:shared] + block[at : at + unshared]
            at += unshared
            yield key, np.frombuffer(block, self.kind, size // int(self.kind[-1]), at)
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.blocks)):
            yield from self.entries(k)

    def maybe(self, key: bytes) -> bool:
        return bool(self.filter[_bits(np.array([xxhash.xxh3_64_intdigest(key)], np.uint64), self.bits).astype(np.int64)].all())

    def get(self, key: bytes) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        if self.maybe(key):
            for k in range(bisect_left(self.last_keys, key), len(self.blocks)):
                out += [ids for x, ids in self.entries(k) if x == key]
                if self.last_keys[k] > key:
                    break
        return out


def open_shard(path: str) -> Reader:
    fs, inner = pafs.FileSystem.from_uri(path)
    return Reader(fs.open_input_file(inner), fs.get_file_info(inner).size)


def write(docs: DataFrame, tokenizer: str, end_id: int = 0, at: str | None = None) -> DataFrame:
    """Write ``docs`` (doc_id, text) as shards under ``at``; returns the manifest."""
    at = at or shared_dir(docs.sparkSession)

    def shard(batches):
        encode = encoder(tokenizer)
        wide = max(encode.tokenizer.get_vocab_size(), end_id + 1) > 1 << 16
        fs, folder = pafs.FileSystem.from_uri(at)
        fs.create_dir(folder, recursive=True)
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}.sst"
        writer = first = last = None
        end = np.array([end_id], "<u4")
        n = 0
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), strings(batch.column(1))):
                if writer is None:
                    out = fs.open_output_stream(f"{folder}/{name}")
                    writer, first = Writer(out, wide), doc_id
                writer.add(key_of(doc_id), np.concatenate([np.frombuffer(encode.encode(text), "<u4"), end]))
                last, n = doc_id, n + 1
        if writer:
            size = writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"shard": task.partitionId(), "path": f"{at}/{name}", "first_id": first, "last_id": last, "n_docs": n, "n_tokens": writer.n_tokens, "n_bytes": size}])

    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(dealt.mapInArrow(shard, MANIFEST), f"{at}/manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Every document of the shards, in place: doc_id, start, ids (little-endian unsigned 32-bit)."""
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    shards = manifest.select("path", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("base"))

    def documents(batches):
        for batch in batches:
            for path, start in zip(*(x.to_pylist() for x in batch.columns)):
                rows, held = [], 0
                for key, ids in open_shard(path):
                    rows.append((id_of(key), start, ids.astype("<u4").tobytes()))
                    start += len(ids)
                    held += len(ids)
                    if held > 1 << 21 or len(rows) == 2000:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return shards.repartition(max(1, manifest.count())).mapInArrow(documents, "doc_id long, start long, ids binary")


def _batch(rows) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["doc_id", "start", "ids"])


#: Shards whose bounds (24 bytes each) every task of a lookup may hold.
SHARDS = 2_000_000


def lookup(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """Ids of the documents that ``keys`` (doc_id) names, by Bloom filter and binary search in each key's shard.

    A key's shard is found by binary search in the shards' bounds; equal identifiers lie in one shard.
    """
    if manifest.count() > SHARDS:
        raise ValueError(f"more than {SHARDS} shards: write larger ones")
    least = F.lit(-(1 << 63))  # a shard may begin with rows without an identifier
    bounds = manifest.select(F.coalesce("first_id", least).alias("first"), F.coalesce("last_id", least).alias("last"), "shard").orderBy("first", "last").toPandas()
    held = manifest.sparkSession.sparkContext.broadcast([bounds[c].to_numpy(np.int64) for c in ("first", "last", "shard")])

    def placed(batches):
        first, last, shard = held.value
        for batch in batches:
            ids = batch.column(0).drop_null().to_numpy()
            at = np.searchsorted(first, ids, "right") - 1
            inside = (at >= 0) & (ids <= last[at]) if len(first) else np.zeros(len(ids), bool)
            yield pa.RecordBatch.from_arrays([pa.array(shard[at[inside]]), pa.array(ids[inside])], ["shard", "doc_id"])

    at = keys.select(F.col("doc_id").cast("long")).distinct().mapInArrow(placed, "shard long, doc_id long").join(manifest.select(F.col("shard").cast("long"), "path"), "shard")
    sorted_keys = at.select("path", "doc_id").repartition("path", F.pmod("doc_id", F.lit(64))).sortWithinPartitions("path", "doc_id")

    def found(batches):
        path = reader = None
        for batch in batches:
            rows = []
            for p, doc_id in zip(*(x.to_pylist() for x in batch.columns)):
                if p != path:
                    path, reader = p, open_shard(p)
                rows += [(doc_id, None, ids.astype("<u4").tobytes()) for ids in reader.get(key_of(doc_id))]
            if rows:
                yield _batch(rows).select(["doc_id", "ids"])

    return sorted_keys.mapInArrow(found, "doc_id long, ids binary")


__all__ = ["Reader", "Writer", "lookup", "open_shard", "read", "write"]
