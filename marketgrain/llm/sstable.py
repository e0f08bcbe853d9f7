"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of their identifier. Layout, all numbers little-endian:

* data blocks, each zstd-compressed: entries of shared key bytes (u8), own key bytes (u8), value bytes (u32), the own
  key bytes, the value (token ids of 2 or 4 bytes);
* the sparse index: for each block its last key (u8 length first), offset (u64), stored bytes (u32), raw bytes (u32);
* a Bloom filter over identifiers: bits (u64), hashes (u8), bit bytes;
* the footer: offsets and sizes of index and filter (4 u64), documents (u64), tokens (u64), id bytes (u8), 8 magic bytes.

A key is one byte (0: null identifier, 1: another), the identifier as big-endian offset binary, and the number of
earlier documents of the shard with that identifier (u32, big-endian), so a shard's keys are unique and sort as
identifiers do, nulls first. Shards are ranges of identifier and text hash: an identifier of very many rows goes on in the
next shards.

Nulls and edges: a null text has the end token only; repeated rows stay apart, in an order of their own; texts of any
length are one entry (of less than 4 GB); an id that needs more bytes than a shard gives it is an error; an empty table
makes no shard; columns besides id and text are ignored. Files of failed task attempts are never listed in
the manifest, so a lost executor leaves no trace in what is read.
"""

from __future__ import annotations

import struct
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketgrain.llm.encode import encode
from marketgrain.llm.shared import file_system, fresh_path, written

MAGIC = b"MGSSTB01"
FOOTER = struct.Struct("<6QB8s")
BLOCK_BYTES = 1 << 16
#: Bytes of text that make up a shard.
SHARD_BYTES = 32 << 20
#: Shards aren't more than about so many: beyond, they are larger. They are written and read as streams.
MOST_SHARDS = 20_000
BLOOM_BITS_PER_KEY = 10
BLOOM_HASHES = 7
MANIFEST_SCHEMA = "path string, shard long, first_id long, last_id long, n_docs long, n_tokens long"


def make_key(doc_id: int | None, nth: int = 0) -> bytes:
    return struct.pack(">BQI", doc_id is not None, 0 if doc_id is None else (doc_id + 2**63), nth)


def key_id(key: bytes) -> int | None:
    some, number, _ = struct.unpack(">BQI", key)
    return number - 2**63 if some else None


def _bloom_places(ids: np.ndarray, bits: int) -> np.ndarray:
    """For each identifier (as unsigned 64 bit) its BLOOM_HASHES bit numbers."""
    from marketgrain.llm.textarrays import mix

    a, b = mix(ids ^ np.uint64(0x51ED270B7A14F2E3)), mix(ids + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(BLOOM_HASHES, dtype=np.uint64)) % np.uint64(bits)


class ShardWriter:
    def __init__(self, stream, id_bytes: int):
        import zstandard

        self.stream, self.id_bytes = stream, id_bytes
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self.at, self.n_docs, self.n_tokens = 0, 0, 0
        self.block, self.block_bytes, self.last = [], 0, b""
        self.index, self.ids = [], []
        self.first_id = self.last_id = None

    def add(self, doc_id: int | None, nth: int, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> 8 * self.id_bytes:
            raise ValueError(f"token id {ids.max()} doesn't fit in {self.id_bytes} bytes")
        key, value = make_key(doc_id, nth), ids.astype(f"<u{self.id_bytes}").tobytes()
        shared = 0
        if self.block:
            shared = next((i for i, (x, y) in enumerate(zip(key, self.last)) if x != y), len(key))
        self.block += [struct.pack("<BBI", shared, len(key) - shared, len(value)), key[shared:], value]
        self.block_bytes += 6 + len(key) - shared + len(value)
        self.last = key
        if self.n_docs == 0:
            self.first_id = doc_id
        self.last_id = doc_id
        self.n_docs += 1
        self.n_tokens += len(ids)
        self.ids.append(0 if doc_id is None else doc_id + 2**63)
        if self.block_bytes >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            raw = b"".join(self.block)
            stored = self.pack(raw)
            self.stream.write(stored)
            self.index.append(struct.pack("<B", len(self.last)) + self.last + struct.pack("<QII", self.at, len(stored), len(raw)))
            self.at += len(stored)
            self.block, self.block_bytes = [], 0

    def close(self) -> None:
        self._flush()
        index = b"".join(self.index)
        bits = max(64, BLOOM_BITS_PER_KEY * self.n_docs)
        filled = np.zeros(bits, bool)
        if self.ids:
            filled[_bloom_places(np.array(self.ids, np.uint64), bits).ravel()] = True
        bloom = struct.pack("<QB", bits, BLOOM_HASHES) + np.packbits(filled, bitorder="little").tobytes()
        self.stream.write(index + bloom)
        self.stream.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.n_docs, self.n_tokens, self.id_bytes, MAGIC))
        self.stream.close()


class Shard:
    """A shard file opened for reading: whole scans, or single documents by Bloom filter, index and binary search."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        footer = self._at(size - FOOTER.size, FOOTER.size)
        index_at, index_n, bloom_at, bloom_n, self.n_docs, self.n_tokens, self.id_bytes, magic = FOOTER.unpack(footer)
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        raw, self.last_keys, self.blocks, i = self._at(index_at, index_n), [], [], 0
        while i < len(raw):
            n = raw[i]
            self.last_keys.append(raw[i + 1 : i + 1 + n])
            self.blocks.append(struct.unpack_from("<QII", raw, i + 1 + n))
            i += 1 + n + 16
        bloom = self._at(bloom_at, bloom_n)
        (self.bits, _), self.bloom = struct.unpack_from("<QB", bloom), np.frombuffer(bloom, np.uint8, offset=9)

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        import zstandard

        at, stored, size = self.blocks[block]
        raw, i, key = zstandard.ZstdDecompressor().decompress(self._at(at, stored), max_output_size=size), 0, b""
        while i < len(raw):
            shared, own, value = struct.unpack_from("<BBI", raw, i)
            i += 6
            key = key[:shared] + raw[i : i + own]
            i += own
            yield key, np.frombuffer(raw, f"<u{self.id_bytes}", value // self.id_bytes, i)
            i += value

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.blocks)):
            yield from self.entries(k)

    def may_hold(self, doc_id: int | None) -> bool:
        places = _bloom_places(np.array([0 if doc_id is None else doc_id + 2**63], np.uint64), self.bits)[0]
        return all(self.bloom[int(p) >> 3] >> (int(p) & 7) & 1 for p in places)

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of the first document with this identifier, or None."""
        key = make_key(doc_id)
        k = bisect_left(self.last_keys, key)
        if k == len(self.blocks) or not self.may_hold(doc_id):
            return None
        return next((ids for found, ids in self.entries(k) if found == key), None)


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_bytes: int = 2, folder: str | None = None, id_column: str = "doc_id", text_column: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode every text, append ``end_id``, write shards below ``folder`` and return their manifest, itself written.

    ``id_bytes`` is 2 where every id is below 65,536 and 4 otherwise (a greater id raises). Manifest: path, shard (its rank), first_id,
    last_id, n_docs, n_tokens.
    """
    folder = folder or fresh_path(docs.sparkSession, "shards")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, writer, path, last, nth = TaskContext.get().partitionId(), None, None, None, 0
        for batch in batches:
            if batch.num_rows and writer is None:
                path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.sst"
                fs, inner = file_system(path)
                fs.create_dir(inner.rpartition("/")[0], recursive=True)
                writer = ShardWriter(fs.open_output_stream(inner, compression=None), id_bytes)
            ids, offsets = encode(batch.column(1), tokenizer_path)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                nth = nth + 1 if writer.n_docs and doc_id == last else 0
                writer.add(doc_id, nth, np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id)))
                last = doc_id
        if writer is not None:
            writer.close()
            row = {"path": path, "shard": shard, "first_id": writer.first_id, "last_id": writer.last_id, "n_docs": writer.n_docs, "n_tokens": writer.n_tokens}
            types = {"path": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array([v], types.get(k, pa.int64())) for k, v in row.items()], list(row))

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shard_bytes = max(shard_bytes, -(-size // MOST_SHARDS))
    order = [F.col("doc_id"), F.xxhash64("text").alias("tie")]
    ranged = rows.repartitionByRange(max(1, -(-size // shard_bytes)), *order).sortWithinPartitions(*order)
    return written(ranged.mapInArrow(write, MANIFEST_SCHEMA), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every document of the shards: doc_id, start (ids of all documents before it), ids (little-endian u32 bytes)."""
    # one row a shard: the running sum over shards fits one task
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    listed = manifest.select("path", F.coalesce(before, F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard, at = Shard(path), base
                for k in range(len(shard.blocks)):
                    keys, starts, values = [], [], []
                    for key, ids in shard.entries(k):
                        keys.append(key_id(key))
                        starts.append(at)
                        values.append(ids.astype("<u4").tobytes())
                        at += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(values, pa.binary())], ["doc_id", "start", "ids"])

    return listed.repartition(max(1, manifest.count()), "path").mapInArrow(read, "doc_id long, start long, ids binary")


def lookup(manifest: DataFrame, keys: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The ids of the first document under each identifier asked for, null among them: doc_id, ids (null where no shard has it).

    The manifest, one row a shard, is broadcast as sorted bounds; each identifier finds its shard there by binary search, and
    a shard is read by the tasks that hold its identifiers.
    """
    wanted = keys.select(F.col(id_column).cast("long").alias("doc_id")).distinct()
    shards = manifest.orderBy("shard").select("path", "first_id", "last_id").collect()
    # a bound is one place before all numbers for null, so that it sorts first
    lasts = [(-1, 0) if r["last_id"] is None else (0, r["last_id"]) for r in shards]
    firsts = [(-1, 0) if r["first_id"] is None else (0, r["first_id"]) for r in shards]
    sent = manifest.sparkSession.sparkContext.broadcast(([r["path"] for r in shards], firsts, lasts))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, firsts, lasts = sent.value
        for batch in batches:
            found = []
            for doc_id in batch.column(0).to_pylist():
                key = (-1, 0) if doc_id is None else (0, doc_id)
                k = bisect_left(lasts, key)
                found.append(paths[k] if k < len(paths) and firsts[k] <= key else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "path"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, shard = None, None
        for batch in batches:
            ids, values = batch.column(0).to_pylist(), []
            for doc_id, at in zip(ids, batch.column(1).to_pylist()):
                if at != path:
                    path, shard = at, Shard(at) if at else None
                got = shard.get(doc_id) if shard else None
                values.append(None if got is None else got.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary())], ["doc_id", "ids"])

    placed = wanted.mapInArrow(place, "doc_id long, path string")
    # absent identifiers have no path: they are dealt by themselves
    return placed.repartition(F.coalesce("path", F.col("doc_id").cast("string"))).sortWithinPartitions("path").mapInArrow(read, "doc_id long, ids binary")
