"""Token ids in sorted-string-table shards.

A shard is one file: blocks, block index, Bloom filter, footer. Entries are documents in
ascending order of a key (8 bytes, the identifier with its sign bit turned; null is the
empty key and comes first). A block holds up to BLOCK_IDS ids: for each entry the length
of the prefix it shares with the key before, the rest of its key, and its number of ids
(all as varints), then all ids as 16- or 32-bit little-endian numbers. The index has a row
for each block (first key, place, size, ids before it), so a lookup asks the Bloom
filter, searches the index by halving, and reads one block (more where a key repeats).

    shard  := block* index bloom footer
    footer := index place u64, bloom place u64, entries u64, ids u64, blocks u32, crc32 u32 of index and bloom, magic 8 bytes

Rows are range-partitioned and sorted by key; each task encodes and writes one shard as it
reads, holding one block and eight bytes for each entry (for the Bloom filter), under a name of its
own attempt, and moves it into place when whole; a repeated task replaces the file with an
equal one. There are as many shards as the session has shuffle partitions, or more, so
that a shard has about SHARD_BYTES of text at most.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices, table
from .tokens import encoder

MAGIC = b"SVSSTAB1"
FOOTER = struct.Struct("<QQQQII8s")
INDEX = struct.Struct("<QIQ")
BLOCK_IDS, BLOOM_BITS, BLOOM_HASHES, SHARD_BYTES = 32_768, 10, 7, 512 << 20


def key_bytes(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))


def key_value(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at += 1
        if b < 128:
            return n, at
        shift += 7


def bloom_hashes(key: bytes) -> tuple[int, int]:
    return zlib.crc32(key), zlib.crc32(key, 0x9747B28C) | 1


def bloom_places(a, b, bits: int) -> list:
    """Places of keys by their two hashes, numbers or arrays."""
    return [(a + i * b + i * i) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Entries must come in ascending order of key."""

    def __init__(self, out):
        self.out, self.at = out, 0
        self.index: list[tuple[bytes, int, int, int]] = []
        self.hashes = array("I"), array("I")
        self.entries = self.ids = 0
        self._open()

    def _open(self):
        self.head, self.body, self.first, self.previous, self.count, self.held = bytearray(), [], b"", b"", 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key = key_bytes(doc_id)
        if not self.count:
            self.first = key
        shared = 0
        while shared < min(len(key), len(self.previous)) and key[shared] == self.previous[shared]:
            shared += 1
        self.head += varint(shared) + varint(len(key) - shared) + key[shared:] + varint(len(ids))
        self.body.append(ids)
        self.previous, self.count, self.held = key, self.count + 1, self.held + len(ids)
        for held, h in zip(self.hashes, bloom_hashes(key), strict=True):
            held.append(h)
        if self.held >= BLOCK_IDS:
            self._flush()

    def _flush(self):
        if not self.count:
            return
        ids = np.concatenate(self.body) if self.body else np.empty(0, np.uint32)
        width = 4 if len(ids) and ids.max() > 0xFFFF else 2
        data = struct.pack("<IIB", self.count, len(self.head), width) + bytes(self.head) + ids.astype(f"<u{width}").tobytes()
        self.index.append((self.first, self.at, len(data), self.ids))
        self.out.write(data)
        self.at += len(data)
        self.entries, self.ids = self.entries + self.count, self.ids + len(ids)
        self._open()

    def close(self) -> None:
        self._flush()
        index = b"".join(bytes([len(k)]) + k + INDEX.pack(place, size, before) for k, place, size, before in self.index)
        bits = max(64, self.entries * BLOOM_BITS)
        bloom = np.zeros(bits, dtype=bool)
        for at in bloom_places(*(np.array(h, dtype=np.int64) for h in self.hashes), bits):
            bloom[at] = True
        packed = struct.pack("<Q", bits) + np.packbits(bloom, bitorder="little").tobytes()
        self.out.write(index + packed + FOOTER.pack(self.at, self.at + len(index), self.entries, self.ids, len(self.index), zlib.crc32(index + packed), MAGIC))


class Shard:
    """Reads a shard file."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        place, bloom, self.entries, self.ids, blocks, check, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard file")
        tail = self._read(place, size - FOOTER.size - place)
        if zlib.crc32(tail) != check:
            raise ValueError("the index or the Bloom filter is damaged")
        at = 0
        self.index = []
        for _ in range(blocks):
            n = tail[at]
            self.index.append((tail[at + 1 : at + 1 + n], *INDEX.unpack_from(tail, at + 1 + n)))
            at += 1 + n + INDEX.size
        self.bits = struct.unpack_from("<Q", tail, bloom - place)[0]
        self.bloom = tail[bloom - place + 8 :]

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, place, size, _ = self.index[k]
        data = self._read(place, size)
        count, head, width = struct.unpack_from("<IIB", data)
        at, key, entries = 9, b"", []
        for _ in range(count):
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            n, at = read_varint(data, at + rest)
            entries.append((key, n))
        ids, at = np.frombuffer(data, dtype=f"<u{width}", offset=9 + head).astype("<u4"), 0
        for key, n in entries:
            yield key, ids[at : at + n]
            at += n

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.index)):
            for key, ids in self.block(k):
                yield key_value(key), ids

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of all entries with this identifier."""
        key = key_bytes(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in bloom_places(*bloom_hashes(key), self.bits)):
            return []
        low, high = 0, len(self.index)
        while low < high:  # the first block whose first key isn't below
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self.index[middle][0] < key else (low, middle)
        found = []
        for k in range(max(0, low - 1), len(self.index)):
            if self.index[k][0] > key:
                break
            found += [ids for at, ids in self.block(k) if at == key]
        return found


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shards: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write docs as shards below folder (a URI all executors reach); a row for each shard.

    Returns (shard, path, entries, ids, start): start counts the ids in the shards
    before. A null text is empty and gives the end id alone; a long text is one entry, in a
    block of its own. Rows with one key are kept, ordered by their texts' checksums and texts,
    and so are repeated rows. No rows give no shard. Other columns of docs are not used,
    whatever their names.
    """
    spark = docs.sparkSession
    if not shards:
        size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    plain = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    plain = plain.withColumn("c", F.crc32(F.col("t").cast("binary")))
    ordered = plain.repartitionByRange(shards, F.col("k").asc_nulls_first(), "c").sortWithinPartitions(F.col("k").asc_nulls_first(), "c", "t")

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, own = f"{root}/shard-{part:06d}.sst", f"{root}/_{uuid.uuid4().hex}"
        encode, writer, out = encoder(tokenizer), None, None
        for b in slices(batches):
            if b.num_rows and writer is None:
                out = store.open_output_stream(own)
                writer = ShardWriter(out)
            for doc_id, ids in zip(b.column(0).to_pylist(), encode.encode(b.column(1).to_pylist()), strict=True):
                writer.add(doc_id, np.append(ids, np.uint32(end_id)))
        if writer:
            writer.close()
            out.close()
            store.move(own, name)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{folder}/shard-{part:06d}.sst"]), pa.array([writer.entries], pa.int64()), pa.array([writer.ids], pa.int64())], ["shard", "path", "entries", "ids"])

    rows = sorted(tuple(r) for r in ordered.mapInArrow(write, "shard int, path string, entries long, ids long").collect())  # a row for each shard
    starts = np.concatenate(([0], np.cumsum([r[3] for r in rows]))).tolist()
    return spark.createDataFrame([(*r, s) for r, s in zip(rows, starts, strict=False)], "shard int, path string, entries long, ids long, start long")


def read_shards(shards: DataFrame) -> DataFrame:
    """A row for each entry of the shards: doc_id, start, n_tokens, ids_crc32."""

    def read(batches):
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as file:
                    rows = []
                    for doc_id, ids in Shard(file):
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                    yield _rows(rows)

    n = shards.count()
    return shards.repartition(max(1, n)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op5_token_sstable(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents written to shards and read back."""
    import public_tokenizers

    shards = write_shards(table(spark, sf_dir, "documents"), Scratch(spark).path("shards"), tokenizer or public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_shards(shards)
