"""Sorted-string-table shards of token ids.

A shard holds documents in ascending key order: blocks of prefix-compressed entries with restart points, then a sparse
index (the last key of each block), a Bloom filter of the keys and a footer of fixed size. A lookup asks the filter,
bisects the index, and bisects one block's restart points.

    block   entries | u32 place of each restart | u32 restarts, compressed with zstd, then u32 crc32 of what is stored
    entry   varint shared, varint unshared, varint value length, unshared key bytes, value
    key     0x00 for a null id, else 0x01 and 8 bytes big-endian of the id with its sign bit flipped
    value   ids, unsigned little-endian of the footer's width (2 or 4 bytes)
    index   per block: u16 key length, last key, u64 offset, u32 stored length
    footer  u64 index offset, u32 length, u64 filter offset, u32 length, u64 documents, u64 ids, u8 width, u8 probes, magic

Shards are written by range-partitioned, sorted tasks straight to the output folder under names of their own attempt;
only those that the manifest names count, so a lost or repeated task leaves a stray file and no wrong result. A shard ends
at a number of bytes or of documents, whichever comes first, so neither its blocks nor its keys outgrow a task. The
manifest has each shard's first and last key: a lookup bisects the shards, then their blocks, then a block's restart
points. get_documents looks up a whole table of keys so, each task a range of them.

Cases: a null text is an empty document; null ids come first; documents with equal ids are all kept, ordered by the hash
of their text; an empty table has a manifest without shards; other columns are not read; a document of any length is one
entry, in a block of its own if it is long.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as dataset
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, scratch_path, slices, texts_of
from .tokens import encoder

MAGIC = b"LLSST\x001\n"
_FOOTER = struct.Struct("<QIQIQQBB8s")
_INDEX = struct.Struct("<QI")
RESTART_EVERY = 16
BLOCK_BYTES = 256 << 10
SHARD_BYTES, SHARD_DOCS = 128 << 20, 1 << 20
BITS_PER_KEY = 10


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key[:1] == b"\x00" else int.from_bytes(key[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int, k: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & 0xFFFFFFFFFFFFFFFF, h >> 64 | 1
    return [(a + i * b) % bits for i in range(k)]


def open_uri(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark writes it."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class TableWriter:
    """Writes entries, which must come in ascending key order, to a sink that has write()."""

    def __init__(self, sink, width: int):
        self._sink, self._width, self._zstd = sink, width, zstandard.ZstdCompressor(level=1)
        self._at = self.docs = self.ids = self._rows = self._size = 0
        self._block: list[bytes] = []
        self._restarts: list[int] = []
        self.first = self._last = b""
        self._index: list[tuple[bytes, int, int]] = []
        self._keys: list[bytes] = []

    @property
    def written(self) -> int:
        return self._at + self._size

    @property
    def last(self) -> bytes:
        return self._last

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self._size and self._size + len(ids) * self._width > BLOCK_BYTES:
            self._flush()
        shared = 0
        if self._rows % RESTART_EVERY == 0:
            self._restarts.append(self._size)
        else:
            while shared < min(len(key), len(self._last)) and key[shared] == self._last[shared]:
                shared += 1
        if self._width == 2 and len(ids) and int(ids.max()) > 0xFFFF:
            raise ValueError(f"id {int(ids.max())} does not fit in two bytes: write the table with width 4")
        value = ids.astype("<u2" if self._width == 2 else "<u4").tobytes()
        entry = b"".join((_varint(shared), _varint(len(key) - shared), _varint(len(value)), key[shared:], value))
        self._block.append(entry)
        self._size += len(entry)
        self._rows += 1
        self.docs += 1
        self.ids += len(ids)
        if self.docs == 1:
            self.first = key
        if key != self._last or self.docs == 1:
            self._keys.append(key)
        self._last = key

    def _flush(self) -> None:
        if self._block:
            raw = b"".join([*self._block, np.asarray(self._restarts, "<u4").tobytes(), struct.pack("<I", len(self._restarts))])
            stored = self._zstd.compress(raw)
            self._index.append((self._last, self._at, len(stored) + 4))
            self._put(stored + struct.pack("<I", zlib.crc32(stored)))
            self._block, self._restarts, self._rows, self._size = [], [], 0, 0

    def _put(self, data: bytes) -> tuple[int, int]:
        self._sink.write(data)
        self._at += len(data)
        return self._at - len(data), len(data)

    def close(self) -> None:
        self._flush()
        index = self._put(b"".join(struct.pack("<H", len(k)) + k + _INDEX.pack(at, n) for k, at, n in self._index))
        bits = max(64, (len(self._keys) * BITS_PER_KEY + 7) // 8 * 8)
        k = 7
        found = np.zeros(bits // 8, np.uint8)
        for key in self._keys:
            for p in _probes(key, bits, k):
                found[p >> 3] |= 1 << (p & 7)
        bloom = self._put(found.tobytes())
        self._put(_FOOTER.pack(*index, *bloom, self.docs, self.ids, self._width, k, MAGIC))


class TableReader:
    """Reads a shard from a source that has seek(), read() and size()."""

    def __init__(self, source):
        self._source = source
        end = source.size()
        index_at, index_n, bloom_at, bloom_n, self.docs, self.ids, self._width, self._k, magic = _FOOTER.unpack(self._read(end - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard: its footer has another mark")
        self._bloom = self._read(bloom_at, bloom_n)
        raw, at = self._read(index_at, index_n), 0
        self._last_keys: list[bytes] = []
        self._blocks: list[tuple[int, int]] = []
        while at < len(raw):
            (n,) = struct.unpack_from("<H", raw, at)
            self._last_keys.append(raw[at + 2 : at + 2 + n])
            self._blocks.append(_INDEX.unpack_from(raw, at + 2 + n))
            at += 2 + n + _INDEX.size
        self._zstd = zstandard.ZstdDecompressor()

    def _read(self, at: int, n: int) -> bytes:
        self._source.seek(at)
        return self._source.read(n)

    def _load(self, i: int) -> tuple[bytes, list[int], int]:
        at, n = self._blocks[i]
        stored = self._read(at, n)
        if zlib.crc32(stored[:-4]) != struct.unpack("<I", stored[-4:])[0]:
            raise ValueError(f"block {i} is damaged")
        raw = self._zstd.decompress(stored[:-4])
        (count,) = struct.unpack_from("<I", raw, len(raw) - 4)
        end = len(raw) - 4 - 4 * count
        return raw, np.frombuffer(raw, "<u4", count, end).tolist(), end

    def _entries(self, raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, np.ndarray]]:
        key = b""
        while at < end:
            shared, at = _read_varint(raw, at)
            unshared, at = _read_varint(raw, at)
            n, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + unshared]
            at += unshared
            yield key, np.frombuffer(raw, "<u2" if self._width == 2 else "<u4", n // self._width, at)
            at += n

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self._blocks)):
            raw, _, end = self._load(i)
            for key, ids in self._entries(raw, 0, end):
                yield id_of(key), ids

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self._bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key_of(doc_id), len(self._bloom) * 8, self._k))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document of that key, none if there is none."""
        if not self.may_hold(doc_id):
            return []
        key, found = key_of(doc_id), []
        for i in range(bisect_left(self._last_keys, key), len(self._blocks)):
            raw, restarts, end = self._load(i)
            first = [next(self._entries(raw, r, end))[0] for r in restarts] if len(restarts) < 3 else _LazyKeys(self, raw, restarts, end)
            at = restarts[max(0, bisect_left(first, key) - 1)]
            for k, ids in self._entries(raw, at, end):
                if k == key:
                    found.append(ids)
                elif k > key:
                    return found
        return found


class _LazyKeys:
    """The keys at a block's restart points, read as bisect asks for them."""

    def __init__(self, reader: TableReader, raw: bytes, restarts: list[int], end: int):
        self._of = lambda i: next(reader._entries(raw, restarts[i], end))[0]
        self._n = len(restarts)

    def __len__(self) -> int:
        return self._n

    def __getitem__(self, i: int) -> bytes:
        return self._of(i)


MANIFEST = "path string, partition int, nth int, docs long, ids long, bytes long, first_key binary, last_key binary"


def write_shards(docs: DataFrame, out: str, tokenizer_path: str | None = None, end_id: int = 0, width: int = 2, shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append end_id, and write shards in ascending key order under out; returns the manifest."""

    def write_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, ctx = encoder(tokenizer_path), TaskContext.get()
        fs, folder = open_uri(out)
        part, rows, writer, sink, path = ctx.partitionId(), [], None, None, ""
        end = np.asarray([end_id], "<u4").tobytes()

        def finish() -> None:
            writer.close()
            sink.close()
            rows.append((path, part, len(rows), writer.docs, writer.ids, writer.written, writer.first, writer.last))

        for batch in slices(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1).to_pylist())):
                if writer is None:
                    path = f"{folder}/part-{part:06d}-{len(rows):04d}-{ctx.taskAttemptId()}.sst"
                    sink = fs.open_output_stream(path)
                    writer = TableWriter(sink, width)
                writer.add(key_of(doc_id), np.frombuffer(ids + end, "<u4"))
                if writer.written >= shard_bytes or writer.docs >= shard_docs:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        cols = list(zip(*rows)) or [()] * 8
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in MANIFEST.split(", ")])

    ranged = texts_of(docs, id_col, text_col).withColumn("h", F.xxhash64("text")).repartitionByRange(F.col("doc_id").asc_nulls_first(), "h")
    return ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h").select("doc_id", "text").mapInArrow(write_batches, MANIFEST)


def read_digests(spark: SparkSession, manifest: DataFrame, out: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the shards themselves, one task a shard.

    start counts the ids of all documents before it: one running sum over the manifest, which has a row for each shard,
    gives each shard's first, and the shard's own order the rest.
    """
    before = Window.orderBy("partition", "nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long").alias("base"))
    shards = manifest.count()
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_uri(out)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(path) as source:
                    rows: list[tuple] = []
                    for doc_id, ids in TableReader(source).scan():
                        rows.append((doc_id, base, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        base += len(ids)
                        if len(rows) == 20_000:
                            yield _batch(rows)
                            rows = []
                    yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(max(1, min(shards, 20_000))).mapInArrow(read_batches, schema)


def lookup(manifest: DataFrame, out: str, doc_ids: list[int | None]) -> dict[int | None, list[list[int]]]:
    """The ids of the documents of a few keys, by binary search; for tools and tests, on the caller's machine."""
    fs, _ = open_uri(out)
    found: dict[int | None, list[list[int]]] = {}
    for d in doc_ids:
        key, found[d] = F.lit(key_of(d)), []
        for row in manifest.where((F.col("first_key") <= key) & (F.col("last_key") >= key)).orderBy("partition", "nth").select("path").toLocalIterator():
            with fs.open_input_file(row["path"]) as source:
                found[d] += [ids.tolist() for ids in TableReader(source).get(d)]
    return found


def get_documents(keys: DataFrame, manifest_path: str, out: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of every document whose id is among keys: each task has a range of sorted keys and opens the shards
    that hold some of it, once each. Of the manifest at manifest_path it reads the rows whose keys overlap its own."""

    def get_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, _), (manifest_fs, folder) = open_uri(out), open_uri(manifest_path)
        shards = dataset.dataset(folder, filesystem=manifest_fs, format="parquet")
        for batch in batches:
            asked = batch.column(0).to_pylist()
            if not asked:
                continue
            wanted = [key_of(d) for d in asked]
            near = shards.to_table(["path", "first_key", "last_key"], filter=(dataset.field("last_key") >= wanted[0]) & (dataset.field("first_key") <= wanted[-1]))
            for path, first, last in sorted(zip(*(near.column(c).to_pylist() for c in near.column_names)), key=lambda x: x[1:]):
                mine = asked[bisect_left(wanted, first) : bisect_right(wanted, last)]
                if mine:
                    with fs.open_input_file(path) as source:
                        table = TableReader(source)
                        for d in mine:
                            if got := table.get(d):
                                yield pa.RecordBatch.from_arrays([pa.array([d] * len(got), pa.int64()), pa.array([x.tolist() for x in got], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    ranged = keys.select(F.col(id_col).cast("long").alias("doc_id")).distinct().repartitionByRange(F.col("doc_id").asc_nulls_first())
    return ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first()).mapInArrow(get_batches, "doc_id long, ids array<long>")


def encode_and_read(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Write the shards to a new folder of the shared one and return the digests read back from them."""
    spark = docs.sparkSession
    out = scratch_path(spark, "sstables")
    manifest, _ = materialise(write_shards(docs, out, tokenizer_path), "manifest")
    return read_digests(spark, manifest, out)
