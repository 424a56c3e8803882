"""Sorted string tables of token ids.

File: blocks, block index, Bloom filter, footer.  A block holds entries in key
order, each as varint(shared prefix with the previous key), varint(rest of the
key), varint(value bytes), rest of the key, value; blocks are zstd-compressed.
The sparse index has one entry a block: first key, offset, size, documents and
tokens before the block.  The footer has fixed size and says where the index
and the filter are.  A lookup asks the filter, bisects the index, and reads one
block.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quillspark.llm.tokens import encoder
from quillspark.scratch import scratch_path

MAGIC = b"QSST0001"
FOOTER = struct.Struct("<QQQQQQI8s")
BLOCK_BYTES, BLOOM_BITS, BLOOM_HASHES = 256 * 1024, 10, 7


def key_of(doc_id: int | None) -> bytes:
    """Bytes in the order of ids; null sorts first."""
    return b"" if doc_id is None else (int(doc_id) + 2**63).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - 2**63 if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _take(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def pack_ids(ids: bytes) -> bytes:
    """32-bit ids as a width byte and 16-bit ids where they fit."""
    wide = np.frombuffer(ids, "<u4")
    return b"\x02" + wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 65536 else b"\x04" + ids


def unpack_ids(value: bytes) -> bytes:
    return np.frombuffer(value, "<u2", offset=1).astype("<u4").tobytes() if value[:1] == b"\x02" else value[1:]


def n_ids(value: bytes) -> int:
    return (len(value) - 1) // value[0]


def _places(key: bytes, bits: int) -> Iterator[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), h >> 64 | 1
    return ((a + i * b) % bits for i in range(BLOOM_HASHES))


class Writer:
    """Takes entries in key order; ``sink`` needs write() only."""

    def __init__(self, sink):
        self.sink, self.at, self.block, self.last = sink, 0, bytearray(), b""
        self.index: list[tuple[bytes, int, int, int, int]] = []
        self.first: bytes | None = None
        self.n_docs = self.n_tokens = self.before_docs = self.before_tokens = 0
        self.hashes = array("Q")
        self.zstd = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, value: bytes) -> None:
        if self.first is None:
            self.first, self.last, self.before_docs, self.before_tokens = key, b"", self.n_docs, self.n_tokens
        shared = 0
        for x, y in zip(self.last, key):
            if x != y:
                break
            shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        h = xxhash.xxh3_128_intdigest(key)
        self.hashes.extend((h & (2**64 - 1), h >> 64))
        self.n_docs += 1
        self.n_tokens += n_ids(value)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def _flush(self) -> None:
        if self.first is not None:
            data = self.zstd.compress(bytes(self.block))
            self.index.append((self.first, self.at, len(data), self.before_docs, self.before_tokens))
            self._put(data)
            self.block, self.first = bytearray(), None

    def close(self) -> None:
        self._flush()
        index_at = self.at
        index = b"".join(_varint(len(k)) + k + struct.pack("<QQQQ", *rest) for k, *rest in self.index)
        self._put(index)
        bits = max(64, self.n_docs * BLOOM_BITS)
        bloom = bytearray((bits + 7) // 8)
        for i in range(0, len(self.hashes), 2):
            a, b = self.hashes[i], self.hashes[i + 1] | 1
            for j in range(BLOOM_HASHES):
                place = (a + j * b) % bits
                bloom[place >> 3] |= 1 << (place & 7)
        bloom_at = self.at
        self._put(bytes(bloom))
        self._put(FOOTER.pack(index_at, bloom_at - index_at, bloom_at, bits, self.n_docs, self.n_tokens, zlib.crc32(index + bytes(bloom)), MAGIC))


class Reader:
    """Random access to one table; ``file`` needs seek, read and size()."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - FOOTER.size)
        self.index_at, index_size, self.bloom_at, self.bits, self.n_docs, self.n_tokens, crc, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token table")
        file.seek(self.index_at)
        index, self.bloom = file.read(index_size), file.read((self.bits + 7) // 8)
        if zlib.crc32(index + self.bloom) != crc:
            raise ValueError("damaged index or filter")
        self.keys, self.blocks, at = [], [], 0
        while at < len(index):
            n, at = _take(index, at)
            self.keys.append(index[at : at + n])
            self.blocks.append(struct.unpack_from("<QQQQ", index, at + n))
            at += n + 32

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        offset, size, _, _ = self.blocks[i]
        self.file.seek(offset)
        data = zstandard.ZstdDecompressor().decompress(self.file.read(size))
        at, key = 0, b""
        while at < len(data):
            shared, at = _take(data, at)
            rest, at = _take(data, at)
            n, at = _take(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + n]
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.blocks)):
            yield from self._block(i)

    def may_contain(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _places(key, self.bits))

    def get(self, key: bytes) -> bytes | None:
        """The value of ``key``, or null; of a repeated key some value."""
        if not self.keys or not self.may_contain(key):
            return None
        i = bisect_right(self.keys, key) - 1
        # A repeated key may begin in the block before.
        for j in (i, i - 1):
            if j >= 0:
                for found, value in self._block(j):
                    if found == key:
                        return value
        return None


def _open(path: str):
    fs, inner = pafs.FileSystem.from_uri(path)
    return fs, inner


def write_token_table(docs: DataFrame, path: str, tokenizer: str, kind: str = "byte", end_id: int = 0, text_col: str = "text", id_col: str = "doc_id") -> list[dict]:
    """Write ``docs`` as shards below ``path``, a URI that all executors reach.

    Rows are dealt by ranges of the id, so shard and key order is id order; null
    ids come first.  Null texts have the end id only.  Rows repeated with one id
    are all written, in order of their texts.  A task writes under a name of its
    own and renames when done, so a lost or repeated task leaves whole shards.
    An empty table gives no shard with entries.  Returns one record a shard:
    shard, path, n_docs, n_tokens.
    """
    def shards(batches: Iterable):
        import pyarrow as pa

        context = TaskContext.get()
        shard, attempt = context.partitionId(), context.taskAttemptId()
        fs, folder = _open(path)
        fs.create_dir(folder, recursive=True)
        name, part = f"{folder}/shard-{shard:06d}.sst", f"{folder}/.shard-{shard:06d}-{attempt}"
        encode_all, end = encoder(tokenizer, kind).encode_all, array("I", [end_id]).tobytes()
        with fs.open_output_stream(part) as sink:
            writer = Writer(sink)
            for batch in batches:
                texts = (text.as_py() or "" for text in batch.column(1))
                for doc_id, ids in zip(batch.column(0).to_pylist(), encode_all(texts)):
                    writer.add(key_of(doc_id), pack_ids(ids + end))
            writer.close()
        if fs.get_file_info(name).type != pafs.FileType.NotFound:
            fs.delete_file(name)
        fs.move(part, name)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [writer.n_docs], "n_tokens": [writer.n_tokens]}, pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), docs[f"`{text_col}`"].alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    # One record a shard: bounded by the number of partitions.
    records = ordered.mapInArrow(shards, "shard int, n_docs long, n_tokens long").collect()
    return [{"shard": r.shard, "path": f"{path}/shard-{r.shard:06d}.sst", "n_docs": r.n_docs, "n_tokens": r.n_tokens} for r in sorted(records) if r.n_docs]


def read_token_table(spark, records: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids (32-bit) of all entries, read from the shards' files."""
    starts, total = [], 0
    for r in records:
        starts.append(total)
        total += r["n_tokens"]
    paths = [r["path"] for r in records]

    def read(batches: Iterable):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for i in batch.column(0).to_pylist():
                fs, name = _open(paths[i])
                with fs.open_input_file(name) as file:
                    reader, at, out = Reader(file), starts[i], []
                    for key, value in reader:
                        out.append((id_of(key), at, n_ids(value), unpack_ids(value)))
                        at += n_ids(value)
                        if len(out) >= 500:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                            out = []
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return spark.range(0, len(paths), 1, max(1, len(paths))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def token_table(docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 0) -> tuple[DataFrame, list[dict]]:
    """Write to a new folder in the shared one; what was read back, and the shards."""
    spark = docs.sparkSession
    records = write_token_table(docs, scratch_path(spark, "token-table"), tokenizer, kind, end_id)
    return read_token_table(spark, records), records
