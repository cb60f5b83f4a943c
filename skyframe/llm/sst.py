"""Token identifiers in sorted-string-table shards.

A shard holds consecutive identifiers of documents, ascending:

    block*  index  Bloom filter  footer

A block is zstd-compressed entries: varints for the bytes shared with the key
before, the bytes that follow and the value's length, then those bytes and the
value.  Keys are a document's identifier as eight big-endian bytes with the sign
bit turned, so that bytes sort as numbers; a null identifier is the empty key and
comes first.  A value is the token identifiers, little-endian, of two bytes each
if all fit, else of four (a first byte says which).  The index has each block's
first key, place and sizes; the footer has the places of index and filter, the
counts and a mark.  A lookup asks the filter, then searches the index and one
block.

There are at least as many ranges of identifiers as the input has splits, so a task's share
doesn't grow with the input; rows of one identifier (null is one) may lie in several, in the order of the
input.  A range begins another file at ``ROLL`` bytes, and a writer holds a block, the
index and eight bytes a document of the file it writes.

Files go to the shared folder by Arrow's file systems (file, hdfs, s3, gs).  A
task's file has a name of its own and counts only once the task reports it, so a
lost executor or a second attempt leaves nothing half written in use; what it leaves behind
is removed once all have reported.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import runtime, tokens
from .textcore import mix64

BLOCK_BYTES, BITS_A_KEY, PROBES, ROLL = 1 << 16, 10, 7, 1 << 30
_MARK = b"SKYSST01"
_FOOTER = struct.Struct("<QQQQQQ8s")


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = data[at]
        at += 1
        n |= (x & 0x7F) << shift
        if x < 0x80:
            return n, at
        shift += 7


def _number(key: bytes) -> int:
    return int.from_bytes(key, "big") + len(key) * 0x9E37 & (1 << 64) - 1


def _probes(h: np.ndarray, bits: int) -> np.ndarray:
    """Places in the filter of each key's number, a row a key."""
    a, b = mix64(h), mix64(h ^ np.uint64(0x5555555555555555)) | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)


class Writer:
    """Entries must come in ascending order of keys; equal keys may repeat."""

    def __init__(self, out) -> None:
        self._out, self._at = out, 0
        self._block, self._last, self._first = bytearray(), b"", None
        self._index: list[tuple[bytes, int, int, int]] = []
        self._keys = array("Q")
        self.n_tokens = self.n_docs = 0

    @property
    def size(self) -> int:
        """Bytes so far, the block at hand unpacked."""
        return self._at + len(self._block)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self._first is None:
            self._first, self._last = key, b""
        shared = 0
        while shared < min(len(key), len(self._last)) and key[shared] == self._last[shared]:
            shared += 1
        value = b"\2" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\4" + ids.astype("<u4").tobytes()
        self._block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self._last = key
        self._keys.append(_number(key))
        self.n_tokens += len(ids)
        self.n_docs += 1
        if len(self._block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self._first is None:
            return
        packed = pa.compress(bytes(self._block), "zstd", asbytes=True)
        self._out.write(packed)
        self._index.append((self._first, self._at, len(packed), len(self._block)))
        self._at += len(packed)
        self._block, self._first = bytearray(), None

    def close(self) -> int:
        """Bytes of the file."""
        self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(a) + _varint(b) + _varint(c) for k, a, b, c in self._index)
        bits = max(64, BITS_A_KEY * len(self._keys))
        marks, keys = np.zeros(bits, bool), np.frombuffer(self._keys, np.uint64)
        for lo in range(0, len(keys), 1 << 16):
            marks[_probes(keys[lo : lo + (1 << 16)], bits).ravel().astype(np.int64)] = True
        bloom = np.packbits(marks).tobytes()
        self._out.write(index + bloom + _FOOTER.pack(self._at, len(index), len(self._index), bits, len(self._keys), self.n_tokens, _MARK))
        return self._at + len(index) + len(bloom) + _FOOTER.size


class Reader:
    """source: a seekable binary file."""

    def __init__(self, source) -> None:
        self._source = source
        source.seek(0, 2)
        end = source.tell()
        source.seek(end - _FOOTER.size)
        at, size, blocks, self._bits, self.n_docs, self.n_tokens, mark = _FOOTER.unpack(source.read(_FOOTER.size))
        if mark != _MARK:
            raise ValueError("not a shard of this format")
        source.seek(at)
        index = source.read(size)
        self._bloom = np.frombuffer(source.read(-(-self._bits // 8)), np.uint8)
        self.index: list[tuple[bytes, int, int, int]] = []
        at = 0
        for _ in range(blocks):
            n, at = _read_varint(index, at)
            key, at = index[at : at + n], at + n
            a, at = _read_varint(index, at)
            b, at = _read_varint(index, at)
            c, at = _read_varint(index, at)
            self.index.append((key, a, b, c))

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, place, size, full = self.index[k]
        self._source.seek(place)
        data = pa.decompress(self._source.read(size), full, "zstd", asbytes=True)
        at, last = 0, b""
        while at < full:
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            last = last[:shared] + data[at : at + rest]
            at += rest
            yield last, np.frombuffer(data, "<u2" if data[at] == 2 else "<u4", (n - 1) // data[at], at + 1)
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.index)):
            yield from self.block(k)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """What is kept under an identifier."""
        key = key_of(doc_id)
        at = _probes(np.array([_number(key)], np.uint64), self._bits)[0].astype(np.int64)
        if not (self._bloom[at >> 3] >> (7 - (at & 7)) & 1).all():
            return []
        out, firsts = [], [x[0] for x in self.index]
        k = bisect_right(firsts, key) - 1
        while k > 0 and firsts[k] == key:  # equal keys may begin in the block before
            k -= 1
        for k in range(max(k, 0), len(firsts)):
            if firsts[k] > key:
                break
            out += [ids for own, ids in self.block(k) if own == key]
        return out


def open_shard(uri: str) -> Reader:
    system, path = fs.FileSystem.from_uri(uri)
    return Reader(system.open_input_file(path))


def write(docs: DataFrame, folder: str, shards: int, vocabulary: str = tokens.VOCABULARY, roll: int = ROLL) -> DataFrame:
    """Write every row of docs (doc_id, text). Returns a row a file: shard, part, uri, n_docs, n_tokens, bytes."""
    export = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary).encode
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        shard, part, writer = TaskContext.get().partitionId(), 0, None

        def closed() -> pa.RecordBatch:
            size = writer.close()
            out.close()
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "part": pa.array([part], pa.int32()), "uri": [f"{folder}/{name}"], "n_docs": [writer.n_docs], "n_tokens": [writer.n_tokens], "bytes": [size]})

        for b in batches:
            keys = b.column("doc_id").to_pylist()
            for lo, found in encode(b.column("text")):
                for k, ids in enumerate(found):
                    if writer is None:
                        name = f"{export}-{shard:06d}-{part:04d}-{uuid.uuid4().hex}.sst"
                        out = system.open_output_stream(f"{path}/{name}")
                        writer = Writer(out)
                    writer.add(key_of(keys[lo + k]), np.append(ids, np.uint32(tokens.END)))
                    if writer.size >= roll:
                        yield closed()
                        part, writer = part + 1, None
        if writer is not None:
            yield closed()

    # the order of the input deals out the rows of one identifier
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("_row"))
    rows = rows.repartitionByRange(shards, "doc_id", "_row").sortWithinPartitions("doc_id", "_row").select("doc_id", "text")
    manifest = runtime.cut(rows.mapInArrow(run, "shard int, part int, uri string, n_docs long, n_tokens long, bytes long"))
    _tidy(folder, export, {r.uri.rsplit("/", 1)[-1] for r in manifest.select("uri").toLocalIterator()})
    return manifest


def _tidy(folder: str, export: str, names: set[str]) -> None:
    """Remove files of this export that no task reported."""
    system, path = fs.FileSystem.from_uri(folder)
    for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if info.base_name.startswith(export) and info.base_name not in names:
            system.delete_file(info.path)


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the shards; start counts the tokens of all documents before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, base in zip(b.column("uri").to_pylist(), b.column("base").to_pylist(), strict=True):
                reader = open_shard(uri)
                for k in range(len(reader.index)):
                    own = [(id_of(key), len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for key, ids in reader.block(k)]
                    sizes = np.array([x[1] for x in own], np.int64)
                    starts = base + np.cumsum(sizes) - sizes
                    base += int(sizes.sum())
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in own], pa.int64()), pa.array(starts), pa.array(sizes), pa.array([x[2] for x in own], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a row a file: the sum runs over files, not documents
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("shard", "uri", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")).alias("base"))
    return based.repartition(max(runtime.partitions(manifest.sparkSession), manifest.count()), "uri").select("uri", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def export(docs: DataFrame, folder: str | None = None, shards: int | None = None, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """Write the shards and read them back. shards: ranges of identifiers; else one a split of the input, and one a partition that Spark shuffles to at least."""
    spark = docs.sparkSession
    shards = shards or max(runtime.partitions(spark), docs.rdd.getNumPartitions())
    return read(write(docs, folder or runtime.fresh_dir(spark, "sst"), shards, vocabulary))
