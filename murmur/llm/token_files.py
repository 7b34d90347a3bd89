"""Token ids in files of fixed-width bits, written and read by Spark tasks.

A file holds the ids of consecutive documents:

* header: magic, bits an id, ids a block, documents, ids (little-endian);
* blocks: ``block`` ids each (the last one filled with zeros), every id in ``bits`` bits, the
  smallest number that holds the vocabulary; 32 ids take exactly ``bits`` 32-bit words;
* offset of each block, document ids, position of each document's first id;
* trailer: place of the offsets, crc32 of all before it.

Any range of ids is read by seeking to its blocks alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.llm.arrow import binary_column, pieces, shuffle_partitions
from murmur.llm.units import byte_units
from murmur.session import materialize

MAGIC = b"MURMTOK1"
HEADER = struct.Struct("<8sIIQQ")
TRAILER = struct.Struct("<QI")
BLOCK = 1 << 13
FILE_IDS = 1 << 25
LANES = 32
FILES = "shard long, number long, path string, n_docs long, n_tokens long"
NO_ID = -(1 << 63)  # stands for a null doc_id in a file
ROWS = "doc_id long, start long, n_tokens long, ids binary"


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each; the last group of 32 is filled with zeros."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit into {bits} bits")
    lanes = np.zeros((-(-len(ids) // LANES), LANES), np.uint64)
    lanes.ravel()[:len(ids)] = ids
    if bits in (8, 16, 32):  # the same bytes
        return lanes.astype(f"<u{bits // 8}").tobytes()
    words = np.zeros((len(lanes), bits + 1), np.uint64)
    for lane in range(LANES):
        word, shift = divmod(lane * bits, 32)
        wide = lanes[:, lane] << np.uint64(shift)
        words[:, word] |= wide & np.uint64(0xFFFFFFFF)
        words[:, word + 1] |= wide >> np.uint64(32)
    return words[:, :bits].astype("<u4").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}")[:n].astype(np.uint32)
    words = np.frombuffer(data, "<u4").reshape(-1, bits).astype(np.uint64)
    words = np.concatenate([words, np.zeros((len(words), 1), np.uint64)], axis=1)
    out = np.empty((len(words), LANES), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for lane in range(LANES):
        word, shift = divmod(lane * bits, 32)
        both = words[:, word] | (words[:, word + 1] << np.uint64(32))
        out[:, lane] = (both >> np.uint64(shift)) & mask
    return out.ravel()[:n]


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, as tasks and driver alike reach it."""
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path.replace("file:/", "file:///")
                                              if path.startswith("file:/") and
                                              not path.startswith("file://") else path)
    return pyarrow.fs.LocalFileSystem(), path


class Writer:
    """One file; ids come in document by document, blocks leave as they fill."""

    def __init__(self, stream, bits: int, block: int):
        self._stream, self._bits, self._block = stream, bits, block
        self._crc = self._at = 0
        self._rest = np.zeros(0, np.uint32)
        self._offsets, self._docs, self._starts, self.n_tokens = [], [], [], 0
        self._put(HEADER.pack(MAGIC, bits, block, 0, 0))

    def _put(self, data: bytes) -> None:
        self._stream.write(data)
        self._crc = zlib.crc32(data, self._crc)
        self._at += len(data)

    def add(self, docs: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> None:
        self._docs.append(docs)
        self._starts.append(bounds[:-1] + self.n_tokens)
        self.n_tokens += len(ids)
        self._rest = np.concatenate([self._rest, ids])
        whole = len(self._rest) // self._block * self._block
        if whole:
            data = pack(self._rest[:whole], self._bits)
            size = self._block * self._bits // 8
            self._offsets += range(self._at, self._at + len(data), size)
            self._put(data)
            self._rest = self._rest[whole:]

    @property
    def n_docs(self) -> int:
        return sum(map(len, self._docs))

    def close(self) -> None:
        if len(self._rest):
            self._offsets.append(self._at)
            self._put(pack(self._rest, self._bits))
        tail = self._at
        docs = np.concatenate([np.zeros(0, "<i8"), *self._docs]).astype("<i8")
        starts = np.concatenate([np.zeros(0, "<u8"), *self._starts,
                                 [self.n_tokens]]).astype("<u8")
        self._put(struct.pack("<QQ", len(docs), self.n_tokens))
        for part in (np.array(self._offsets, "<u8"), docs, starts):
            self._put(part.tobytes())
        self._stream.write(TRAILER.pack(tail, self._crc))
        self._stream.close()


class Reader:
    """Random access to one file."""

    def __init__(self, path: str):
        fs, name = filesystem(path)
        self._file = fs.open_input_file(name)
        magic, self.bits, self.block, _, _ = HEADER.unpack(self._file.read_at(HEADER.size, 0))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token file")
        size = self._file.size()
        tail, self.crc = TRAILER.unpack(self._file.read_at(TRAILER.size, size - TRAILER.size))
        index = self._file.read_at(size - TRAILER.size - tail, tail)
        n_docs, self.n_tokens = struct.unpack_from("<QQ", index)
        n_blocks = -(-self.n_tokens // self.block)
        at = 16
        self._offsets = np.frombuffer(index, "<u8", n_blocks, at)
        self.docs = np.frombuffer(index, "<i8", n_docs, at + 8 * n_blocks)
        self.starts = np.frombuffer(index, "<u8", n_docs + 1,
                                    at + 8 * (n_blocks + n_docs)).astype(np.int64)
        self._tail = tail

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` of the file; only their blocks are read."""
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        lo = int(self._offsets[first])
        hi = int(self._offsets[last + 1]) if last + 1 < len(self._offsets) else self._tail
        n = min((last + 1) * self.block, self.n_tokens) - first * self.block
        return unpack(self._file.read_at(hi - lo, lo), self.bits, n)[
            start - first * self.block:end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def _write(folder: str, tokenizer: str, end_id: int, block: int, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, context = byte_units(tokenizer), TaskContext.get()
        bits = bits_for(max(encoder.size, end_id + 1))
        fs, root = filesystem(folder)
        shard, done, writer, names = context.partitionId(), [], None, None

        def close():
            writer.close()
            fs.move(*names)  # a repeated attempt replaces the file by an equal one
            done.append((shard, len(done), f"{folder}/{names[1].rsplit('/', 1)[1]}",
                         writer.n_docs, writer.n_tokens))

        for batch in pieces(batches, "text", 4 << 20):
            ids, bounds = encoder.encode(batch.column("text").to_pylist(), end_id)
            if writer is None:
                name = f"{root}/part-{shard:06d}-{len(done):04d}"
                names = (f"{name}.{context.taskAttemptId()}.tmp", f"{name}.tok")
                writer = Writer(fs.open_output_stream(names[0]), bits, block)
            writer.add(batch.column("doc_id").to_numpy(), ids, bounds)
            if writer.n_tokens >= file_ids:
                close()
                writer = None
        if writer is not None:
            close()
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("shard", "number", "path", "n_docs", "n_tokens"), d)) for d in done],
            pa.schema([("shard", pa.int64()), ("number", pa.int64()), ("path", pa.string()),
                       ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))
    return run


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2,
                 block: int = BLOCK, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode whole texts in ascending ``doc_id`` order; returns one row for each file.

    Texts are encoded without added special tokens (null: empty), each followed by ``end_id``.
    Documents are dealt by ranges of ``doc_id``, so the files in the order of ``shard, number``
    hold all ids in order; ``start`` counts the ids before a file. Rows whose ``doc_id`` is
    null come first and are read back as null. Equal ids stay in separate rows, in the order of
    their texts. Other columns are ignored.
    """
    if block % LANES:
        raise ValueError("a block must be a multiple of 32 ids")
    spark = docs.sparkSession
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    files = materialize(
        rows.repartitionByRange(shuffle_partitions(spark), "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(_write(folder, tokenizer, end_id, block, file_ids), FILES), "token-files")
    before = Window.orderBy("shard", "number").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            reader, at = Reader(path), 0
            while at < len(reader.docs):
                # as many documents as a few blocks hold, one at least
                end = int(np.searchsorted(reader.starts, reader.starts[at] + (1 << 20), "right")) - 1
                end = min(max(end, at + 1), len(reader.docs))
                lo, hi = reader.starts[at], reader.starts[end]
                bounds = reader.starts[at:end + 1] - lo
                docs = reader.docs[at:end]
                yield pa.record_batch(
                    [pa.array(docs, mask=docs == NO_ID), pa.array(bounds[:-1] + lo + start),
                     pa.array(np.diff(bounds)),
                     binary_column(reader.ids(int(lo), int(hi)).astype("<u4"), bounds)],
                    ["doc_id", "start", "n_tokens", "ids"])
                at = end


def read_tokens(files: DataFrame) -> DataFrame:
    """Documents of the files: ``doc_id, start, n_tokens, ids`` (little-endian 32-bit ids)."""
    return files.select("path", "start").repartition(
        shuffle_partitions(files.sparkSession)).mapInArrow(_read, ROWS)


def read_document(spark: SparkSession, path: str, number: int) -> np.ndarray:
    """Ids of one document of one file."""
    return Reader(path).document(number)
