"""Harmonic packing of token sequences.

A document is cut at the sequence size, what is left by the powers of two in its length down
to ``LEAST``, and a tail below that. A piece of length in (capacity / (j + 1), capacity / j]
belongs to class j, whose sequences take j pieces each. Workers fill the sequences of every
class on their own and shuffle nothing. Because all but the tails divide the capacity, full
sequences of them have no padding; those of tails lose less than one tail. What remains
in unfinished sequences at the end of a task is laid out once more: pieces of a class by the
powers of two in their number, which need no padding, the tails one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.arrow import binary_column, pieces
from murmur.llm.units import byte_units

CAPACITY = 2048
LEAST = 32
PIECES = ("doc_id long, start long, length long, ids binary, doc_tokens long, "
          "sequence_id long, offset long")
_NAMES = ["doc_id", "start", "length", "ids", "doc_tokens"]


def cut(sizes: np.ndarray, capacity: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Document number and length of each piece, in document order."""
    whole, rest = np.divmod(sizes, capacity)
    steps = [1 << k for k in range(capacity.bit_length() - 2, least.bit_length() - 2, -1)]
    counts = np.stack([whole, *[(rest & s) // s for s in steps], (rest % least > 0).astype(np.int64)],
                      axis=1)
    lengths = np.broadcast_to(np.array([capacity, *steps, 0]), counts.shape).copy()
    lengths[:, -1] = rest % least
    doc = np.broadcast_to(np.arange(len(sizes))[:, None], counts.shape)
    n = counts.ravel()
    return np.repeat(doc.ravel(), n), np.repeat(lengths.ravel(), n)


def _ordinal(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each piece in its class, and the size of its class, in the order given."""
    order = np.argsort(kind, kind="stable")
    size = np.bincount(kind)
    first = np.cumsum(size) - size
    rank = np.empty(len(kind), np.int64)
    rank[order] = np.arange(len(kind)) - first[kind[order]]
    return rank, size[kind]


def _placed(batch: pa.RecordBatch, rows, sequence, offset) -> pa.RecordBatch:
    rows = batch.take(pa.array(rows))
    return pa.record_batch([*rows.columns, pa.array(sequence, pa.int64()),
                            pa.array(offset, pa.int64())], [*_NAMES, "sequence_id", "offset"])


def _fill(batch: pa.RecordBatch, capacity: int, next_id: int):
    """Full sequences of each class, what is left, and the next free sequence id."""
    length = batch.column("length").to_numpy()
    kind = capacity // length
    rank, size = _ordinal(kind)
    full = rank < size // kind * kind
    rows = np.flatnonzero(full)
    slot = np.stack([kind[rows], rank[rows] // kind[rows]])
    # classes have fixed numbers of pieces, so sequences are numbered without a search
    numbers, sequence = np.unique(slot, axis=1, return_inverse=True)
    offset = rank[rows] % kind[rows] * length[rows]
    order = np.lexsort((offset, sequence.ravel()))
    placed = _placed(batch, rows[order], next_id + sequence.ravel()[order], offset[order])
    return placed, batch.take(pa.array(np.flatnonzero(~full))), next_id + numbers.shape[1]


def _finish(batch: pa.RecordBatch, capacity: int, least: int, next_id: int) -> pa.RecordBatch:
    """The unfinished sequences of a task, with as little padding as their pieces allow."""
    length = batch.column("length").to_numpy()
    order = np.argsort(-length, kind="stable")
    sequence, offset = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    at, left = 0, 0  # place in the current sequence, pieces that still belong to it
    current = next_id - 1
    for i, size in enumerate(length[order]):
        if left == 0 or size < least and at + size > capacity:
            current += 1
            at = 0
            same = int((length[order[i:]] == size).sum())
            left = 1 << (same.bit_length() - 1) if size >= least else len(order)
        sequence[i], offset[i] = current, at
        at += size
        left -= 1
    return _placed(batch, order, sequence, offset)


def _pack(tokenizer: str, end_id: int, capacity: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_units(tokenizer)
        next_id = TaskContext.get().partitionId() << 33
        rest = None
        for batch in pieces(batches, "text", 4 << 20):
            ids, bounds = encoder.encode(batch.column("text").to_pylist(), end_id)
            sizes = np.diff(bounds)
            doc, length = cut(sizes, capacity, least)
            ends = np.cumsum(length)
            first = np.cumsum(sizes) - sizes
            new = pa.record_batch(
                [batch.column("doc_id").take(pa.array(doc)), pa.array(ends - length - first[doc]),
                 pa.array(length), binary_column(ids.astype("<u4"), np.append(0, ends)),
                 pa.array(sizes[doc])], _NAMES)
            if rest is not None:
                new = pa.Table.from_batches([rest, new]).combine_chunks().to_batches()[0]
            placed, rest, next_id = _fill(new, capacity, next_id)
            yield placed
        if rest is not None and rest.num_rows:
            yield _finish(rest, capacity, least, next_id)
    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY,
         least: int = LEAST) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` ids.

    Texts are encoded without added special tokens (null: empty), each followed by ``end_id``;
    every id lies in exactly one piece. Returns one row for each piece: ``doc_id, start`` (the
    document's ids before it), ``length, ids`` (little-endian unsigned 32-bit), ``doc_tokens,
    sequence_id, offset``. Repeated rows are packed as often as they occur; a null ``doc_id``
    stays null. Other columns are ignored.
    """
    if capacity & (capacity - 1) or least & (least - 1) or not 1 <= least <= capacity // 2:
        raise ValueError("capacity and least must be powers of two, least the smaller one")
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(_pack(tokenizer, end_id, capacity, least), PIECES))


def sequences(packed: DataFrame, pad_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Whole sequences: ids joined by offset, padded to ``capacity`` unless at a power of two."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    pad = F.unhex(F.concat(*[F.lpad(F.hex(F.lit(pad_id >> s & 255)), 2, "0") for s in (0, 8, 16, 24)]))
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    whole = F.aggregate("parts", F.unhex(F.lit("")), lambda acc, p: F.concat(acc, p["ids"]))
    even = F.bit_count("n_tokens") == 1
    return rows.select("sequence_id", "n_tokens", F.when(even, whole).otherwise(
        F.rpad(whole, F.lit(4 * capacity), pad)).alias("ids"))
