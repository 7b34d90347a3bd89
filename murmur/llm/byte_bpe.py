"""Byte-level BPE by a table of ranks: texts to ids in overlapping chunks, ids back to bytes.

A text longer than ``chunk`` characters is dealt over tasks in chunks that overlap. Every chunk is
cut into pre-tokens on its own, starting at its first character, and its pieces are encoded. The
cuts depend on nothing before a boundary, so as soon as two neighbouring chunks share a boundary
inside their overlap they agree from there on; the ids of the left chunk count up to the first
shared boundary, those of the right one after it. Chunks that share none (one pre-token longer than
the overlap) are joined again and cut into chunks of sixteen times the size, the whole text at last.

Classes of characters are asked of the library itself, since Python's tables of letters and digits
follow another version of Unicode. Null texts count as empty; repeated rows and rows without an
id give a row each; other columns are left out.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from murmur.llm.arrow import binary_column, pieces
from murmur.session import materialize

CHUNK = 32_768  # characters
OVERLAP = 512
LOOK = 2  # characters after a match that may decide about it
WIDEN = 16
CACHE_BYTES = 48 << 20
CACHED_CHARS = 48
DECODED_ROWS = 256  # in hand at a time
LETTER, DIGIT, SPACE, OTHER = (ord(c) for c in "A0\t!")  # ASCII stand-ins of each class
CODED = ("row long, doc_id long, no int, ids array<int>, head array<struct<pos: int, at: int>>, "
         "tail array<struct<pos: int, at: int>>")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _encoding(pattern: str, ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def stand_ins() -> np.ndarray:
    """ASCII stand-in of every code point, by the classes the library's patterns use."""
    table = np.full(0x110000, OTHER, np.uint8)
    single = {bytes([b]): b for b in range(256)}
    for pattern, sign in ((r"\p{L}", LETTER), (r"\p{N}", DIGIT), (r"\s", SPACE)):
        library = _encoding(pattern, single)
        for at in range(0, 0x110000, 0x800):  # in blocks, to stay small in memory
            if not 0xD800 <= at < 0xE000:
                text = "".join(map(chr, range(at, at + 0x800)))
                found = bytes(library.encode_ordinary(text)).decode()
                table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = sign
    table[:0x80] = np.arange(0x80)
    return table


def ascii_pattern(pattern: str) -> re.Pattern:
    """The pattern over stand-ins; classes it may name are letters, digits and white space."""
    ranges = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": r"\t-\r "}

    def inside(body: str) -> str:
        return re.sub(r"\\p\{[LN]\}|\\s", lambda m: ranges[m[0]], body)

    def put(m: re.Match) -> str:
        if m[0][0] == "[":
            return inside(m[0])
        return f"[^{ranges[chr(92) + 's']}]" if m[0] == r"\S" else f"[{ranges[m[0]]}]"

    out = re.sub(r"\[[^\]]*\]|\\p\{[LN]\}|\\s|\\S", put, pattern)
    if re.search(r"\\[pPdDwWbBS]", out):
        raise ValueError(f"pattern names other classes: {pattern}")
    return re.compile(out)


class _Pieces(dict):
    """Ids of pieces as packed bytes; forgets everything once its size in bytes is reached."""

    def __init__(self, ranks: dict[bytes, int], limit: int):
        self._library = _encoding(r"[\s\S]+", ranks)  # one match: the piece as it stands
        self._limit = limit
        self.held = 0

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self._library.encode_ordinary(piece), np.uint32).tobytes()
        if len(piece) <= CACHED_CHARS:
            size = 250 + 4 * len(piece) + len(ids)
            if self.held + size > self._limit:
                self.clear()
                self.held = 0
            self[piece] = ids
            self.held += size
        return ids


class Encoder:
    """Pre-tokens and ids of texts, as the library gives them without special tokens."""

    def __init__(self, path: str, pattern: str, cache_bytes: int = CACHE_BYTES):
        self._cuts = ascii_pattern(pattern).findall
        self.cache = _Pieces(read_ranks(path), cache_bytes)

    def cut(self, text: str) -> list[str]:
        """Pre-tokens; put together they are the text."""
        if text.isascii():
            return self._cuts(text)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        sizes = map(len, self._cuts(stand_ins()[points].tobytes().decode("ascii")))
        out, at = [], 0
        for size in sizes:
            out.append(text[at:at + size])
            at += size
        return out

    def ids(self, parts: list[str]) -> bytes:
        return b"".join(map(self.cache.__getitem__, parts))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path, pattern)


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def _encode_whole(path: str, pattern: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in pieces(batches, "text"):
            coded = [own.ids(own.cut(t)) if t else b"" for t in batch.column("text").to_pylist()]
            bounds = np.cumsum([0, *map(len, coded)]) // 4
            ids = np.frombuffer(b"".join(coded), np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(ids, bounds)],
                                             ["doc_id", "ids"])
    return run


def _split(chunk: int, overlap: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            for row, doc, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                starts = range(0, max(len(text), 1), chunk)
                for first in range(0, len(starts), 64):  # slices of bounded size
                    part = starts[first:first + 64]
                    yield pa.RecordBatch.from_pydict({
                        "row": pa.array([row] * len(part), pa.int64()),
                        "doc_id": pa.array([doc] * len(part), pa.int64()),
                        "no": pa.array([s // chunk for s in part], pa.int32()),
                        "last": pa.array([s + chunk >= len(text) for s in part]),
                        "ends": pa.array([s + chunk + overlap >= len(text) for s in part]),
                        "text": pa.array([text[s:s + chunk + overlap] for s in part], pa.string())})
    return run


def _encode_chunks(path: str, pattern: str, chunk: int, overlap: int) -> Callable:
    def marks(ends: np.ndarray, at: np.ndarray, lo: int, hi: int) -> list[dict]:
        """Boundaries within [lo, hi], counted from lo, with the ids before each."""
        use = (ends >= lo) & (ends <= hi)
        return [{"pos": int(p) - lo, "at": int(a)} for p, a in zip(ends[use], at[use])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        kind = pa.list_(pa.struct([("pos", pa.int32()), ("at", pa.int32())]))
        for batch in pieces(batches, "text"):
            coded, heads, tails = [], [], []
            for text, last, ends_text in zip(*(batch.column(c).to_pylist()
                                               for c in ("text", "last", "ends"))):
                parts = own.cut(text)
                if not ends_text:  # what lies behind may lengthen the last match
                    limit = len(text) - LOOK
                    ends = np.cumsum([len(p) for p in parts])
                    parts = parts[:int(np.searchsorted(ends, limit, side="right"))]
                each = [own.cache[p] for p in parts]
                ends = np.cumsum([0, *map(len, parts)])
                at = np.cumsum([0, *map(len, each)]) // 4
                coded.append(b"".join(each))
                heads.append(marks(ends, at, 0, overlap))
                tails.append([] if last else marks(ends, at, chunk, chunk + overlap))
            bounds = np.cumsum([0, *map(len, coded)]) // 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("no"),
                 _lists(np.frombuffer(b"".join(coded), np.int32), bounds),
                 pa.array(heads, kind), pa.array(tails, kind)],
                ["row", "doc_id", "no", "ids", "head", "tail"])
    return run


def _seam(i: Column) -> Column:
    """First boundary that chunk i and the next one share, from the start of the latter."""
    return F.array_min(F.array_intersect(F.col("c")[i]["tail"]["pos"], F.col("c")[i + 1]["head"]["pos"]))


def _at(marks: Column, pos: Column) -> Column:
    return F.element_at(marks["at"], F.array_position(marks["pos"], pos).cast("int"))


def _stitched() -> Column:
    """Ids of all chunks ``c`` (in order) between their seams; null if a seam is missing."""
    n, seams = F.size("c"), F.col("seams")

    def part(i: Column) -> Column:
        c = F.col("c")[i]
        lo = F.when(i == 0, 0).otherwise(_at(c["head"], seams[F.greatest(i - 1, F.lit(0))]))
        hi = F.when(i == n - 1, F.size(c["ids"])).otherwise(
            _at(c["tail"], seams[F.least(i, n - 2)]))
        return F.slice(c["ids"], lo + 1, hi - lo)

    whole = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), part))
    return F.when(n == 1, F.col("c")[0]["ids"]).when(
        F.forall(seams, lambda s: s.isNotNull()), whole)


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK,
           overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, ids`` of every row's whole text."""
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    out = rows.where(size <= chunk).mapInArrow(_encode_whole(path, pattern),
                                               "doc_id long, ids array<int>")
    texts = rows.where(size > chunk).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    while True:
        chunks = materialize(
            texts.mapInArrow(_split(chunk, overlap),
                             "row long, doc_id long, no int, last boolean, ends boolean, text string")
            .repartition("row", "no"), "chunks")
        coded = chunks.mapInArrow(_encode_chunks(path, pattern, chunk, overlap), CODED)
        together = coded.groupBy("row").agg(
            F.max("doc_id").alias("doc_id"),
            F.sort_array(F.collect_list(F.struct("no", "ids", "head", "tail"))).alias("c"))
        seams = F.when(F.size("c") > 1, F.transform(F.sequence(F.lit(0), F.size("c") - 2), _seam))
        done = materialize(together.withColumn("seams", seams).select(
            "row", "doc_id", _stitched().alias("ids")), "stitched")
        out = out.unionByName(done.where(F.col("ids").isNotNull()).select("doc_id", "ids"))
        open_rows = done.where(F.col("ids").isNull()).select("row")
        if open_rows.isEmpty():
            return out
        own = F.struct("no", F.when(F.col("last"), F.col("text")).otherwise(
            F.substring("text", 1, chunk)).alias("text"))
        texts = chunks.join(open_rows, "row", "left_semi").groupBy("row").agg(
            F.max("doc_id").alias("doc_id"),
            F.concat_ws("", F.sort_array(F.collect_list(own))["text"]).alias("text"))
        chunk, overlap = chunk * WIDEN, overlap * WIDEN


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``, the bytes that the row's ``ids`` stand for; null ids count as none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_bytes(path)
        for batch in (b.slice(at, DECODED_ROWS) for b in batches for at in range(0, b.num_rows, DECODED_ROWS)):
            rows = [b"".join(map(tokens.__getitem__, ids.values.to_numpy().tolist())) if ids.is_valid
                    else b"" for ids in batch.column("ids")]
            bounds = np.cumsum([0, *map(len, rows)])
            data = np.frombuffer(b"".join(rows), np.uint8)
            yield batch.append_column("decoded", binary_column(data, bounds))

    decoded = StructField("decoded", BinaryType())
    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, decoded]))


@lru_cache(maxsize=2)
def token_bytes(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in read_ranks(path).items()}
