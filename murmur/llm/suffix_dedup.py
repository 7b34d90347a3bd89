"""Removal of long passages that repeat an earlier one, by a logarithmic family of sorted suffixes.

Departure from plain suffix arrays: the levels are sorted by a hash of the leading bytes, not by
the bytes, and equality is equality of hashes, not a comparison of common prefixes. Order only
has to bring equal prefixes together; a true suffix order would need the texts wherever two
entries meet, which does not fit the disk (an entry has some 30 bytes, its suffix has no end).

Suffixes are indexed at content-defined places only: of each ``match``-byte string the suffix
that starts at its smallest ``SEED``-byte hash. Equal strings choose equal places, so two
strings are compared only if the suffixes at their places share their first ``SEED`` bytes.
A suffix keeps the range of string starts that chose it and a hash of the bytes those strings
cover. Order in the arrays is by hash of the first ``SEED`` bytes; equal prefixes are
neighbours, as in any suffix array, and slices of the order are of even size.

First pass, by slices of that order: every scan task delivers a sorted batch, which is
merge-scanned against the existing levels; of suffixes with equal neighbourhoods only the
earliest stays, levels of equal size merge geometrically. Where one prefix keeps several
neighbourhoods (the edges of repeated passages), the second pass does the same for every
single string start in them. Hashes have 112 and 96 bits; no text is compared twice.

Skew: a scan task sends one entry for each different string, whatever its number of copies,
and two at most for each prefix that it has seen with several neighbourhoods.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm.arrow import TASK_BYTES, binary_column, pieces, runs, shuffle_partitions, utf8
from murmur.session import materialize

MATCH = 100
SEED = 50
CHUNK = 1 << 20
ENTRY = np.dtype([("key", "<u8"), ("near", "<u8"), ("doc", "<i8"), ("lo", "<i8"), ("span", "<u1")])
BLOB = ("bucket int, kind int, docs binary, spans binary, keys binary, nears binary, "
        "counts binary, places binary, widths binary")
FOUND = "bucket int, kind int, docs binary, spans binary"
SPANS = "doc_id long, removed binary, open binary"
_ENTRY_COLUMNS = ["keys", "nears", "counts", "places", "widths"]
DOC = "doc_id long, n_bytes long, n_removed long, n_spans long, removed binary, kept binary"
REPEATED, OPEN = 0, 1

_BASE = 0x9E3779B97F4A7C15
_tables: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    if not _tables:
        for key, base in (("powers", _BASE), ("inverses", pow(_BASE, -1, 1 << 64))):
            t = np.full(CHUNK + 1, base, np.uint64)
            t[0] = 1
            _tables[key] = np.multiply.accumulate(t)
        _tables["bytes"] = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64) | 1
    return _tables[name]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> 31)) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> 27)) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> 33)


class _Hashes:
    """Hash of any substring of a chunk in constant time."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_table("bytes")[data] * _table("powers")[:n], out=self.sums[1:])

    def of(self, lo: np.ndarray | slice, hi: np.ndarray | slice) -> np.ndarray:
        return _mix((self.sums[hi] - self.sums[lo]) * _table("inverses")[lo])


def chunks(data: np.ndarray, bounds: np.ndarray, match: int):
    """(bytes, local bounds, first document, offset in it): documents joined up to CHUNK bytes.

    A longer document comes in parts that overlap by ``match - 1`` bytes, so that every string
    of ``match`` bytes lies in exactly one part.
    """
    at, n = 0, len(bounds) - 1
    while at < n:
        end = int(np.searchsorted(bounds, bounds[at] + CHUNK, side="right")) - 1
        if end > at:
            yield data[bounds[at]:bounds[end]], bounds[at:end + 1] - bounds[at], at, 0
            at = end
            continue
        for lo in range(0, int(bounds[at + 1] - bounds[at]) - match + 1, CHUNK - match + 1):
            part = data[bounds[at] + lo:min(bounds[at] + lo + CHUNK, bounds[at + 1])]
            yield part, np.array([0, len(part)]), at, lo
        at += 1


def anchors(data: np.ndarray, bounds: np.ndarray, match: int, seed: int):
    """Per chosen suffix: seed hash, hash of its strings, document, first and last string start."""
    starts = len(data) - match + 1
    if starts < 1:
        return None
    hashes = _Hashes(data)
    width = match - seed + 1
    h = hashes.of(slice(0, len(data) - seed + 1), slice(seed, len(data) + 1))
    # the low bits give way to the place: the minimum is the leftmost of equals and names itself
    low = np.uint64(CHUNK - 1)
    rank = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    blocks = np.full(-(-len(h) // width) * width, ~np.uint64(0))
    blocks[:len(h)] = rank
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(behind[:starts], ahead[width - 1:width - 1 + starts]) & low).astype(np.int64)
    sizes = np.diff(bounds)
    doc = np.repeat(np.arange(len(sizes)), sizes)[:starts]
    inside = np.arange(starts) + match <= np.repeat(bounds[1:], sizes)[:starts]
    change = np.ones(starts, bool)
    change[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(change & inside)
    last = np.flatnonzero(inside & np.append(change[1:] | ~inside[1:], True))
    at = place[first]
    near = hashes.of(first, last + match)
    near = _mix(near ^ ((at - first).astype(np.uint64) << np.uint64(32))
                ^ (last - first).astype(np.uint64))
    return h[at], near, doc[first], first - bounds[doc[first]], last - bounds[doc[first]]


def _entries(key, near, doc, lo, hi) -> np.ndarray:
    out = np.empty(len(key), ENTRY)
    for name, value in zip(ENTRY.names, (key, near, doc, lo, hi - lo)):
        out[name] = value
    return out


def settle(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries by key, and which of them stay: the earliest of each (key, near)."""
    e = e[np.argsort(e["key"])]
    stays = np.ones(len(e), bool)
    same = e["key"][1:] == e["key"][:-1]
    tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
    if len(tied):
        t = e[tied]
        t = t[np.lexsort((t["lo"], t["doc"], t["near"], t["key"]))]
        e[tied] = t
        stays[tied[1:]] = (t["key"][1:] != t["key"][:-1]) | (t["near"][1:] != t["near"][:-1])
    return e, stays


def _losers(e: np.ndarray, stays: np.ndarray) -> np.ndarray:
    """Entries that repeat an earlier one; a repeated row of one document repeats nothing."""
    if stays.all():
        return e[:0]
    winner = np.maximum.accumulate(np.where(stays, np.arange(len(e)), 0))
    own = (e["doc"] == e["doc"][winner]) & (e["lo"] == e["lo"][winner])
    return e[~stays & ~own]


def _crowded(e: np.ndarray) -> np.ndarray:
    """Rank of each entry among those of its key, if the key has several; else -1."""
    b = runs(e["key"])
    size = np.repeat(np.diff(b), np.diff(b))
    return np.where(size > 1, np.arange(len(e)) - np.repeat(b[:-1], np.diff(b)), -1)


class IndexFamily:
    """Sorted arrays of geometrically growing size; one entry for each (key, near)."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def add(self, batch: np.ndarray) -> list[np.ndarray]:
        """Take in a batch; returns the entries found to repeat an earlier one."""
        batch, stays = settle(batch)
        lost = [_losers(batch, stays)]
        batch = batch[stays]
        for i, level in enumerate(self.levels):
            at = np.searchsorted(level["key"], batch["key"])
            hit = level["key"][np.minimum(at, len(level) - 1)] == batch["key"]
            if not hit.any():
                continue
            ours = np.flatnonzero(hit)
            keys = np.unique(batch["key"][ours])
            lo = np.searchsorted(level["key"], keys)
            n = np.searchsorted(level["key"], keys, side="right") - lo
            theirs = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            pool = np.concatenate([batch[ours], level[theirs]])
            where = np.concatenate([ours, ~theirs])  # negative: in the level
            order = np.lexsort((pool["lo"], pool["doc"], pool["near"], pool["key"]))
            pool, where = pool[order], where[order]
            keep = np.ones(len(pool), bool)
            keep[1:] = (pool["key"][1:] != pool["key"][:-1]) | (pool["near"][1:] != pool["near"][:-1])
            if keep.all():
                continue
            lost.append(_losers(pool, keep))
            gone = where[~keep]
            batch = np.delete(batch, gone[gone >= 0])
            self.levels[i] = np.delete(level, ~gone[gone < 0])
        self.levels = [x for x in self.levels if len(x)]
        if len(batch):
            self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            self._merge()
        return lost

    def _merge(self) -> None:
        both = np.concatenate([self.levels.pop(), self.levels.pop()])
        self.levels.append(both[np.argsort(both["key"])])

    def rest(self) -> np.ndarray:
        while len(self.levels) > 1:
            self._merge()
        return self.levels[0] if self.levels else np.zeros(0, ENTRY)


def _found(e: np.ndarray, kind: int, match: int, parts: int) -> pa.RecordBatch:
    """Spans of the entries, joined where they touch: one row for each part of the documents."""
    part = (e["doc"] % parts).astype(np.int32)
    order = np.lexsort((e["lo"], e["doc"], part))
    e, part = e[order], part[order]
    doc, lo, hi = e["doc"], e["lo"], e["lo"] + e["span"] + (match if kind == REPEATED else 1)
    if len(e):
        # documents and places in one growing number: a running maximum then stays in its document
        number = np.cumsum(np.append(0, doc[1:] != doc[:-1])).astype(np.int64) << 33
        reach = np.maximum.accumulate(number + hi)
        at = np.flatnonzero(np.append(True, number[1:] + lo[1:] > reach[:-1]))
        hi = (reach - number)[np.append(at[1:], len(e)) - 1]
        doc, lo, part = doc[at], lo[at], part[at]
    b = runs(part)
    rows = [(doc[i:j].tobytes(), np.stack([lo[i:j], hi[i:j]], axis=1).astype("<u4").tobytes())
            for i, j in zip(b[:-1], b[1:])]
    n = len(rows)
    return pa.record_batch(
        [pa.array(part[b[:-1]], pa.int32()), pa.array([kind] * n, pa.int32()),
         pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())],
        ["bucket", "kind", "docs", "spans"])


def _blobs(e: np.ndarray, buckets: int, near_bytes: int) -> pa.RecordBatch:
    """Entries in documents' order, one row a bucket; places by byte planes, which compress."""
    bucket = ((e["key"] >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((e["lo"], e["doc"], bucket))
    e, bucket = e[order], bucket[order]
    b = runs(bucket)
    rows = {k: [] for k in ("docs", *_ENTRY_COLUMNS)}
    for lo, hi in zip(b[:-1], b[1:]):
        x = e[lo:hi]
        d = runs(x["doc"])
        rows["keys"].append(x["key"].tobytes())
        rows["nears"].append(x["near"].reshape(-1, 1).copy().view(np.uint8)[:, :near_bytes].tobytes())
        rows["docs"].append(x["doc"][d[:-1]].tobytes())
        rows["counts"].append(np.diff(d).astype("<u4").tobytes())
        rows["places"].append(x["lo"].astype("<u4").reshape(-1, 1).view(np.uint8).T.tobytes())
        rows["widths"].append(x["span"].tobytes())
    n = len(b) - 1
    return pa.record_batch(
        [pa.array(bucket[b[:-1]], pa.int32()), pa.nulls(n, pa.int32()),
         pa.array(rows["docs"], pa.binary()), pa.nulls(n, pa.binary()),
         *[pa.array(rows[k], pa.binary()) for k in _ENTRY_COLUMNS]],
        ["bucket", "kind", "docs", "spans", *_ENTRY_COLUMNS])


def _pass_on(found: pa.RecordBatch) -> pa.RecordBatch:
    """What a scan task has settled itself, in the form of the blobs."""
    empty = pa.nulls(found.num_rows, pa.binary())
    return pa.record_batch([*found.columns, *[empty] * 5], [*found.schema.names, *_ENTRY_COLUMNS])


def _entries_of(row: dict, near_bytes: int) -> np.ndarray:
    key = np.frombuffer(row["keys"], "<u8")
    out = np.empty(len(key), ENTRY)
    near = np.zeros((len(key), 8), np.uint8)
    near[:, :near_bytes] = np.frombuffer(row["nears"], np.uint8).reshape(-1, near_bytes)
    out["key"], out["near"] = key, near.view("<u8").ravel()
    out["doc"] = np.repeat(np.frombuffer(row["docs"], "<i8"), np.frombuffer(row["counts"], "<u4"))
    places = np.frombuffer(row["places"], np.uint8).reshape(4, -1).T.copy()
    out["lo"] = places.view("<u4").ravel()
    out["span"] = np.frombuffer(row["widths"], np.uint8)
    return out


def _low_bytes(near: np.ndarray, n: int) -> np.ndarray:
    return near & np.uint64((1 << 8 * n) - 1)


def _scan(match: int, seed: int, buckets: int, parts: int):
    """Anchors of the documents, combined inside the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, bounds = utf8(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            got = []
            for part, local, first, offset in chunks(data, bounds, match):
                if (a := anchors(part, local, match, seed)) is not None:
                    key, near, doc, lo, hi = a
                    got.append(_entries(key, _low_bytes(near, 6), ids[first + doc],
                                        lo + offset, hi + offset))
            if not got:
                continue
            e, stays = settle(np.concatenate(got))
            yield _pass_on(_found(_losers(e, stays), REPEATED, match, parts))
            e = e[stays]
            spare = _crowded(e) >= 2  # two neighbourhoods tell the others that there are several
            yield _pass_on(_found(e[spare], OPEN, match, parts))
            yield _blobs(e[~spare], buckets, 6)
    return run


def _scan_open(match: int, buckets: int, parts: int):
    """Every string start that the first pass left open."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", TASK_BYTES // 2):
            data, bounds = utf8(batch.column("text"))
            ids = batch.column("doc_id")
            got = []
            for i, spans in enumerate(batch.column("open").to_pylist()):
                spans = _pairs(spans)
                if not len(spans):
                    continue
                text = data[bounds[i]:bounds[i + 1]]
                for part, _, _, offset in chunks(text, np.array([0, len(text)]), match):
                    lo = np.clip(spans[:, 0] - offset, 0, len(part) - match + 1)
                    hi = np.clip(spans[:, 1] - offset, 0, len(part) - match + 1)
                    n = np.maximum(hi - lo, 0)
                    if not n.any():
                        continue
                    s = np.unique(np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum()))
                    hashes = _Hashes(part)
                    left = hashes.of(s, s + match // 2)
                    right = hashes.of(s + match // 2, s + match)
                    key = _mix(left ^ (right << np.uint64(23)) ^ (right >> np.uint64(41)))
                    got.append(_entries(key, _low_bytes(right, 4), ids[i].as_py(),
                                        s + offset, s + offset))
            if not got:
                continue
            e, stays = settle(np.concatenate(got))
            yield _pass_on(_found(_losers(e, stays), REPEATED, match, parts))
            yield _blobs(e[stays], buckets, 4)
    return run


def _index(match: int, near_bytes: int, opens: bool, parts: int):
    """One slice of the family: takes the batches in and reports repeats and open strings."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, pending, lost, n_pending, n_lost = IndexFamily(), [], [], 0, 0
        for batch in batches:
            done = batch.filter(batch.column("kind").is_valid())
            if done.num_rows:
                yield done.select(["bucket", "kind", "docs", "spans"])
            for row in batch.filter(batch.column("kind").is_null()).to_pylist():
                pending.append(_entries_of(row, near_bytes))
                n_pending += len(pending[-1])
                if n_pending >= 1 << 16:
                    lost += (new := family.add(np.concatenate(pending)))
                    n_lost += sum(map(len, new))
                    pending, n_pending = [], 0
                if n_lost >= 1 << 19:
                    yield _found(np.concatenate(lost), REPEATED, match, parts)
                    lost, n_lost = [], 0
        if pending:
            lost += family.add(np.concatenate(pending))
        if lost:
            yield _found(np.concatenate(lost), REPEATED, match, parts)
        if opens:
            e = family.rest()
            yield _found(e[_crowded(e) >= 0], OPEN, match, parts)
    return run


def _pairs(spans: bytes | None) -> np.ndarray:
    return np.frombuffer(spans or b"", "<u4").reshape(-1, 2).astype(np.int64)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All spans of each document in one row."""
    rows = [(r["kind"], np.frombuffer(r["docs"], "<i8"), np.frombuffer(r["spans"], "<u4"))
            for batch in batches for r in batch.to_pylist()]
    if not rows:
        return
    docs = np.concatenate([r[1] for r in rows])
    kinds = np.repeat([r[0] for r in rows], [len(r[1]) for r in rows])
    spans = np.concatenate([r[2] for r in rows]).reshape(-1, 2)
    order = np.lexsort((spans[:, 0], docs))
    docs, kinds, spans = docs[order], kinds[order], spans[order]
    names = np.unique(docs)
    columns = [binary_column(spans[kinds == kind].ravel(), 2 * np.append(
        0, np.searchsorted(docs[kinds == kind], names, side="right"))) for kind in (REPEATED, OPEN)]
    yield pa.record_batch([pa.array(names), *columns], ["doc_id", "removed", "open"])


def _join_spans(spans: np.ndarray) -> np.ndarray:
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], axis=1)


def _whole_characters(text: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Spans without the characters that they hold only in part."""
    inside = np.append((text & 0xC0) == 0x80, False)  # not the first byte of a character
    spans = spans.copy()
    for _ in range(3):
        spans[:, 0] += inside[spans[:, 0]]
        spans[:, 1] -= inside[spans[:, 1]]
    return spans[spans[:, 0] < spans[:, 1]]


def numbered(docs: DataFrame) -> DataFrame | None:
    """``doc_id, text_key, number`` if an id has several texts, else None.

    Numbers rise with the id and, under one id, with the hash of the text. Rows without an id
    have no number.
    """
    keys = docs.where(F.col("doc_id").isNotNull()).select("doc_id", text_key())
    several = keys.groupBy("doc_id").agg((F.min("text_key") < F.max("text_key")).alias("several"))
    if several.where("several").isEmpty():
        return None
    # the ids of ranges rise with the ranges, and inside one with its rows
    order = keys.distinct().repartitionByRange("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key")
    return materialize(order.withColumn("number", F.monotonically_increasing_id()), "numbers")


def text_key() -> Column:
    return F.xxhash64("text").alias("text_key")


def _cut(characters: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, bounds = utf8(batch.column("text"))
            rows = []
            for i, (first, more) in enumerate(zip(batch.column("removed").to_pylist(),
                                                  batch.column("more").to_pylist())):
                text = data[bounds[i]:bounds[i + 1]]
                spans = _join_spans(_pairs((first or b"") + (more or b"")))
                if characters and len(spans):
                    spans = _whole_characters(text, spans)
                kept = text.tobytes() if not len(spans) else b"".join(
                    text[a:b].tobytes() for a, b in
                    zip(np.append(0, spans[:, 1]), np.append(spans[:, 0], len(text))))
                rows.append((len(text), len(text) - len(kept), len(spans),
                             spans.astype("<u4").tobytes(), kept))
            yield pa.record_batch(
                [batch.column("id"), *[pa.array(c, t) for c, t in zip(
                    zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))]],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "removed", "kept"])
    return run


def remove_repeats(docs: DataFrame, match: int = MATCH, seed: int | None = None,
                   characters: bool = False) -> DataFrame:
    """Remove each byte covered by a ``match``-byte string that also starts earlier.

    Earlier is a smaller ``doc_id``, or an earlier start in the same document. Texts are taken
    as UTF-8 bytes, strings never cross documents and are judged on the input. Returns
    ``doc_id, n_bytes, n_removed, n_spans, removed`` (start and end of each removed run, unsigned
    32-bit pairs) and ``kept`` (the bytes that stay). With ``characters``, a character of which
    only some bytes are covered stays, so that ``kept`` is a text.

    A null text counts as empty. Rows whose ``doc_id`` is null come back whole and are compared
    with nothing. Rows that share ``doc_id`` and text count as copies of one row and get one
    result each; texts that share only the id are documents of their own, in the order of their
    hashes. Other columns are ignored. Texts shorter than ``match`` stay whole.
    """
    seed = seed or match // 2
    if not 8 <= seed <= match or match - seed > 255:
        raise ValueError("seed must lie between 8 and match, and match - seed below 256")
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    buckets = 4 * n
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    numbers = numbered(rows.withColumnRenamed("id", "doc_id"))
    if numbers is None:
        rows = rows.withColumn("doc_id", F.col("id"))
    else:
        known = numbers.select(F.col("doc_id").alias("id"), "text_key", F.col("number").alias("doc_id"))
        rows = rows.withColumn("text_key", text_key()).join(known, ["id", "text_key"], "left").drop("text_key")
    settled = materialize(
        rows.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= match)).select("doc_id", "text")
        .mapInArrow(_scan(match, seed, buckets, n), BLOB)
        .repartition(n, "bucket").mapInArrow(_index(match, 6, True, n), FOUND)
        .repartition(n, "bucket").mapInArrow(_gather, SPANS), "repeats")
    # one exchange of the texts serves the second pass and the cutting
    placed = rows.join(settled.withColumnRenamed("doc_id", "__d"),
                       F.col("doc_id") == F.col("__d"), "left").drop("__d")
    # all columns, so that it is the same exchange
    more = (placed.mapInArrow(_scan_open(match, buckets, n), BLOB)
            .repartition(n, "bucket").mapInArrow(_index(match, 4, False, n), FOUND)
            .repartition(n, "bucket").mapInArrow(_gather, SPANS)
            .select(F.col("doc_id").alias("__d"), F.col("removed").alias("more")))
    return (placed.join(more, F.col("doc_id") == F.col("__d"), "left")
            .select("id", "text", "removed", "more").mapInArrow(_cut(characters), DOC))
