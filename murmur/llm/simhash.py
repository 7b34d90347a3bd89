"""Near-duplicates by SimHash: tiled exact comparison of fingerprints.

A fingerprint has one or more 64-bit words. Different fingerprints are dealt into tiles by a
kind, such that fingerprints to be linked have kinds that differ by one of a few steps. By
default the kind is made of the population counts of the quarters of one word: two fingerprints
differ in at least as many bits as these counts do, so tile pairs whose counts differ by more
than the radius are skipped without loss. The others are compared exactly, by exclusive-or and
bit counts, in the same way skipping slices whose whole counts are too far apart. A tile pair
passes on a forest of its links, never all of them, so a large group of near copies stays
linear. ``similar_groups`` takes such links as candidates only and compares the shingle sets.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm.arrow import pieces, utf8
from murmur.llm.components import components
from murmur.session import materialize

SHINGLE = 3
RADIUS = 3
TILE = 1024
WIDE_TILE = 8192  # where kinds are few and crowded, larger tiles meet fewer others
BASE = 32
PRINTS = "doc_id long, fingerprint binary, n_shingles long"
_PAIRS = "a binary, b binary"
NODE = 16  # bytes of the digest that stands for a set of shingles
BLOCK_BYTES = 1 << 20  # of shingle hashes that a task compares with as many others
_SET_PRINTS = "doc_id long, text_key long, fingerprint binary, n_shingles long, shingles binary"


def fingerprint(words: list[bytes], shingle: int, seeds: tuple[int, ...],
                repeats: bool = True) -> tuple[bytes, int]:
    """Bits set in over half of the shingles' hashes, one big-endian word a seed; shingles."""
    import xxhash

    if not words:
        return bytes(8 * len(seeds)), 0
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    last = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    shingles = [text[a:b] for a, b in zip(starts[:len(last)].tolist(), last.tolist())]
    if not repeats:
        shingles = list(set(shingles))
    out = b""
    for seed in seeds:
        digests = b"".join([xxhash.xxh64_digest(s, seed) for s in shingles])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        out += np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(shingles)).tobytes()
    return out, len(shingles)


def _fingerprints(shingle: int, seeds: tuple[int, ...], repeats: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, bounds = utf8(batch.column("text"))
            data = data.tobytes().lower()
            got = [fingerprint(data[a:b].split(), shingle, seeds, repeats)
                   for a, b in itertools.pairwise(bounds.tolist())]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([g[0] for g in got], pa.binary()),
                 pa.array([g[1] for g in got], pa.int64())],
                ["doc_id", "fingerprint", "n_shingles"])
    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seeds: tuple[int, ...] = (42,),
                 repeats: bool = True) -> DataFrame:
    """``doc_id, fingerprint, n_shingles`` of every whole text.

    A-Z are lower-cased; words are what lies between spaces, tabs and line ends; the hash of a
    shingle (its words joined by spaces) is XXH64 with each of ``seeds``. ``repeats`` tells
    whether a shingle counts as often as it occurs. Fewer words than a shingle count as one; a
    null or wordless text has the fingerprint zero.
    """
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(_fingerprints(shingle, seeds, repeats), PRINTS))


def quarter_counts(fingerprint: Column) -> Column:
    """Population counts of the quarters of the first word, as one number."""
    word = F.conv(F.hex(F.substring(fingerprint, 1, 8)), 16, -10).cast("long")
    return sum((F.bit_count(F.shiftrightunsigned(word, 16 * q).bitwiseAND(F.lit(0xFFFF)))
                * BASE ** q for q in range(4)), F.lit(0)).cast("int")


def quarter_steps(radius: int) -> list[int]:
    """Differences of quarter counts that may lie within the radius, one of each +- pair."""
    steps = itertools.product(range(-radius, radius + 1), repeat=4)
    return sorted(sum(x * BASE ** q for q, x in enumerate(s)) for s in steps
                  if sum(map(abs, s)) <= radius and s >= (0,) * 4)


def _tiles(prints: DataFrame, tile: int) -> DataFrame:
    """Tiles of different fingerprints: ``kind, part, prints``."""
    rows = prints.select("fingerprint", "kind").distinct()
    # parts of about half a tile by a hash; a kind has as many as its rows need. There are at
    # most 17 ** 4 kinds of quarter counts, and a hundred of sizes.
    size = rows.groupBy(F.col("kind").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.xxhash64("fingerprint"), F.ceil(2 * F.col("n") / tile)).cast("int")
    return (rows.join(F.broadcast(size), F.col("kind") == F.col("k")).withColumn("part", part)
            .groupBy("kind", "part").agg(F.listagg("fingerprint").alias("prints")))


def _array(prints: bytes, width: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of the joined fingerprints of ``width`` bytes, and their population counts."""
    rows = np.frombuffer(prints, np.uint8).reshape(-1, width)[:, :8 * words]
    x = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    return x, np.bitwise_count(x).sum(axis=1, dtype=np.int64)


def links_between(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs that differ in at most ``radius`` bits."""
    differ = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]).astype(np.int16)
    for w in range(1, a.shape[1]):
        differ += np.bitwise_count(a[:, None, w] ^ b[None, :, w])
    return np.nonzero(differ <= radius)


def forest(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Smallest member reached by each of ``n`` nodes over the given links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _compare(radius: int, words: int, width: int, slice_rows: int = 256):
    """Links of tile pairs, as a forest over the members of each pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for own, other in zip(batch.column("own"), batch.column("other")):
                own, other = own.as_py(), other.as_py()
                members = own + (other or b"")
                a, n_a = _array(own, width, words)
                b, n_b = (a, n_a) if other is None else _array(other, width, words)
                order_a, order_b = np.argsort(n_a, kind="stable"), np.argsort(n_b, kind="stable")
                sorted_b, n_b = b[order_b], n_b[order_b]
                for at in range(0, len(a), slice_rows):
                    rows = order_a[at:at + slice_rows]
                    lo = np.searchsorted(n_b, n_a[rows[0]] - radius)
                    hi = np.searchsorted(n_b, n_a[rows[-1]] + radius, side="right")
                    if lo == hi:
                        continue
                    x, y = links_between(a[rows], sorted_b[lo:hi], radius)
                    x, y = rows[x], order_b[lo + y] + (0 if other is None else len(a))
                    x, y = x[x != y], y[x != y]
                    if not len(x):
                        continue
                    used, number = np.unique(np.concatenate([x, y]), return_inverse=True)
                    root = forest(number[:len(x)], number[len(x):], len(used))
                    node = np.flatnonzero(root != np.arange(len(used)))
                    left += [members[i * width:(i + 1) * width] for i in used[node]]
                    right += [members[i * width:(i + 1) * width] for i in used[root[node]]]
            yield pa.record_batch([pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                                  ["a", "b"])
    return run


def links(prints: DataFrame, radius: int, steps: list[int], words: int = 1,
          width: int | None = None, tile: int = TILE) -> DataFrame:
    """``a, b``: links that join all fingerprints within ``radius`` bits of one another.

    ``prints`` has ``fingerprint``, of ``width`` bytes (those after the words tell equal words
    apart), and ``kind``; only kinds that differ by one of ``steps`` (not below 0) are compared.
    """
    tiles = materialize(_tiles(prints, tile), "tiles")
    names = tiles.select("kind", "part")
    asked = names.select(
        F.col("kind").alias("kind_a"), F.col("part").alias("part_a"),
        F.explode(F.array(*[F.lit(s) for s in steps])).alias("step"))
    pairs = asked.withColumn("kind_b", F.col("kind_a") + F.col("step")).drop("step").join(
        names.toDF("kind_b", "part_b"), "kind_b").where(
        (F.col("kind_a") != F.col("kind_b")) | (F.col("part_a") <= F.col("part_b")))
    same = (F.col("kind_a") == F.col("kind_b")) & (F.col("part_a") == F.col("part_b"))
    return (pairs.join(tiles.toDF("kind_a", "part_a", "own"), ["kind_a", "part_a"])
            .join(tiles.toDF("kind_b", "part_b", "other"), ["kind_b", "part_b"])
            .select("own", F.when(~same, F.col("other")).alias("other"))
            .mapInArrow(_compare(radius, words, width or 8 * words), _PAIRS).distinct())


def groups(prints: DataFrame, radius: int, steps: list[int], words: int = 1,
           width: int | None = None, tile: int = TILE) -> DataFrame:
    """``prints`` with ``component_id``: the smallest ``doc_id`` reachable over links."""
    first = materialize(prints.groupBy("fingerprint", "kind").agg(F.min("doc_id").alias("first")),
                        "prints")
    named = first.where(F.col("first").isNotNull()).select("fingerprint", "first")
    found = (links(first, radius, steps, words, width, tile)
             .join(named.toDF("a", "first_a"), "a").join(named.toDF("b", "first_b"), "b"))
    whole = components(found, "first_a", "first_b")
    member = (first.join(whole, F.col("first") == F.col("node"), "left")
              .select(F.col("fingerprint").alias("__f"),
                      F.coalesce("component", "first").alias("component_id")))
    return prints.join(member, F.col("fingerprint") == F.col("__f")).drop("__f", "kind")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, n_shingles, component_id`` for each document.

    Fingerprints of one word link if at most ``radius`` bits differ; the component is the
    smallest ``doc_id`` reachable, the document's own included. Rows with a null ``doc_id`` get
    the component of their fingerprint, null if it holds no other row. Repeated rows each come
    back. Other columns are ignored.
    """
    prints = materialize(fingerprints(docs, shingle), "fingerprints").withColumn(
        "kind", quarter_counts(F.col("fingerprint")))
    return groups(prints, radius, quarter_steps(radius))


def similarity_radius(similarity: float, bits: int) -> int:
    """Differing bits that two shingle sets of that similarity practically never exceed.

    Sets of equal size with Jaccard J lie at an angle of arccos(2 J / (1 + J)); that share of pi
    is the expected share of differing bits. Five standard deviations more are allowed, since
    majorities of few shingles differ more often (at 4 of 5 shingles, 0.19 of the bits instead
    of 0.15, which leaves three).
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * share + 5 * math.sqrt(bits * share * (1 - share)))


def _set_prints(shingle: int, seeds: tuple[int, ...], with_set: bool):
    """Fingerprints of the different shingles, followed by a digest of their hashes."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, bounds = utf8(batch.column("text"))
            data = data.tobytes().lower()
            prints, sizes, nodes, sets = [], [], [], []
            for a, b in itertools.pairwise(bounds.tolist()):
                words = data[a:b].split()
                parts = {b" ".join(words[i:i + shingle])
                         for i in range(max(len(words) - shingle + 1, min(len(words), 1)))}
                out = b""
                for seed in seeds:
                    raw = b"".join([xxhash.xxh64_digest(s, seed) for s in parts])
                    rows = np.frombuffer(raw, np.uint8).reshape(-1, 8)
                    ones = np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
                    out += np.packbits(2 * ones > len(parts)).tobytes()
                    if seed == seeds[0]:
                        held = np.sort(np.frombuffer(raw, ">u8").astype("<u8")).tobytes()
                prints.append(out)
                nodes.append(hashlib.blake2b(held, digest_size=NODE).digest())
                sizes.append(len(parts))
                sets.append(held if with_set else None)
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("text_key"),
                 pa.array([f + n for f, n in zip(prints, nodes)], pa.binary()),
                 pa.array(sizes, pa.int64()), pa.array(sets, pa.binary())],
                ["doc_id", "text_key", "fingerprint", "n_shingles", "shingles"])
    return run


def _verify(similarity: float, radius: int, words: int):
    """Links of block pairs whose shingle sets are as similar as asked, as a forest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for own, other in zip(batch.column("own"), batch.column("other")):
                rows = own.as_py() + (other.as_py() or [])
                split = len(own) if other.is_valid else 0
                rows_a = np.arange(split or len(rows))
                prints = b"".join(r["fingerprint"] for r in rows)
                x = _array(prints, 8 * words + NODE, words)[0]
                sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
                size = np.array(list(map(len, sets)))
                codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
                start = np.cumsum(size) - size
                here = np.zeros(codes.max(initial=0) + 1, bool)
                found_a, found_b = [], []
                for a in rows_a:
                    b = np.arange(split or a + 1, len(rows))
                    small, big = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
                    b = b[small >= similarity * big - 1e-6]
                    b = b[np.bitwise_count(x[a] ^ x[b]).sum(axis=1, dtype=np.int64) <= radius]
                    if not len(b) or not size[a]:
                        continue
                    mine = codes[start[a]:start[a] + size[a]]
                    here[mine] = True
                    last = np.cumsum(size[b])
                    at = np.arange(last[-1]) + np.repeat(start[b] - (last - size[b]), size[b])
                    common = np.add.reduceat(here[codes[at]], last - size[b], dtype=np.int64)
                    here[mine] = False
                    b = b[common / (size[a] + size[b] - common) >= similarity]
                    found_a.append(np.full(len(b), a))
                    found_b.append(b)
                if not found_a:
                    continue
                root = forest(np.concatenate(found_a), np.concatenate(found_b), len(rows))
                for i in np.flatnonzero(root != np.arange(len(rows))):
                    left.append(rows[i]["fingerprint"][-NODE:])
                    right.append(rows[root[i]]["fingerprint"][-NODE:])
            yield pa.record_batch([pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                                  ["a", "b"])
    return run


def _verified(docs: DataFrame, first: DataFrame, candidates: DataFrame, shingle: int,
              seeds: tuple[int, ...], similarity: float, radius: int) -> DataFrame:
    """``a, b``: links between nodes whose shingle sets have the similarity.

    The members of each group of candidates are cut into blocks, and the blocks of a group meet
    pairwise with their sets, so no row exists for a pair of members.
    """
    rough = components(candidates, "a", "b")
    member = materialize(rough.select("node", F.col("component").alias("rough")).union(
        rough.select("component", "component").distinct()), "members")
    asked = first.join(member, "node").select(F.col("first").alias("doc_id")).distinct()
    sets = (docs.join(asked, "doc_id", "left_semi")
            .mapInArrow(_set_prints(shingle, seeds, True), _SET_PRINTS)
            .withColumn("node", F.substring("fingerprint", 8 * len(seeds) + 1, NODE))
            .select("node", "fingerprint", "shingles").dropDuplicates(["node"])
            .join(member, "node").drop("node"))
    sets = materialize(sets, "sets")
    size = sets.groupBy(F.col("rough").alias("r")).agg(
        F.ceil(F.sum(F.length("shingles")) / BLOCK_BYTES).cast("int").alias("parts"))
    size = materialize(size.withColumn("parts", F.greatest("parts", F.lit(1))), "sizes")
    blocks = materialize(
        sets.join(size, F.col("rough") == F.col("r"))
        .withColumn("part", F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int"))
        .groupBy("rough", "part")
        .agg(F.collect_list(F.struct("fingerprint", "shingles")).alias("members")), "blocks")
    pairs = size.select(F.col("r").alias("rough"), "parts", F.explode(
        F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(
        "rough", "part", F.explode(F.sequence("part", F.col("parts") - 1)).alias("part_b"))
    return (pairs.join(blocks.withColumnRenamed("members", "own"), ["rough", "part"])
            .join(blocks.toDF("rough", "part_b", "other"), ["rough", "part_b"])
            .select("own", F.when(F.col("part") != F.col("part_b"), F.col("other")).alias("other"))
            .mapInArrow(_verify(similarity, radius, len(seeds)), _PAIRS).distinct())


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8,
                   words: int = 4) -> DataFrame:
    """``doc_id, text_key, fingerprint, n_shingles, component_id``: groups of near copies.

    Documents link if their sets of different shingles (by 64-bit hashes) have a Jaccard of at
    least ``similarity``. Fingerprints of the sets, in ``words`` words, find candidates up to
    ``similarity_radius``; the sets themselves decide. Sets whose sizes differ by more than the
    factor cannot be that similar, so the kind is the size on a logarithmic scale and only
    neighbouring kinds are compared. ``text_key`` is XXH64 of the text; special cases as in
    ``near_duplicates``.
    """
    seeds, radius = tuple(range(42, 42 + words)), similarity_radius(similarity, 64 * words)
    width = 8 * words + NODE
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.xxhash64("text").alias("text_key"), "text")
    prints = materialize(keyed.mapInArrow(_set_prints(shingle, seeds, False), _SET_PRINTS)
                         .drop("shingles"), "fingerprints")
    kind = F.floor(F.log(F.greatest("n_shingles", F.lit(1))) / -math.log(similarity)).cast("int")
    node = F.substring("fingerprint", 8 * words + 1, NODE)
    first = materialize(prints.where(F.col("doc_id").isNotNull()).withColumn("kind", kind)
                        .groupBy("fingerprint", "kind").agg(F.min("doc_id").alias("first"))
                        .withColumn("node", node), "prints")
    near = links(first, radius, [0, 1], words, width, WIDE_TILE).select(
        *[F.substring(c, 8 * words + 1, NODE).alias(c) for c in ("a", "b")])
    whole = components(_verified(keyed, first, near, shingle, seeds, similarity, radius))
    member = materialize(
        first.select("node", "first").join(whole, "node", "left")
        .select("first", F.col("node").alias("__n"), F.coalesce("component", "node").alias("c")),
        "members")
    least = member.groupBy("c").agg(F.min("first").alias("component_id"))
    named = member.join(least, "c").select("__n", "component_id")
    return prints.join(named, node == F.col("__n"), "left").drop("__n")
