"""Approximate nearest neighbours by cross-polytope hashing.

A table turns each unit vector by three rounds of random signs and a fast Hadamard transform
and assigns it to the nearest signed axis. A query looks into the axes next to it as well,
in every table, and all candidates found there are scored exactly. Vectors of different
lengths get one more coordinate that makes them equally long, which turns the largest inner
product into the smallest angle. Lengths are cut into geometric bands for that, each with its
own longest vector; a query looks into every band. A band with no more vectors than a query would
visit buckets for it is one bucket.

Queries whose result is short or doubtful visit several times as many buckets in a second round;
only those that even then miss rows meet all vectors.

Equal vectors are held once, with as many of their smallest ids as a result can name. A crowded
axis is cut into blocks on both sides; the blocks meet pairwise, so no task holds an axis.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.arrow import shuffle_partitions
from murmur.session import materialize

TOP = 20
TABLES = 16
PROBES = 8
BUCKET_ROWS = 64  # a table takes another hash while its buckets stay above this size
VECTORS_IN_BLOCK = 65_536
QUERIES_IN_BLOCK = 4096
SEED = 5
BAND = 2 ** 0.5  # ratio of the lengths in a band
MORE = 6  # times the buckets in the second round
TRIED, RECALL = 64, 0.95  # queries searched exactly as well, and the recall they must show
_CODES = "id long, kind int, vector binary, codes array<bigint>"
_FOUND = "query_id long, first long, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the number of columns is a power of two."""
    x = x.copy()
    step = 1
    while step < x.shape[1]:
        pairs = x.reshape(len(x), -1, 2, step)
        pairs[:, :, 0], pairs[:, :, 1] = (pairs[:, :, 0] + pairs[:, :, 1],
                                          pairs[:, :, 0] - pairs[:, :, 1])
        step *= 2
    return x / np.sqrt(x.shape[1])


def rotate(x: np.ndarray, seed: tuple[int, ...]) -> np.ndarray:
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x


def unit_rows(x: np.ndarray, longest: float | None, query: bool) -> np.ndarray:
    """Unit vectors, padded to a power of two; ``longest`` asks for the extra coordinate."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    if longest is not None:
        short = np.sqrt(np.clip(1 - (norm / longest) ** 2, 0, None))
        x = np.hstack([x / norm, np.zeros_like(norm)]) if query else np.hstack([x / longest, short])
    else:
        x = x / norm
    width = 1 << (x.shape[1] - 1).bit_length()
    return np.hstack([x, np.zeros((len(x), width - x.shape[1]))])


def buckets(x: np.ndarray, table: int, hashes: int, probes: int, seed: int) -> np.ndarray:
    """The ``probes ** hashes`` nearest buckets of each row, by axes near in each hash."""
    width = 2 * x.shape[1]
    near = []
    for h in range(hashes):
        y = rotate(x, (seed, table, h))
        signed = np.hstack([y, -y])
        axes = np.argpartition(-signed, probes - 1, axis=1)[:, :probes] if probes > 1 else \
            signed.argmax(axis=1)[:, None]
        near.append(axes)
    return np.stack([sum(near[h][:, p] * width ** h for h, p in enumerate(ps))
                     for ps in product(range(probes), repeat=hashes)], axis=1).astype(np.int64)


def _matrix(column: pa.Array, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _hash(kind: int, bands: list[tuple], whole: int, tables: int, probes: int, dtype: str,
          seed: int, more: int = 1):
    """Keys of each row; ``bands`` has ``band, longest, hashes, base`` of those that are hashed.

    A query visits about ``more`` times ``probes ** hashes`` buckets a table. All bands that are
    one bucket share the key 0.
    """
    place = {band: (longest, hashes, base) for band, longest, hashes, base in bands}

    def keys(x: np.ndarray, band: int) -> np.ndarray:
        longest, hashes, base = place[band]
        unit = unit_rows(x, longest, kind == 0)
        width = 2 * unit.shape[1]
        space = width ** hashes
        near = min(width, int(np.ceil(probes * more ** (1 / hashes)))) if kind == 0 else 1
        return np.hstack([buckets(unit, t, hashes, near, seed) + t * space
                          for t in range(tables)]) + base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("embedding").flatten().to_numpy().astype(dtype)
            x = flat.reshape(batch.num_rows, -1)
            wide = x.astype(np.float64)
            if kind == 0:
                parts = [keys(wide, band) for band in place]
                parts += [np.zeros((len(x), 1), np.int64)] if whole else []
                codes = list(np.hstack(parts))
            else:
                codes = [np.zeros(1, np.int64)] * len(x)
                own = batch.column("band").to_numpy()
                for band in set(own.tolist()) & set(place):
                    rows = np.flatnonzero(own == band)
                    for i, row in zip(rows, keys(wide[rows], band)):
                        codes[i] = row
            yield pa.record_batch(
                [batch.column("id"), pa.array(np.full(len(x), kind, np.int32)),
                 pa.array([row.tobytes() for row in x], pa.binary()),
                 pa.array(codes, pa.list_(pa.int64()))], ["id", "kind", "vector", "codes"])
    return run


def _best(found: list[tuple], top: int) -> tuple:
    """The best ``top`` different vectors of each query."""
    query, first, score = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((first, -score, query))
    query, first, score = query[order], first[order], score[order]
    new = np.ones(len(query), bool)
    new[1:] = (query[1:] != query[:-1]) | (first[1:] != first[:-1])  # a pair has one score
    query, first, score = query[new], first[new], score[new]
    start = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else []
    rank = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
    keep = rank < top
    return query[keep], first[keep], score[keep]


def _score(queries: tuple, ids: np.ndarray, x: np.ndarray, top: int) -> tuple:
    """The best ``top`` of the vectors for each query, scored in double precision."""
    query_ids, q = queries
    rough = q @ x.T
    if len(ids) > top:
        at = np.argpartition(-rough, top - 1, axis=1)[:, :top]
    else:
        at = np.broadcast_to(np.arange(len(ids)), rough.shape)
    row = np.repeat(np.arange(len(q)), at.shape[1])
    col = at.ravel()
    return query_ids[row], ids[col], (q[row] * x[col]).sum(axis=1)


def _search(top: int, dtype: str, tile: int = 1024):
    """Blocks of queries against the blocks of vectors in the same bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, queries, found, n = None, None, [], 0
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("key", "part", "share")])
            kind, ids = batch.column("kind").to_numpy(), batch.column("id").to_numpy()
            x = _matrix(batch.column("vector"), dtype).astype(np.float64)
            change = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)
                                              | (kind[1:] != kind[:-1])))
            for lo, hi in zip(change, np.append(change[1:], len(ids))):
                if place is None or tuple(keys[:, lo]) != place:
                    place, queries = tuple(keys[:, lo]), None
                if kind[lo] == 0:
                    more = ids[lo:hi], x[lo:hi]
                    queries = more if queries is None else tuple(
                        np.concatenate(c) for c in zip(queries, more))
                elif queries is not None:
                    for at in range(lo, hi, tile):
                        end = min(at + tile, hi)
                        found.append(_score(queries, ids[at:end], x[at:end], top))
                        n += len(found[-1][0])
                    if n > 1 << 20:
                        found = [_best(found, top)]
                        n = len(found[0][0])
        if found:
            yield pa.record_batch(list(map(pa.array, _best(found, top))),
                                  ["query_id", "first", "score"])
    return run


def nearest(vectors: DataFrame, queries: DataFrame, top: int = TOP, tables: int = TABLES,
            probes: int = PROBES, seed: int = SEED) -> DataFrame:
    """The ``top`` nearest vectors found for each query, by largest inner product.

    ``vectors`` and ``queries`` have ``vec_id`` and ``embedding``. Returns ``query_id, rank, vec_id,
    score``; the row of the query's own id is no candidate, ties go to the smaller id. Vectors
    that are null, zero or hold null or non-finite components take no part, neither do rows
    without an id or of another length than most vectors. Repeated rows count once. A query
    gets fewer rows only if there are fewer candidates: what the buckets leave short or
    doubtful (see ``_doubtful``) is searched in more buckets, and what is short still, exactly.
    """
    spark = vectors.sparkSession
    valid, asked = _valid(vectors), _valid(queries)
    dtype = "<f4" if "float" in dict(vectors.dtypes)["embedding"] else "<f8"
    common = (valid.groupBy(F.size("embedding").alias("n")).count()
              .orderBy(F.desc("count"), F.desc("n")).first())
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # only so many of the smallest ids of equal vectors can be in a result
    nth = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    held = materialize(
        valid.where(F.size("embedding") == common.n).distinct().withColumn("nth", nth)
        .where(F.col("nth") <= top + 1).groupBy("embedding")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .withColumn("id", F.col("ids")[0]), "vectors")
    placed = held.withColumn("norm", norm_of(F.col("embedding"))).withColumn(
        "band", F.floor(F.log("norm") / float(np.log(BAND)) + 0.25).cast("int"))
    sizes = placed.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("most"),
                                       F.min("norm").alias("least")).orderBy("band").collect()
    bands, base = [], 1
    for size in sizes:
        if size.n <= tables * probes:
            continue
        longest = size.most if size.least < size.most * (1 - 1e-3) else None
        width = 2 << (common.n + (longest is not None) - 1).bit_length()
        hashes = max(1, int(np.log(max(size.n / BUCKET_ROWS, 1)) / np.log(width)))
        bands.append((size.band, longest, hashes, base))
        base += tables * width ** hashes
    whole = len(bands) < len(sizes)

    def hashed(df: DataFrame, kind: int, more: int = 1) -> DataFrame:
        return df.mapInArrow(_hash(kind, bands, whole, tables, probes, dtype, seed, more), _CODES)

    asked = asked.where(F.size("embedding") == common.n).distinct().withColumnRenamed("vec_id", "id")
    codes = materialize(hashed(placed.select("id", "embedding", "band"), 1).union(hashed(asked, 0)), "codes")
    found = _found(codes, held, top, dtype)
    if not bands:
        return found
    found = materialize(found, "found")
    everywhere = lambda df: df.withColumn("codes", F.array(F.lit(0).cast("long")))
    whole_table = everywhere(codes.where("kind = 1"))
    lengths = materialize(asked.select("id", norm_of(F.col("embedding")).alias("norm"))
                          .groupBy("id").agg(F.max("norm").alias("norm")), "asked")
    tried = lengths.orderBy(F.xxhash64("id"), "id").limit(TRIED).select("id")
    sample = materialize(_found(whole_table.union(everywhere(codes.where("kind = 0").join(
        F.broadcast(tried), "id", "left_semi"))), held, top, dtype), "sample")
    redo = materialize(_doubtful(found, sample, lengths, top), "doubtful")
    if redo.isEmpty():
        return found
    wider = hashed(asked.join(redo, "id", "left_semi").select(*asked.columns), 0, MORE)
    again = _found(codes.where("kind = 1").union(wider), held, top, dtype)
    is_redone = F.col("query_id") == F.col("id")
    found = materialize(found.join(redo, is_redone, "left_anti").union(again), "found-again")
    rows = found.groupBy("query_id").count()
    short = materialize(redo.join(rows, is_redone, "left").where(
        F.coalesce("count", F.lit(0)) < top).select("id"), "short")
    if short.isEmpty():
        return found
    rest = _found(whole_table.union(everywhere(codes.where("kind = 0").join(short, "id", "left_semi"))),
                  held, top, dtype)
    return found.join(short, is_redone, "left_anti").union(rest)


def _doubtful(found: DataFrame, sample: DataFrame, lengths: DataFrame, top: int) -> DataFrame:
    """``id`` of the queries to search again.

    These have fewer than ``top`` rows, or a worst kept score (by the query's length) that lies
    far below the typical one or in the range where ``sample``, the exact result of some
    queries, shows a recall under ``RECALL``.
    """
    worst = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst"))
    state = lengths.join(worst, F.col("id") == F.col("query_id"), "left").select(
        "id", F.coalesce("n", F.lit(0)).alias("n"), (F.col("worst") / F.col("norm")).alias("worst"))
    low, mid = state.agg(F.percentile_approx("worst", F.array(F.lit(0.25), F.lit(0.5)))).first()[0] or (0, 0)
    hit = found.select("query_id", "vec_id", F.lit(1).alias("hit"))
    tried = (sample.join(hit, ["query_id", "vec_id"], "left").groupBy("query_id")
             .agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
             .join(state, F.col("query_id") == F.col("id")).where(F.col("worst").isNotNull())
             .orderBy("worst").select("worst", "recall").collect())
    bound = mid - 4 * (mid - low)
    for at, row in enumerate(tried):
        # the worst scores first: all up to the last start whose queries miss the recall
        if np.mean([r.recall for r in tried[:at + 1]]) < RECALL:
            bound = max(bound, tried[at + 1].worst if at + 1 < len(tried) else np.inf)
    return state.where((F.col("n") < top) | (F.col("worst") < F.lit(float(bound)))).select("id")


def _found(codes: DataFrame, held: DataFrame, top: int, dtype: str) -> DataFrame:
    """Result rows of the queries among the vectors that share a key with them."""
    spark = codes.sparkSession
    # the number of buckets bounds the rows of this table: tables times width ** hashes
    crowd = (codes.select("kind", F.explode("codes").alias("key")).groupBy("key").agg(
        F.ceil(F.count_if(F.col("kind") == 1) / VECTORS_IN_BLOCK).alias("parts"),
        F.ceil(F.count_if(F.col("kind") == 0) / QUERIES_IN_BLOCK).alias("shares"))
        .where((F.col("parts") > 0) & (F.col("shares") > 0)))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("kind") == 1, F.col("parts")).otherwise(F.col("shares")))
    other = F.explode(F.sequence(F.lit(0).cast("long"),
                                 F.when(F.col("kind") == 1, F.col("shares")).otherwise(F.col("parts")) - 1))
    met = (codes.select("id", "kind", "vector", F.explode("codes").alias("key")).join(crowd, "key")
           .withColumn("own", own).withColumn("other", other)
           .select("key", F.when(F.col("kind") == 1, F.col("own")).otherwise(F.col("other")).alias("part"),
                   F.when(F.col("kind") == 1, F.col("other")).otherwise(F.col("own")).alias("share"),
                   "kind", "id", "vector"))
    found = (met.repartition(shuffle_partitions(spark), "key", "part", "share")
             .sortWithinPartitions("key", "part", "share", "kind")
             .mapInArrow(_search(top + 1, dtype), _FOUND))
    by_query = Window.partitionBy("query_id")
    best = (found.dropDuplicates(["query_id", "first"]).withColumn(
        "nth", F.row_number().over(by_query.orderBy(F.desc("score"), "first")))
        .where(F.col("nth") <= top + 1))
    return (best.join(held.select(F.col("id").alias("first"), "ids"), "first")
            .select("query_id", F.explode("ids").alias("vec_id"), "score")
            .where(F.col("vec_id") != F.col("query_id"))
            .withColumn("rank", F.row_number().over(by_query.orderBy(F.desc("score"), "vec_id")))
            .where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score"))


def norm_of(x: Column) -> Column:
    """Length of a vector, by its largest component, so that squares neither overflow nor vanish."""
    most = F.array_max(F.transform(x, lambda v: F.abs(v.cast("double"))))
    return most * F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + (v.cast("double") / most) ** 2))


def _valid(vectors: DataFrame) -> DataFrame:
    x = F.col("embedding")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(
        F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, finite)
        & F.exists(x, lambda v: v != 0))


def exact(vectors: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """The same result by brute force, for tests and for measuring recall on small tables."""
    dot = F.aggregate(F.zip_with("q", "embedding", lambda a, b: a.cast("double") * b.cast("double")),
                      F.lit(0.0), lambda s, v: s + v)
    asked = _valid(queries).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    scored = asked.join(_valid(vectors), F.col("vec_id") != F.col("query_id")).withColumn("score", dot)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select(
        "query_id", "rank", "vec_id", "score")
