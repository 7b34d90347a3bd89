"""Approximate nearest sections: an inverted file of trained cells.

Centres come from k-means over a bounded sample of the sections; every section lies in the cell of
its nearest centre. How many cells a query visits is not guessed: the exact answers of sample
queries are looked up, and the least number of cells that holds the wanted share of them is taken.
Each cell knows its radius, so a search can also be completed: cells whose ball comes no nearer
than the worst kept hit cannot hold a better one.

Work is dealt by shards, runs of cells of bounded size; a crowded cell is dealt over several. A query
goes to the shards of its cells only, and only matrices of (queries of a cell, its sections) are
multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.operators import vectors
from murmur.operators.enrich import tier_rank
from murmur.session import materialize

CELLS_PER_ROOT = 16  # cells: so many times the root of the sections, half the sections at most
MOST_CELLS = 65_536
TRAIN_ROWS = 64  # sampled sections for each centre
TUNE_QUERIES = 500  # sample queries that the number of visited cells is measured on
TARGET = 0.95
SHARD_ROWS = 20_000


@dataclass
class Cells:
    """An index: centres with radii and sizes (bounded by ``MOST_CELLS``) and the placed sections."""

    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray
    unit: bool  # vectors are scaled to length one, for cosine
    placed: DataFrame  # section_id, embedding, sensitivity, cell
    probes: int = 0
    recall: float = 0.0  # on the sample queries

    def scaled(self, matrix: np.ndarray) -> np.ndarray:
        if not self.unit:
            return matrix
        return vectors._units(matrix)

    def gaps(self, matrix: np.ndarray) -> np.ndarray:
        """Distance of every row to every centre."""
        m = self.scaled(matrix)
        squared = np.square(m).sum(1)[:, None] + np.square(self.centres).sum(1) - 2.0 * m @ self.centres.T
        return np.sqrt(np.maximum(squared, 0.0))


def _tiles(frame: pd.DataFrame, width: int) -> Iterator[pd.DataFrame]:
    step = max(1, vectors.TILE_BYTES // (8 * max(width, 1)))
    for at in range(0, len(frame), step):
        yield frame.iloc[at:at + step]


def _usable(df: DataFrame) -> DataFrame:
    return df.where(F.col("embedding").isNotNull())


def _train(sections: DataFrame, n_cells: int, unit: bool, seed: int) -> np.ndarray:
    rows = sections.count()
    if not rows:
        return np.zeros((0, 1))
    share = min(1.0, n_cells * TRAIN_ROWS / rows)
    draw = F.pmod(F.xxhash64("section_id", F.lit(seed)), F.lit(1 << 20))
    vector = F.transform("embedding", lambda v: v.cast("double"))
    if unit:
        norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, v: a + v * v))
        vector = F.transform(vector, lambda v: v / F.when(norm > 0, norm).otherwise(1.0))
    # k-means wants more different vectors than centres
    sample = materialize(sections.where(draw < int(share * (1 << 20)) + 1).select(
        vector.alias("v")).distinct(), "centre-sample")
    if sample.count() <= n_cells:
        return np.array([r["v"] for r in sample.collect()])
    features = sample.select(array_to_vector("v").alias("features"))
    model = KMeans(k=max(2, n_cells), maxIter=8, initMode="random", seed=seed).fit(features)
    return np.array(model.clusterCenters())


def place(sections: DataFrame, centres: np.ndarray, unit: bool) -> DataFrame:
    """Sections with their cell and the distance to its centre."""
    shape = Cells(centres, np.zeros(0), np.zeros(0), unit, sections)
    shared = sections.sparkSession.sparkContext.broadcast(shape.centres)
    kept = sections.select("section_id", "embedding", "sensitivity")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema) + ", cell int, gap double"

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Cells(shared.value, np.zeros(0), np.zeros(0), unit, None)
        for batch in batches:
            for part in _tiles(batch, len(own.centres)):
                gaps = own.gaps(vectors._as_matrix(part["embedding"]))
                cell = gaps.argmin(1)
                yield part.assign(cell=cell.astype(np.int32), gap=gaps[np.arange(len(part)), cell])

    return kept.mapInPandas(assign, schema)


def train_cells(sections: DataFrame, queries: DataFrame, metric: str = "l2", n_cells: int | None = None,
                target: float = TARGET, seed: int = 1) -> Cells:
    """An index whose number of visited cells is set by its recall on a sample of ``queries``."""
    sections, unit = _usable(sections), metric != "l2"
    rows = sections.count()
    n_cells = n_cells or min(MOST_CELLS, int(CELLS_PER_ROOT * rows ** 0.5), max(rows // 2, 1))
    index = _indexed(sections, _train(sections, n_cells, unit, seed), unit)
    if len(index.centres):
        index.probes, index.recall = _measured(index, queries, metric, target, seed)
    return index


def pivots(sections: DataFrame, n: int) -> np.ndarray:
    """A reproducible spread of sections to act as centres."""
    chosen = (_usable(sections).orderBy(F.md5(F.col("section_id").cast("string")), "section_id").limit(n)
              .select("embedding").collect())
    return np.array([r["embedding"] for r in chosen], np.float64) if chosen else np.zeros((0, 1))


def cells_of(sections: DataFrame, centres: np.ndarray, probes: int, metric: str = "l2") -> Cells:
    """An index of given centres and number of visited cells; nothing is trained or measured."""
    index = _indexed(_usable(sections), centres, metric != "l2")
    index.probes = probes
    return index


def _indexed(sections: DataFrame, centres: np.ndarray, unit: bool) -> Cells:
    if not len(centres):
        empty = sections.select("section_id", "embedding", "sensitivity", F.lit(0).alias("cell"))
        return Cells(centres, np.zeros(0), np.zeros(0, np.int64), unit, empty)
    placed = materialize(place(sections, centres, unit), "cells")
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("r")).toPandas()
    radii, sizes = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    radii[stats["cell"]], sizes[stats["cell"]] = stats["r"], stats["n"]
    return Cells(centres, radii, sizes, unit, placed.drop("gap"))


def _measured(index: Cells, queries: DataFrame, metric: str, target: float, seed: int) -> tuple[int, float]:
    """The least number of cells that holds the target's share of the exact answers.

    The target is raised by two standard errors of the sample, so that queries outside the
    sample may be expected to reach it.
    """
    queries = _usable(queries)
    share = TUNE_QUERIES / max(queries.count(), 1)
    draw = F.pmod(F.xxhash64("query_id", F.lit(seed)), F.lit(1 << 20))
    sample = materialize(queries.where(draw < int(min(share, 1.0) * (1 << 20)) + 1).select(
        "query_id", "embedding", "tier", "k"), "tune")
    exact = vectors.vector_topk(index.placed, sample, metric)
    found = (exact.join(index.placed.select("section_id", "cell"), "section_id")
             .join(sample.select("query_id", "embedding"), "query_id").select("cell", "embedding"))
    centres, unit = index.centres, index.unit

    def place_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Cells(centres, np.zeros(0), np.zeros(0), unit, None)
        for batch in batches:
            for part in _tiles(batch, len(centres)):
                gaps = own.gaps(vectors._as_matrix(part["embedding"]))
                mine = gaps[np.arange(len(part)), part["cell"]]
                yield pd.DataFrame({"place": (gaps < mine[:, None]).sum(1) + 1})

    places = found.mapInPandas(place_of, "place int").groupBy("place").count().orderBy("place").toPandas()
    total = int(places["count"].sum())
    if not total:
        return len(centres), 1.0
    wanted = min(1.0, target + 2 * (target * (1 - target) / total) ** 0.5)
    reached = places["count"].cumsum() / total
    at = int(np.searchsorted(reached.to_numpy(), wanted - 1e-12))
    return int(places["place"].iloc[at]), float(reached.iloc[at])


# --- search ---------------------------------------------------------------------------

def _slots(index: Cells) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts of every cell, its first slot, and the shard of every slot."""
    parts = np.maximum(1, -(-index.sizes // SHARD_ROWS))
    first = np.cumsum(parts) - parts
    rows = np.repeat(index.sizes / parts, parts)
    return parts, first, (np.cumsum(rows) // SHARD_ROWS).astype(np.int64)


class _Probing(vectors._Queries):
    """Queries that look into some slots only; sections come sorted by slot."""

    def __init__(self, ids, matrix, limits, ranks, looks: list[set], bounds: np.ndarray, slots: np.ndarray):
        super().__init__(ids, matrix, limits, ranks)
        self.looks, self.bounds, self.slots = looks, bounds, slots

    def distances(self, block: np.ndarray, metric: str) -> np.ndarray:
        out = np.full((len(self.ids), len(block)), np.inf)
        for slot, lo, hi in zip(self.slots, self.bounds[:-1], self.bounds[1:]):
            at = [i for i, look in enumerate(self.looks) if slot in look]
            if at:
                some = vectors._Queries(self.ids[at], self.matrix[at], self.limits[at], self.ranks[at])
                out[at, lo:hi] = some.distances(block[lo:hi], metric)
        return out

    def take(self, at) -> vectors._Queries:
        picked = np.arange(len(self.ids))[at]
        return _Probing(self.ids[picked], self.matrix[picked], self.limits[picked], self.ranks[picked],
                        [self.looks[i] for i in picked], self.bounds, self.slots)


def _hits(index: Cells, probes: DataFrame, queries: DataFrame, metric: str) -> DataFrame:
    """Best rows of each query in each shard; ``probes``: query_id, shard, slots."""
    kernel = "l2" if metric == "l2" else "cosine"
    parts, first, shard_of = _slots(index)
    spark = queries.sparkSession
    schema = vectors.HITS.format(q=queries.schema["query_id"].dataType.simpleString(),
                                 s=index.placed.schema["section_id"].dataType.simpleString())
    if not len(parts):
        return spark.createDataFrame([], schema)
    table = spark.createDataFrame(pd.DataFrame({
        "cell": np.arange(len(parts)), "parts": parts, "first": first}), "cell int, parts bigint, first bigint")
    slots = F.col("first") + F.pmod(F.xxhash64("section_id"), "parts")
    shards = spark.createDataFrame(pd.DataFrame({"slot": np.arange(len(shard_of)), "shard": shard_of}),
                                   "slot bigint, shard bigint")
    sections = (index.placed.join(table, "cell").select(
        "section_id", "embedding", tier_rank(F.col("sensitivity")).alias("tier_rank"), slots.alias("slot"))
        .join(shards, "slot"))
    asked = probes.join(queries.select("query_id", "embedding", F.col("k").cast("int").alias("limit"),
                                       tier_rank(F.col("tier")).alias("visitor_rank")), "query_id")
    def search(rows: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("slot", kind="stable")
        slot = rows["slot"].to_numpy()
        bounds = np.concatenate([np.flatnonzero(np.diff(slot, prepend=-1)), [len(slot)]]).astype(np.int64)
        probing = _Probing(q["query_id"].to_numpy(), vectors._as_matrix(q["embedding"]) if len(q) else
                           np.zeros((0, 1)), q["limit"].to_numpy(), q["visitor_rank"].to_numpy(),
                           [set(s) for s in q["slots"]], bounds, slot[bounds[:-1]])
        if not len(rows) or not len(q):
            return vectors._frame(probing, {})
        return vectors._search(iter([rows]), probing, kernel)

    return sections.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(search, schema)


def _probes(index: Cells, queries: DataFrame, choose) -> DataFrame:
    """``query_id, shard, slots`` for the cells that ``choose(batch, gaps)`` marks."""
    parts, first, shard_of = _slots(index)
    centres, unit = index.centres, index.unit
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, shard bigint, slots array<bigint>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Cells(centres, np.zeros(0), np.zeros(0), unit, None)
        for batch in batches:
            for part in _tiles(batch, len(centres)):
                marked = choose(part, own.gaps(vectors._as_matrix(part["embedding"])))
                out = []
                for query, cells in zip(part["query_id"], marked):
                    slots = np.concatenate([np.arange(first[c], first[c] + parts[c]) for c in
                                            np.flatnonzero(cells)] or [np.zeros(0, np.int64)])
                    for shard in np.unique(shard_of[slots]):
                        out.append((query, shard, slots[shard_of[slots] == shard]))
                yield pd.DataFrame(out, columns=["query_id", "shard", "slots"])

    return queries.mapInPandas(run, schema)


def _nearest_cells(gaps: np.ndarray, n: int) -> np.ndarray:
    mark = np.zeros(gaps.shape, bool)
    np.put_along_axis(mark, np.argsort(gaps, axis=1, kind="stable")[:, :n], True, axis=1)
    return mark


def _ranked(hits: DataFrame, metric: str) -> DataFrame:
    out = vectors._ranked(hits, F.col("wanted"), F.round("distance", vectors.DIGITS), F.col("section_id"))
    return out.select("query_id", "rank", "section_id", "distance",
                      vectors.score_of(F.col("distance"), metric).alias("score"))


def _found(index: Cells, queries: DataFrame, metric: str, n: int) -> DataFrame:
    probes = _probes(index, queries.select("query_id", "embedding"), lambda part, gaps: _nearest_cells(gaps, n))
    return _hits(index, probes, queries, metric)


def approx_topk(index: Cells, queries: DataFrame, metric: str = "l2", probes: int | None = None) -> DataFrame:
    """The k nearest sections in each query's closest cells, as many as the index measured."""
    return _ranked(_found(index, _usable(queries), metric, probes or index.probes), metric)


def bounded_topk(index: Cells, queries: DataFrame, metric: str = "l2") -> DataFrame:
    """The exact k nearest: closest cells first, then those whose ball may hold something nearer."""
    queries = _usable(queries)
    first = materialize(_found(index, queries, metric, index.probes), "first-hits")
    kept = vectors._ranked(first, F.col("wanted"), F.round("distance", vectors.DIGITS), F.col("section_id"))
    edge = kept.groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) == F.max("wanted"), F.max("distance")).alias("edge"))
    again = queries.select("query_id", "embedding").join(edge, "query_id", "left")
    probes, radii, sizes, unit = index.probes, index.radii, index.sizes, index.unit

    def open_cells(part: pd.DataFrame, gaps: np.ndarray) -> np.ndarray:
        worst = part["edge"].fillna(np.inf).to_numpy(np.float64)
        if unit:  # distances are one less the cosine; those of unit vectors are its root
            worst = np.sqrt(2 * np.maximum(worst, 0))
        slack = 1e-6 * (1 + gaps)
        return (gaps - radii <= worst[:, None] + slack) & ~_nearest_cells(gaps, probes) & (sizes > 0)

    rest = _hits(index, _probes(index, again, open_cells), queries, metric)
    return _ranked(first.unionByName(rest), metric)


def recall(exact: DataFrame, approx: DataFrame) -> DataFrame:
    """Share of the exact hits the approximate search found."""
    hit = approx.select("query_id", "section_id").withColumn("__hit", F.lit(1))
    return exact.join(hit, ["query_id", "section_id"], "left").agg(
        F.count(F.lit(1)).alias("exact_hits"), F.count("__hit").alias("found")).withColumn(
        "recall", F.col("found") / F.col("exact_hits"))
