"""Nearest sections per query vector: exact, and re-ranked with graph signals.

Exact search never forms a row per (query, section) pair, and sections are never shuffled: they are
scanned in place for each block of query vectors (of bounded size, nearly always one). A task
multiplies matrices and passes on only its best rows per query; a batch of sections whose ball lies
beyond a query's worst kept hit is skipped for that query.

``sections``: section_id, embedding, sensitivity. ``queries``: query_id, embedding, tier, k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions import numeric
from murmur.operators.enrich import tier_allows, tier_rank
from murmur.scale import scan_blocks
from murmur.session import materialize

# Over-fetch, re-ranking weights and caps, probe thresholds.
FETCH_FACTOR = 4
WEIGHTS = {"semantic": 0.85, "project": 0.08, "entity": 0.05, "length": 0.02}
EARLIER_WEIGHTS = {"semantic": 0.60, "project": 0.25, "entity": 0.10, "length": 0.05}
ENTITY_CAP = 5
LONG_SECTION_CHARS = 2000
PROBE_ROWS = 100
# end of fixed values

QUERY_BYTES = 32 * 1024 * 1024  # of a block of query vectors
TILE_BYTES = 32 * 1024 * 1024
DIGITS = 9
METRICS = ("l2", "cosine", "cosine_distance")
HITS = "query_id {q}, wanted int, section_id {s}, distance double"


class _Queries:
    """Query vectors as one matrix with their limits and tiers."""

    def __init__(self, ids, vectors, limits, ranks):
        self.ids = np.asarray(ids)
        self.matrix = np.asarray(vectors, dtype=np.float64)
        self.limits = np.asarray(limits, dtype=np.int64)
        self.ranks = np.asarray(ranks, dtype=np.int64)

    def distances(self, block: np.ndarray, metric: str) -> np.ndarray:
        dots = self.matrix @ block.T
        if metric == "l2":
            squared = (np.square(self.matrix).sum(1)[:, None] + np.square(block).sum(1)[None, :]
                       - 2.0 * dots)
            return np.sqrt(np.maximum(squared, 0.0))
        norms = np.linalg.norm(self.matrix, axis=1)[:, None] * np.linalg.norm(block, axis=1)[None]
        return 1.0 - dots / np.where(norms > 0, norms, 1.0)

    def take(self, at) -> "_Queries":
        return _Queries(self.ids[at], self.matrix[at], self.limits[at], self.ranks[at])

    def reach(self, block: np.ndarray, metric: str, worst: np.ndarray) -> np.ndarray:
        """Queries to which a vector of the block may be nearer than their ``worst`` kept hit.

        No vector is nearer than the block's centre less its radius.
        """
        if not np.isfinite(worst).any():
            return np.arange(len(self.ids))
        mine, theirs = self.matrix, block
        if metric != "l2":
            mine, theirs = _units(mine), _units(theirs)
        centre = theirs.mean(0)
        radius = np.sqrt(np.square(theirs - centre).sum(1).max())
        gap = np.sqrt(np.square(mine - centre).sum(1))
        least = np.maximum(gap - radius - 1e-6 * (1 + gap + radius), 0)
        if metric != "l2":
            least = np.square(least) / 2 - 1e-6
        return np.flatnonzero(least <= worst)

    def nearest(self, ids: np.ndarray, block: np.ndarray, ranks: np.ndarray, metric: str):
        """Best (query row, vector row, distance) among one block; ties by id."""
        step = max(1, TILE_BYTES // (8 * max(len(block), 1)))
        for at in range(0, len(self.ids), step):
            for i, rows, distances in self.take(slice(at, at + step))._nearest(ids, block, ranks, metric):
                yield at + i, rows, distances

    def _nearest(self, ids: np.ndarray, block: np.ndarray, ranks: np.ndarray, metric: str):
        rough = self.distances(block, metric)
        rough[ranks[None, :] > self.ranks[:, None]] = np.inf
        # what cancellation may take from a squared distance grows with the norms
        slack = 8 * block.shape[1] * np.finfo(float).eps * (
            np.square(self.matrix).sum(1) + np.square(block).sum(1).max(initial=0.0))
        for i, limit in enumerate(self.limits):
            row = rough[i]
            usable = np.flatnonzero(np.isfinite(row))
            if not len(usable):
                continue
            if len(usable) > limit:
                edge = np.partition(row[usable], limit - 1)[limit - 1]
                if metric == "l2":
                    edge = np.sqrt(edge * edge + slack[i])
                usable = usable[row[usable] <= edge + 10.0 ** -DIGITS]
            if metric == "l2":
                exact = np.linalg.norm(block[usable] - self.matrix[i], axis=1)
            else:
                exact = row[usable]
            order = np.lexsort((ids[usable], np.round(exact, DIGITS)))[:limit]
            yield i, usable[order], exact[order]


def _units(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms > 0, norms, 1.0)


def _as_matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def _merge(best: dict, query: int, ids, distances, limit: int) -> None:
    if query in best:
        ids = np.concatenate([best[query][0], ids])
        distances = np.concatenate([best[query][1], distances])
    order = np.lexsort((ids, np.round(distances, DIGITS)))[:limit]
    best[query] = (ids[order], distances[order])


def _frame(queries: _Queries, best: dict) -> pd.DataFrame:
    if not best:
        return pd.DataFrame({"query_id": queries.ids[:0], "wanted": [], "section_id": [],
                             "distance": []})
    repeat = lambda of: np.concatenate([np.repeat(of[q], len(v[0])) for q, v in best.items()])
    return pd.DataFrame({
        "query_id": repeat(queries.ids), "wanted": repeat(queries.limits),
        "section_id": np.concatenate([v[0] for v in best.values()]),
        "distance": np.concatenate([v[1] for v in best.values()])})


def _search(batches: Iterator[pd.DataFrame], queries: _Queries, metric: str) -> pd.DataFrame:
    best: dict = {}
    worst = np.full(len(queries.ids), np.inf)
    for batch in batches:
        if not len(batch):
            continue
        ids, block = batch["section_id"].to_numpy(), _as_matrix(batch["embedding"])
        ranks = batch["tier_rank"].to_numpy(dtype=np.int64)
        near = queries.reach(block, metric, worst)
        for i, at, dist in queries.take(near).nearest(ids, block, ranks, metric):
            q = int(near[i])
            _merge(best, q, ids[at], dist, int(queries.limits[q]))
            if len(best[q][1]) == queries.limits[q]:
                worst[q] = best[q][1][-1] + 10.0 ** -DIGITS
    return _frame(queries, best)


def _candidates(sections: DataFrame, queries: DataFrame, metric: str, tier_filter: bool,
                factor: int, block_bytes: int) -> DataFrame:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    kernel_metric = "l2" if metric == "l2" else "cosine"
    rank = tier_rank(F.col("sensitivity")) if tier_filter else F.lit(0)
    s = (sections.where(F.col("embedding").isNotNull())
         .select("section_id", "embedding", rank.alias("tier_rank")))
    visitor = tier_rank(F.col("tier")) if tier_filter else F.lit(0)
    q = queries.where(F.col("embedding").isNotNull()).select(
        "query_id", "embedding", (F.col("k") * factor).cast("int").alias("limit"),
        visitor.alias("visitor_rank"), (8 * F.size("embedding") + 64).alias("__bytes"))
    schema = HITS.format(q=queries.schema["query_id"].dataType.simpleString(),
                         s=sections.schema["section_id"].dataType.simpleString())

    def pack(rows: list) -> tuple:
        return ([r["query_id"] for r in rows], np.array([r["embedding"] for r in rows], np.float64),
                [r["limit"] for r in rows], [r["visitor_rank"] for r in rows])

    def kernel(built: _Queries, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield _search(batches, built, kernel_metric)

    return scan_blocks(s, q, block_bytes, pack, lambda packed: _Queries(*packed), kernel, schema)


def score_of(distance: Column, metric: str) -> Column:
    """Each backend's own distance-to-score rule; the three must not be mixed."""
    if metric == "l2":
        return numeric.sim_from_l2(distance)
    if metric == "cosine_distance":
        return numeric.sim_from_cosine_distance(distance)
    return 1.0 - distance


def _ranked(hits: DataFrame, limit: Column, *order: Column) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def vector_topk(sections: DataFrame, queries: DataFrame, metric: str = "l2",
                tier_filter: bool = True, factor: int = 1,
                block_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, section_id, distance, score: tier filter first, then the k nearest."""
    hits = _candidates(sections, queries, metric, tier_filter, factor, block_bytes)
    out = _ranked(hits, F.col("wanted"), F.round("distance", DIGITS), F.col("section_id"))
    return out.select("query_id", "rank", "section_id", "distance",
                      score_of(F.col("distance"), metric).alias("score"))


def topk_per_query(scored: DataFrame, k: int, score: str = "score",
                   tie: str = "section_id") -> DataFrame:
    """Best k rows per query of an already scored table."""
    w = Window.partitionBy("query_id").orderBy(F.col(score).desc(), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def graph_signals(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct projects and entities per candidate section; other sections' edges are
    dropped before anything is counted."""
    wanted = candidates.select(F.col("section_id").cast("string").alias("section")).distinct()
    described = edges.where(F.col("rel") == "DESCRIBED_IN").select(
        F.col("dst").alias("section"), F.lit("p").alias("side"), F.col("src").alias("other"))
    mentioned = edges.where(F.col("rel") == "MENTIONS").select(
        F.col("src").alias("section"), F.lit("e").alias("side"),
        F.concat_ws("\u0001", "dst_kind", "dst").alias("other"))
    return (described.unionByName(mentioned).join(wanted, "section", "left_semi").distinct()
            .groupBy("section").agg(
                F.count_if(F.col("side") == "p").alias("projects_described"),
                F.count_if(F.col("side") == "e").alias("entities_mentioned")))


def _bonus_columns(weights: dict[str, Column]) -> dict[str, Column]:
    capped = F.least(F.col("entities_mentioned"), F.lit(ENTITY_CAP)).cast("double")
    return {
        "semantic_part": F.col("vector_score") * weights["semantic"],
        "project_bonus": F.when(F.col("projects_described") > 0, weights["project"]
                                ).otherwise(0.0),
        "entity_bonus": capped / ENTITY_CAP * weights["entity"],
        "length_bonus": F.when(F.col("char_count") > LONG_SECTION_CHARS, weights["length"]
                               ).otherwise(0.0)}


def hybrid_candidates(sections: DataFrame, queries: DataFrame, edges: DataFrame,
                      factor: int = FETCH_FACTOR, metric: str = "cosine") -> DataFrame:
    """k·factor nearest, then the tier filter (so fewer than k may remain), with signals."""
    near = vector_topk(sections, queries, metric, tier_filter=False, factor=factor).select(
        "query_id", "section_id", F.col("score").alias("vector_score"))
    facts = sections.select("section_id", "sensitivity", "char_count")
    tiers = queries.select("query_id", "tier", "k")
    # At most k·factor rows per query; read twice below, so the search runs once.
    allowed = materialize(near.join(facts, "section_id").join(tiers, "query_id").where(
        tier_allows(F.col("sensitivity"), F.col("tier"))), "candidates")
    signals = graph_signals(allowed, edges)
    out = allowed.join(signals, F.col("section_id").cast("string") == F.col("section"), "left")
    return out.drop("section").withColumns({
        c: F.coalesce(c, F.lit(0)) for c in ("projects_described", "entities_mentioned")})


def rerank(candidates: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Composite score with its parts, best k per query."""
    w = {n: F.lit(v) for n, v in (weights or WEIGHTS).items()}
    parts = candidates.withColumns(_bonus_columns(w)).withColumn(
        "final_score", F.col("semantic_part") + F.col("project_bonus") + F.col("entity_bonus")
        + F.col("length_bonus"))
    return _ranked(parts, F.col("k"), F.round("final_score", DIGITS).desc(), F.col("section_id"))


def hybrid_topk(sections: DataFrame, queries: DataFrame, edges: DataFrame, documents: DataFrame,
                titles: DataFrame, factor: int = FETCH_FACTOR, metric: str = "cosine",
                weights: dict[str, float] | None = None) -> DataFrame:
    """Re-ranked anchors with document, related project titles and allowed next section.

    ``documents``: doc_id, title. ``titles``: project_id, title. An anchor without a
    document is dropped, so its rank stays empty.
    """
    # k rows per query without texts; every branch below starts from them.
    top = materialize(rerank(hybrid_candidates(sections, queries, edges, factor, metric),
                             weights).withColumn("__sid", F.col("section_id").cast("string")),
                      "anchors")
    has = edges.where(F.col("rel") == "HAS_SECTION").select(
        F.col("src").alias("doc_id"), F.col("dst").alias("__sid"))
    docs = documents.select(F.col("doc_id").cast("string").alias("doc_id"),
                            F.col("title").alias("source"))
    placed = (top.join(has, "__sid").join(docs, "doc_id")
              .join(sections.select("section_id", "name", "full_text"), "section_id"))
    wanted = top.select("__sid").distinct()
    named = (edges.where(F.col("rel") == "DESCRIBED_IN")
             .select(F.col("src").alias("project_id"), F.col("dst").alias("__sid"))
             .join(wanted, "__sid", "left_semi")
             .join(titles.select(F.col("project_id").cast("string").alias("project_id"),
                                 F.col("title").alias("__title")), "project_id")
             .groupBy("__sid").agg(F.array_sort(F.collect_set("__title"))
                                   .alias("related_projects")))
    nxt = (edges.where(F.col("rel") == "NEXT_SECTION")
           .select(F.col("src").alias("__sid"), F.col("dst").alias("__next"))
           .join(wanted, "__sid", "left_semi"))
    after = sections.select(F.col("section_id").cast("string").alias("__next"),
                            F.col("sensitivity").alias("__tier"), F.col("name").alias("__name"),
                            F.col("full_text").alias("__text"))
    neighbour = nxt.join(after, "__next")
    joined = placed.join(named, "__sid", "left").join(neighbour, "__sid", "left")
    allowed = tier_allows(F.col("__tier"), F.col("tier")) & F.col("__tier").isNotNull()
    return joined.select(
        "query_id", "rank", "section_id", F.col("name").alias("section_name"), "source",
        "full_text", "sensitivity", "char_count", "vector_score", "final_score",
        "semantic_part", "project_bonus", "entity_bonus", "length_bonus",
        "projects_described", "entities_mentioned",
        F.coalesce("related_projects", F.array().cast("array<string>")).alias("related_projects"),
        F.when(allowed, F.col("__name")).alias("neighbor_name"),
        F.when(allowed, F.col("__text")).alias("neighbor_text"))


def neighbor_expand(anchors: DataFrame) -> DataFrame:
    """Neighbour name and text cleared where that section is an anchor of the query itself."""
    own = anchors.select("query_id", "source", F.col("section_name").alias("neighbor_name")
                         ).distinct().withColumn("__own", F.lit(True))
    marked = anchors.join(own, ["query_id", "source", "neighbor_name"], "left")
    keep = F.col("__own").isNull() & (F.coalesce("neighbor_text", F.lit("")) != "")
    return marked.withColumns({
        "neighbor_name": F.when(keep, F.col("neighbor_name")),
        "neighbor_text": F.when(keep, F.col("neighbor_text"))}).drop("__own")


def context_assemble(anchors: DataFrame, style: str = "hybrid") -> DataFrame:
    """One context text per query from its (at most k) ranked rows.

    hybrid: labelled blocks closed by ``---`` lines, with projects and neighbours;
    vector: ``[label]`` blocks joined by ``---``; eval: ``Source | Section`` headers.
    """
    section = F.nullif(F.col("section_name"), F.lit(""))
    label = F.concat_ws(" — ", F.col("source"), section)
    if style == "hybrid":
        described = F.when(F.size("related_projects") > 0, F.concat(
            F.lit("(Describes: "), F.array_join("related_projects", ", "), F.lit(")")))
        continued = F.when(F.col("neighbor_name").isNotNull(), F.concat(
            F.lit("[continued: "), F.col("source"), F.lit(" — "), F.col("neighbor_name"),
            F.lit("]\n"), F.col("neighbor_text")))
        block = F.concat_ws("\n", F.concat(F.lit("["), label, F.lit("]")),
                            F.coalesce("full_text", F.lit("")), described, continued,
                            F.lit("---"))
        glue = "\n"
    elif style == "vector":
        if "project_name" in anchors.columns:
            named = F.nullif(F.col("project_name"), F.lit("")).isNotNull() & section.isNotNull()
            label = F.when(named, F.concat_ws(" — ", "project_name", "section_name")
                           ).otherwise(label)
        block = F.concat(F.lit("["), label, F.lit("]\n"), F.coalesce("full_text", F.lit("")))
        glue = "\n---\n"
    elif style == "eval":
        block = F.concat(F.lit("Source: "), F.col("source"), F.lit(" | Section: "),
                         F.coalesce(section, F.lit("")), F.lit("\n"),
                         F.coalesce("full_text", F.lit("")))
        glue = "\n\n"
    else:
        raise ValueError("style must be hybrid, vector or eval")
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("b"))))
    return anchors.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda r: r["b"]), glue).alias("context"))


def source_filtered_topk(sections: DataFrame, queries: DataFrame, source: str,
                         metric: str = "l2") -> DataFrame:
    """k nearest among sections of exactly one source, with context size and tiny count."""
    inside = sections.where(F.col("source") == source)
    top = vector_topk(inside, queries, metric, tier_filter=False).join(
        inside.select("section_id", "char_count"), "section_id")
    return top.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("hits"), F.sum("char_count").alias("context_chars"),
        F.count_if(F.col("char_count") < numeric.TINY_CHARS).alias("tiny"))


def canonical_query_stats(sections: DataFrame, queries: DataFrame,
                          metric: str = "l2") -> DataFrame:
    """Per query: tiny hits, mean distance, source types in rank order."""
    top = vector_topk(sections, queries, metric, tier_filter=False).join(
        sections.select("section_id", "char_count", "source"), "section_id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(
        "rank", F.substring_index("source", ":", 1).alias("t")))), lambda r: r["t"])
    return top.groupBy("query_id").agg(
        F.count_if(F.col("char_count") < numeric.TINY_CHARS).alias("tiny"),
        numeric.exact_mean(F.col("distance"), 9).alias("avg_distance"),
        F.array_distinct(ordered).alias("source_types"))


def semantic_probe(sections: DataFrame, queries: DataFrame, rows: int = PROBE_ROWS
                   ) -> tuple[DataFrame, DataFrame]:
    """(ranked rows, verdict per query from the mean of the top three)."""
    top = vector_topk(sections, queries.withColumn("k", F.lit(rows)), "l2", tier_filter=False)
    four = F.bround("score", 4)
    verdict = (top.where(F.col("rank") <= 3).groupBy("query_id")
               .agg(numeric.exact_mean(four).alias("top3_similarity"))
               .withColumn("coverage", F.when(F.col("top3_similarity") >= numeric.STRONG_SIMILARITY, "strong")
                           .when(F.col("top3_similarity") >= numeric.GAP_SIMILARITY, "moderate")
                           .otherwise("weak")))
    return top.withColumn("similarity", four), verdict


def replay_queries(log: DataFrame, vectors: DataFrame) -> DataFrame:
    """Query parameters from log rows: tier and k come from the row."""
    return log.join(vectors, "message_key").select(
        F.col("row_id").alias("query_id"), "embedding",
        F.coalesce("audience_tier", F.lit("public")).alias("tier"),
        F.col("n_chunks_config").cast("int").alias("k"))


def rank_compare(left: DataFrame, right: DataFrame, key: str = "query_id",
                 label: str = "label") -> DataFrame:
    """Two rankings side by side; of a repeated label the best rank counts."""
    first = lambda df, name: df.groupBy(key, label).agg(F.min("rank").alias(name))
    both = first(left, "left_rank").join(first(right, "right_rank"), [key, label], "full_outer")
    drift = F.col("right_rank") - F.col("left_rank")
    state = (F.when(F.col("right_rank").isNull(), "left only")
             .when(F.col("left_rank").isNull(), "right only")
             .when(drift > 1, "promoted").when(drift < -1, "demoted").otherwise("same"))
    return both.withColumns({"drift": drift, "state": state})


def weight_sweep(candidates: DataFrame, settings: dict[str, dict[str, float]],
                 base: str) -> DataFrame:
    """Rank changes of every weight setting against the base one."""
    ranked = {name: rerank(candidates, w).select("query_id", F.col("section_id").alias("label"),
                                                 "rank") for name, w in settings.items()}
    out = None
    for name, frame in ranked.items():
        if name != base:
            part = rank_compare(ranked[base], frame).withColumn("setting", F.lit(name))
            out = part if out is None else out.unionByName(part)
    return out
