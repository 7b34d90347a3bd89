"""Registered retrieval queries: every benchmark item against every section."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.catalog.registry import query
from murmur.catalog.sqlparts import (COS_ORDER, DOCS, L2_ORDER, L2_SCORE, LOG, SECTIONS, SIGNALS,
                                     big, rerank_cte, topk_cte, with_)
from murmur.operators import inverted, vectors
from murmur.sources import tables

BASE = (DOCS, SECTIONS)
CAND = topk_cte("cand", COS_ORDER, 20)
TOP = rerank_cte("top", "cand", 0.85, 0.08, 0.05, 0.02)


def _inputs(spark, sf):
    return tables.sections(spark, sf), tables.query_vectors(spark, sf)


def _shown(df):
    return df.select("query_id", "rank", "section_id", F.round("score", 6).alias("score"))


@query("vector_topk", with_(*BASE, topk_cte("top", L2_ORDER, 5, "tr <= qr")) + f"""
SELECT query_id, rank, section_id, round({L2_SCORE}, 6) AS score FROM top""")
def vector_topk(spark, sf):
    return _shown(vectors.vector_topk(*_inputs(spark, sf)))


@query("vector_topk_blocks", with_(*BASE, topk_cte("top", L2_ORDER, 5, "tr <= qr")) + f"""
SELECT query_id, rank, section_id, round({L2_SCORE}, 6) AS score FROM top""")
def vector_topk_blocks(spark, sf):
    """More query vectors than a block holds."""
    return _shown(vectors.vector_topk(*_inputs(spark, sf), block_bytes=9_000))


@query("vector_topk_cosine_distance", with_(*BASE, topk_cte("top", COS_ORDER, 5, "tr <= qr")) + """
SELECT query_id, rank, section_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, cosine)), 6) AS score FROM top""")
def vector_topk_cosine_distance(spark, sf):
    return _shown(vectors.vector_topk(*_inputs(spark, sf), metric="cosine_distance"))


@query("topk_per_query", with_(LOG) + """
SELECT query_id, section_id, CAST(rank AS INT) AS rank FROM (SELECT provider AS query_id, row_id AS section_id,
  row_number() OVER (PARTITION BY provider ORDER BY chunk_similarity_avg DESC, row_id) AS rank FROM chats
  WHERE chunk_similarity_avg IS NOT NULL) WHERE rank <= 10""")
def topk_per_query(spark, sf):
    scored = tables.chat_log(spark, sf).where(F.col("chunk_similarity_avg").isNotNull()).select(
        F.col("provider").alias("query_id"), F.col("row_id").alias("section_id"),
        F.col("chunk_similarity_avg").alias("score"))
    return vectors.topk_per_query(scored, 10).select("query_id", "section_id", "rank")


def _hybrid(spark, sf):
    sections, queries = _inputs(spark, sf)
    return vectors.hybrid_topk(sections, queries, tables.section_edges(spark, sf),
                               tables.section_documents(spark, sf),
                               tables.section_projects(spark, sf))


PLACED = """
placed AS (SELECT top.*, concat('Doc ', parent) AS src_title,
  CASE WHEN section_id % 3 = 0 THEN [concat('Project ', section_id % 12)] ELSE [] END AS related_projects,
  CASE WHEN n.section_id IS NOT NULL AND n.tr <= top.qr THEN n.name END AS nb_name, CASE WHEN n.section_id IS NOT NULL AND n.tr <= top.qr THEN n.full_text END AS nb_text
  FROM top LEFT JOIN (SELECT section_id AS nid, section_id, name, full_text, tr FROM sec) n ON top.section_id % 8 < 7 AND n.nid = top.section_id + 1
  WHERE parent % 7 <> 3)
""".replace("top.section_id % 8 < 7", "top.section_id % 8 < 7").replace(
    "CASE WHEN section_id % 3 = 0", "CASE WHEN top.section_id % 3 = 0").replace(
    "section_id % 12)] ELSE", "top.section_id % 12)] ELSE")


@query("hybrid_topk", with_(*BASE, CAND, SIGNALS, TOP, PLACED) + """
SELECT query_id, rank, section_id, name AS section_name, src_title AS source, round(final_score, 6) AS final_score,
  round(cosine, 6) AS vector_score, related_projects, nb_name AS neighbor_name FROM placed""")
def hybrid_topk(spark, sf):
    return _hybrid(spark, sf).select(
        "query_id", "rank", "section_id", "section_name", "source",
        F.round("final_score", 6).alias("final_score"),
        F.round("vector_score", 6).alias("vector_score"), "related_projects", "neighbor_name")


@query("hybrid_explain", with_(*BASE, topk_cte("cand", COS_ORDER, 10), SIGNALS, TOP, PLACED) + f"""
SELECT query_id, rank, section_id, round(semantic_part, 6) AS semantic_part, project_bonus, round(entity_bonus, 6) AS entity_bonus,
  length_bonus, {big('projects_described')} AS projects_described, {big('entities_mentioned')} AS entities_mentioned FROM placed""")
def hybrid_explain(spark, sf):
    sections, queries = _inputs(spark, sf)
    return vectors.hybrid_topk(
        sections, queries, tables.section_edges(spark, sf), tables.section_documents(spark, sf),
        tables.section_projects(spark, sf), factor=2).select(
        "query_id", "rank", "section_id", F.round("semantic_part", 6).alias("semantic_part"),
        "project_bonus", F.round("entity_bonus", 6).alias("entity_bonus"), "length_bonus",
        "projects_described", "entities_mentioned")


EXPANDED = """
ex AS (SELECT p.*, CASE WHEN a.query_id IS NULL AND coalesce(nb_text, '') <> '' THEN nb_name END AS neighbor_name,
  CASE WHEN a.query_id IS NULL AND coalesce(nb_text, '') <> '' THEN nb_text END AS neighbor_text
  FROM placed p LEFT JOIN (SELECT DISTINCT query_id, src_title, name FROM placed) a
    ON a.query_id = p.query_id AND a.src_title = p.src_title AND a.name = p.nb_name)
"""
EX = with_(*BASE, CAND, SIGNALS, TOP, PLACED, EXPANDED)


@query("neighbor_expand", EX + "SELECT query_id, rank, section_id, neighbor_name, neighbor_text FROM ex")
def neighbor_expand(spark, sf):
    return vectors.neighbor_expand(_hybrid(spark, sf)).select(
        "query_id", "rank", "section_id", "neighbor_name", "neighbor_text")


@query("context_assemble", EX + """
SELECT query_id, string_agg(concat('[', src_title, ' — ', name, ']', chr(10), full_text,
  CASE WHEN len(related_projects) > 0 THEN concat(chr(10), '(Describes: ', array_to_string(related_projects, ', '), ')') ELSE '' END,
  CASE WHEN neighbor_name IS NOT NULL THEN concat(chr(10), '[continued: ', src_title, ' — ', neighbor_name, ']', chr(10), neighbor_text) ELSE '' END,
  chr(10), '---'), chr(10) ORDER BY rank) AS context FROM ex GROUP BY 1""")
def context_assemble(spark, sf):
    return vectors.context_assemble(vectors.neighbor_expand(_hybrid(spark, sf)))


VEC = with_(*BASE, topk_cte("vt", L2_ORDER, 5, "tr <= qr"))


def _vector_rows(spark, sf):
    sections, queries = _inputs(spark, sf)
    facts = sections.select("section_id", F.col("name").alias("section_name"), "source",
                            "full_text", "char_count")
    return vectors.vector_topk(sections, queries).join(facts, "section_id")


@query("context_vector", VEC + """
SELECT query_id, string_agg(concat('[', source, ' — ', name, ']', chr(10), full_text), chr(10) || '---' || chr(10) ORDER BY rank) AS context
FROM vt GROUP BY 1""")
def context_vector(spark, sf):
    return vectors.context_assemble(_vector_rows(spark, sf), "vector")


@query("context_eval", VEC + """
SELECT query_id, string_agg(concat('Source: ', source, ' | Section: ', name, chr(10), full_text), chr(10) || chr(10) ORDER BY rank) AS context
FROM vt GROUP BY 1""")
def context_eval(spark, sf):
    return vectors.context_assemble(_vector_rows(spark, sf), "eval")


@query("source_filtered_topk", with_(*BASE, topk_cte("st", L2_ORDER, 5, "source = 'notes-public:src4'")) + f"""
SELECT query_id, {big('count(*)')} AS hits, {big('sum(char_count)')} AS context_chars, {big('count_if(char_count < 150)')} AS tiny FROM st GROUP BY 1""")
def source_filtered_topk(spark, sf):
    return vectors.source_filtered_topk(*_inputs(spark, sf), "notes-public:src4")


@query("canonical_query_stats", with_(*BASE, topk_cte("ct", L2_ORDER, 5)) + f"""
SELECT query_id, {big('count_if(char_count < 150)')} AS tiny, round(avg(distance), 6) AS avg_distance,
  (SELECT list(t ORDER BY r) FROM (SELECT split_part(source, ':', 1) AS t, min(rank) AS r FROM ct c2 WHERE c2.query_id = ct.query_id GROUP BY 1)) AS source_types
FROM ct GROUP BY query_id""")
def canonical_query_stats(spark, sf):
    out = vectors.canonical_query_stats(*_inputs(spark, sf))
    return out.withColumn("avg_distance", F.round("avg_distance", 6))


@query("semantic_probe", with_(*BASE, topk_cte("pt", L2_ORDER, 3)) + f"""
SELECT query_id, round(t, 4) AS top3, CASE WHEN t >= 0.75 THEN 'strong' WHEN t >= 0.55 THEN 'moderate' ELSE 'weak' END AS coverage
FROM (SELECT query_id, avg(round({L2_SCORE}, 4)) AS t FROM pt GROUP BY 1)""")
def semantic_probe(spark, sf):
    _, verdict = vectors.semantic_probe(*_inputs(spark, sf))
    return verdict.select("query_id", F.round("top3_similarity", 4).alias("top3"), "coverage")


@query("semantic_probe_rows", with_(*BASE, topk_cte("pt", L2_ORDER, 100)) + f"""
SELECT query_id, rank, section_id, round({L2_SCORE}, 4) AS similarity FROM pt""")
def semantic_probe_rows(spark, sf):
    rows, _ = vectors.semantic_probe(*_inputs(spark, sf))
    return rows.select("query_id", "rank", "section_id", F.round("score", 4).alias("similarity"))


@query("replay_from_log", with_(*BASE, LOG, """
lastq AS (SELECT item_id, arg_max(row_id, row_id) AS row_id FROM chats JOIN benchmark ON item_id = row_id * 7 % (SELECT count(*) FROM benchmark) GROUP BY 1),
rq AS (SELECT c.row_id AS query_id, CAST(embedding AS DOUBLE[]) AS qe, CASE audience_tier WHEN 'public' THEN 0 WHEN 'personal' THEN 1 ELSE 2 END AS qr,
  n_chunks_config AS k FROM lastq JOIN chats c USING (row_id) JOIN embeddings ON vec_id = lastq.item_id)""") + """
SELECT query_id, CAST(rank AS INT) AS rank, section_id FROM (SELECT query_id, k, section_id,
  row_number() OVER (PARTITION BY query_id ORDER BY round(list_distance(e, qe), 9), section_id) AS rank FROM rq CROSS JOIN sec WHERE tr <= qr) WHERE rank <= k""")
def replay_from_log(spark, sf):
    sections, _ = _inputs(spark, sf)
    bank = tables.query_vectors(spark, sf).select(F.col("text").alias("message"),
                                                  F.col("query_id").alias("message_key"), "embedding")
    log = tables.chat_log(spark, sf, message=True)
    keyed = log.join(bank.select("message", "message_key"), "message")
    latest = keyed.groupBy("message_key").agg(F.max_by(
        F.struct("row_id", "audience_tier", "n_chunks_config"), "row_id").alias("r")).select(
        "message_key", "r.*")
    queries = vectors.replay_queries(latest, bank.select("message_key", "embedding"))
    return vectors.vector_topk(sections, queries).select("query_id", "rank", "section_id")


DRIFT = """SELECT coalesce(l.query_id, r.query_id) AS query_id, coalesce(l.section_id, r.section_id) AS label, l.rank AS left_rank, r.rank AS right_rank,
  r.rank - l.rank AS drift, CASE WHEN r.rank IS NULL THEN 'left only' WHEN l.rank IS NULL THEN 'right only' WHEN r.rank - l.rank > 1 THEN 'promoted'
  WHEN r.rank - l.rank < -1 THEN 'demoted' ELSE 'same' END AS state FROM {left} l FULL JOIN {right} r ON l.query_id = r.query_id AND l.section_id = r.section_id"""


@query("rank_compare", with_(*BASE, CAND, SIGNALS, TOP, topk_cte("vt", L2_ORDER, 5, "tr <= qr"))
       + DRIFT.format(left="top", right="vt"))
def rank_compare(spark, sf):
    sections, queries = _inputs(spark, sf)
    hybrid = vectors.rerank(vectors.hybrid_candidates(sections, queries,
                                                      tables.section_edges(spark, sf)))
    label = lambda df: df.select("query_id", "rank", F.col("section_id").alias("label"))
    return vectors.rank_compare(label(hybrid), label(vectors.vector_topk(sections, queries)))


@query("weight_sweep", with_(*BASE, CAND, SIGNALS, TOP, rerank_cte("old", "cand", 0.60, 0.25, 0.10, 0.05))
       + "SELECT *, 'earlier' AS setting FROM (" + DRIFT.format(left="top", right="old") + ")")
def weight_sweep(spark, sf):
    sections, queries = _inputs(spark, sf)
    cand = vectors.hybrid_candidates(sections, queries, tables.section_edges(spark, sf))
    return vectors.weight_sweep(cand, {"current": vectors.WEIGHTS,
                                       "earlier": vectors.EARLIER_WEIGHTS}, "current")


def _trained(spark, sf, metric="l2"):
    sections, queries = _inputs(spark, sf)
    return inverted.train_cells(sections, queries, metric), sections, queries


@query("approx_topk")
def approx_topk(spark, sf):
    """Trained cells; what k-means finds has no SQL, ``approx_recall`` holds it against the exact search."""
    index, _, queries = _trained(spark, sf)
    return _shown(inverted.approx_topk(index, queries))


@query("approx_topk_all_cells", with_(*BASE, topk_cte("top", L2_ORDER, 5, "tr <= qr"))
       + "SELECT query_id, rank, section_id FROM top")
def approx_topk_all_cells(spark, sf):
    """Visiting every cell must give the exact answer."""
    index, _, queries = _trained(spark, sf)
    return inverted.approx_topk(index, queries, probes=len(index.centres)).select(
        "query_id", "rank", "section_id")


@query("bounded_topk", with_(*BASE, topk_cte("top", L2_ORDER, 5, "tr <= qr")) + f"""
SELECT query_id, rank, section_id, round({L2_SCORE}, 6) AS score FROM top""")
def bounded_topk(spark, sf):
    """The radii of the cells make the answer of the nearest ones exact."""
    index, _, queries = _trained(spark, sf)
    return _shown(inverted.bounded_topk(index, queries))


CELLS = """
piv AS (SELECT * FROM (SELECT e AS c, row_number() OVER (ORDER BY md5(CAST(section_id AS VARCHAR)), section_id) - 1 AS cell FROM sec) WHERE cell < 16),
own AS (SELECT section_id, arg_min(cell, list_dot_product(c, c) / 2 - list_dot_product(e, c)) AS cell FROM sec CROSS JOIN piv GROUP BY 1),
probe AS (SELECT query_id, cell FROM (SELECT query_id, cell, row_number() OVER (
  PARTITION BY query_id ORDER BY list_dot_product(c, c) / 2 - list_dot_product(qe, c), cell) AS r FROM q CROSS JOIN piv) WHERE r <= 8),
near AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), section_id) AS INT) AS rank
  FROM pairs JOIN own USING (section_id) JOIN probe USING (query_id, cell) WHERE tr <= qr)
"""


@query("approx_recall", with_(*BASE, topk_cte("top", L2_ORDER, 5, "tr <= qr"), CELLS) + f"""
SELECT {big('count(*)')} AS exact_hits, {big('count(n.rank)')} AS found, count(n.rank) / count(*) AS recall, true AS reached, true AS quarter
FROM top t LEFT JOIN (SELECT query_id, section_id, rank FROM near WHERE rank <= 5) n USING (query_id, section_id)""")
def approx_recall(spark, sf):
    """Exact hits found in 8 of 16 given cells, and whether at least 0.95 of them are found in at most a quarter of the
    trained ones."""
    index, sections, queries = _trained(spark, sf)
    exact = vectors.vector_topk(sections, queries)
    share = inverted.recall(exact, inverted.approx_topk(index, queries))
    given = inverted.cells_of(sections, inverted.pivots(sections, 16), probes=8)
    return inverted.recall(exact, inverted.approx_topk(given, queries)).crossJoin(share.select(
        (F.col("recall") >= inverted.TARGET).alias("reached"),
        F.lit(4 * index.probes <= len(index.centres)).alias("quarter")))
