"""Documents, catalogue and extracted entities → chunk store and graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from murmur.operators import corpus, entities, graph


def chunk_store(docs: DataFrame, tiers: DataFrame, stored: DataFrame | None = None,
                identifier: str = "file") -> DataFrame:
    """New snapshot of the chunk store: stored sections stay, missing ones are added."""
    fresh = corpus.kb_chunks(docs, tiers, identifier)
    if stored is None:
        return fresh
    return stored.unionByName(corpus.new_sections(fresh, stored), allowMissingColumns=True)


def canonical_entities(project_entities: DataFrame, section_mentions: DataFrame, tags: DataFrame,
                       merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(canonical entities, decision log)."""
    raw = entities.collect_entities(project_entities, section_mentions)
    mapping = entities.case_mapping(raw)
    anchored = entities.tag_anchor(mapping, tags)
    return (entities.apply_merges(raw, anchored, merges),
            entities.decisions(mapping, anchored, merges))


def graph_tables(docs: DataFrame, tiers: DataFrame, catalogue: DataFrame, canonical: DataFrame,
                 project_entities: DataFrame, mentions: DataFrame) -> dict[str, DataFrame]:
    """Node tables and one edge table. ``canonical`` needs a ``seq`` column."""
    kept = graph.kept_sections(corpus.sensitivity_of(docs, tiers))
    walk_nodes, walk_edges = graph.walkthrough_sections(catalogue)
    sections = graph.section_nodes(kept).unionByName(walk_nodes, allowMissingColumns=True)
    edges = (graph.has_section_edges(kept).unionByName(graph.next_section_edges(kept))
             .unionByName(walk_edges)
             .unionByName(graph.project_entity_edges(project_entities, catalogue, canonical))
             .unionByName(graph.section_mention_edges(
                 mentions, sections.withColumnRenamed("id", "section_id"), catalogue)))
    return {"sections": sections, "projects": graph.project_nodes(catalogue),
            "entities": canonical, "edges": edges}
