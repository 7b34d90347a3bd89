"""Registered entity and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.catalog.corpus_queries import TIER_SQL
from murmur.catalog.registry import query
from murmur.catalog.sqlparts import (CATALOGUE, DOCS, MD_SECTIONS, PROJECT_ENTITIES, PROJECT_USES,
                                     SECTION_MENTIONS, big, with_)
from murmur.operators import corpus, entities, graph
from murmur.sources import tables

BASE = with_(DOCS, CATALOGUE, PROJECT_ENTITIES, SECTION_MENTIONS)
COLLECTED = """
coll AS (SELECT kind, name, category, source, seq FROM (SELECT *, row_number() OVER (PARTITION BY kind, lower(trim(name)) ORDER BY seq) AS rn FROM (
  SELECT kind, name, category, '' AS source, seq FROM pe WHERE trim(name) <> ''
  UNION ALL SELECT kind, trim(name), '', 'kb_sections', seq FROM sm WHERE kind = 'concepts')) WHERE rn = 1)
"""
CASE_MAP = """
nm AS (SELECT kind, name AS variant, min(seq) AS seq FROM pe GROUP BY 1, 2),
cm AS (SELECT kind, variant, first_value(variant) OVER (PARTITION BY kind, lower(trim(variant)) ORDER BY length(variant) DESC, seq) AS canonical, seq FROM nm)
"""
ANCHOR = """
ta AS (SELECT kind, variant, canonical AS previous, seq, coalesce(form, canonical) AS canonical FROM cm LEFT JOIN (
  SELECT DISTINCT concat(upper(split_part(p_name, ' ', 1)[1]), split_part(p_name, ' ', 1)[2:], ' ', upper(split_part(p_name, ' ', 2)[1]), split_part(p_name, ' ', 2)[2:]) AS form
  FROM part) ON lower(canonical) = lower(form))
"""
MERGES = """
mg AS (SELECT DISTINCT kind, canonical AS from_name, replace(canonical, 'Ring', 'Band') AS to_name FROM ta WHERE contains(canonical, 'Ring'))
"""
ENT = with_(DOCS, CATALOGUE, PROJECT_ENTITIES, SECTION_MENTIONS, COLLECTED, CASE_MAP, ANCHOR, MERGES)


def _tags(spark, sf):
    return tables.table(spark, sf, "part").select(
        F.replace("p_name", F.lit(" "), F.lit("-")).alias("tag")).distinct()


def _case(spark, sf):
    return entities.case_mapping(tables.project_entities(spark, sf))


def _anchored(spark, sf):
    return entities.tag_anchor(_case(spark, sf), _tags(spark, sf))


def _merges(anchored):
    return anchored.where(F.contains("canonical", F.lit("Ring"))).select(
        "kind", F.col("canonical").alias("from_name"),
        F.replace("canonical", F.lit("Ring"), F.lit("Band")).alias("to_name")).distinct()


@query("collect_entities", ENT + "SELECT kind, name, category, source, seq FROM coll")
def collect_entities(spark, sf):
    return entities.collect_entities(tables.project_entities(spark, sf),
                                     tables.section_mentions(spark, sf))


@query("dedupe_first", ENT + """
SELECT kind, name, seq FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY seq) AS rn FROM pe) WHERE rn = 1""")
def dedupe_first(spark, sf):
    rows = tables.project_entities(spark, sf).select("kind", "name", "seq")
    return entities.dedupe_first(rows, [entities.fold(F.col("name"))])


@query("canon_case", ENT + "SELECT kind, variant, canonical FROM cm")
def canon_case(spark, sf):
    return _case(spark, sf).drop("seq")


@query("canon_tag_anchor", ENT + "SELECT kind, variant, previous, canonical FROM ta")
def canon_tag_anchor(spark, sf):
    return _anchored(spark, sf).drop("seq")


FINAL = """
fin AS (SELECT ta.kind, variant AS name, coalesce(to_name, canonical) AS final FROM ta LEFT JOIN mg ON mg.kind = ta.kind AND mg.from_name = ta.canonical),
ent AS (SELECT c.kind, final AS name, arg_min(category, seq) AS category, arg_min(source, seq) AS source,
  list_sort(coalesce(list(DISTINCT c.name) FILTER (WHERE c.name <> final), [])) AS alt_labels FROM
  (SELECT kind, name, min(seq) AS seq, arg_min(category, seq) AS category, '' AS source FROM pe GROUP BY 1, 2) c
  JOIN fin ON fin.kind = c.kind AND fin.name = c.name GROUP BY 1, 2)
"""
ENT2 = with_(DOCS, CATALOGUE, PROJECT_ENTITIES, SECTION_MENTIONS, COLLECTED, CASE_MAP, ANCHOR, MERGES, FINAL)


def _canonical(spark, sf):
    """Canonical entities of every spelling found in projects."""
    raw = tables.project_entities(spark, sf)
    spelled = entities.dedupe_first(
        raw.select("kind", "name", "category", F.lit("").alias("source"), "seq"),
        [F.col("kind"), F.col("name")])
    anchored = _anchored(spark, sf)
    return entities.apply_merges(spelled, anchored, _merges(anchored))


@query("canon_apply_merges", ENT2 + "SELECT kind, name, category, source, alt_labels FROM ent")
def canon_apply_merges(spark, sf):
    return _canonical(spark, sf)


DECISIONS = """
dec AS (SELECT 1 AS phase, kind, variant, canonical, 'case variant' AS reason FROM cm WHERE variant <> canonical
UNION ALL SELECT 2, kind, variant, canonical, 'matched catalogue tag' FROM ta WHERE previous <> canonical
UNION ALL SELECT 3, kind, from_name, to_name, 'merge' FROM mg)
"""


def _decisions(spark, sf):
    anchored = _anchored(spark, sf)
    return entities.decisions(_case(spark, sf), anchored, _merges(anchored))


@query("canon_decisions", ENT.rstrip() + ",\n" + DECISIONS.strip() + "\nSELECT * FROM dec")
def canon_decisions(spark, sf):
    return _decisions(spark, sf)


@query("canon_decision_totals", ENT.rstrip() + ",\n" + DECISIONS.strip() + f"""
SELECT phase, kind, {big('count(*)')} AS decisions FROM dec GROUP BY 1, 2""")
def canon_decision_totals(spark, sf):
    return entities.decision_totals(_decisions(spark, sf))


@query("curate_replace", ENT + """
SELECT kind, name, seq FROM coll WHERE kind <> 'concepts' UNION ALL SELECT 'concepts', p_type, min(p_partkey) FROM part GROUP BY p_type""")
def curate_replace(spark, sf):
    found = entities.collect_entities(tables.project_entities(spark, sf),
                                      tables.section_mentions(spark, sf)).select("kind", "name", "seq")
    curated = tables.table(spark, sf, "part").groupBy(F.col("p_type").alias("name")).agg(
        F.min("p_partkey").alias("seq")).withColumn("kind", F.lit("concepts"))
    return entities.curate_replace(found, curated, "concepts")


@query("concept_review_export", BASE + f"""
SELECT name, document, {big('count(*) OVER (PARTITION BY name)')} AS documents FROM (
  SELECT DISTINCT name, split_part(section_id, ':', 1) AS document FROM sm WHERE kind = 'concepts')""")
def concept_review_export(spark, sf):
    return entities.concept_review(tables.section_mentions(spark, sf))


def _numbered(spark, sf):
    """Canonical entities in catalogue order."""
    return _canonical(spark, sf).withColumn("seq", F.concat_ws("|", "kind", "name"))


LOOKUP = """
lk AS (SELECT kind, lower(label) AS lookup, arg_max(name, (concat_ws('|', kind, name), p)) AS canonical FROM (
  SELECT kind, name, unnest(list_prepend(name, alt_labels)) AS label, generate_subscripts(list_prepend(name, alt_labels), 1) AS p FROM ent) GROUP BY 1, 2)
"""
ENT3 = ENT2.rstrip() + ",\n" + LOOKUP.strip() + "\n"


@query("entity_name_lookup", ENT3 + "SELECT kind, lookup, canonical FROM lk")
def entity_name_lookup(spark, sf):
    return entities.name_lookup(_numbered(spark, sf))


@query("project_entity_edges", ENT3 + """
SELECT DISTINCT project_id AS src, CASE pe.kind WHEN 'skills' THEN 'DEMONSTRATES' WHEN 'methods' THEN 'USES_METHOD' ELSE 'USES_TECHNOLOGY' END AS rel,
  CASE pe.kind WHEN 'skills' THEN 'Skill' WHEN 'methods' THEN 'Method' ELSE 'Technology' END AS dst_kind,
  coalesce(canonical, pe.name) AS dst, CASE WHEN pe.kind <> 'technologies' THEN detail END AS detail
FROM pe LEFT JOIN lk ON lk.kind = pe.kind AND lk.lookup = lower(pe.name)
WHERE CAST(project_id AS BIGINT) IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)
  AND (pe.kind, coalesce(canonical, pe.name)) IN (SELECT (kind, name) FROM ent)""")
def project_entity_edges(spark, sf):
    known = tables.table(spark, sf, "supplier").where(F.col("s_acctbal") >= 0).select(
        F.col("s_suppkey").cast("string").alias("project_id"))
    edges = graph.project_entity_edges(tables.project_entities(spark, sf), known,
                                       _numbered(spark, sf))
    detail = F.coalesce(F.col("props")["role"], F.col("props")["stage"])
    return edges.select("src", "rel", "dst_kind", "dst", detail.alias("detail"))


MENTION_SQL = """
known AS (SELECT * FROM sm WHERE section_id IN (SELECT section_id FROM sd WHERE lang <> 'de')),
pl AS (SELECT lookup, arg_max(project_id, (g, o, p)) AS project_id FROM (
  SELECT lower(title) AS lookup, project_id, 0 AS g, "order" AS o, 0 AS p FROM cat
  UNION ALL SELECT lower(unnest(mention_keywords)), project_id, 1, "order", generate_subscripts(mention_keywords, 1) - 1 FROM cat) GROUP BY 1),
tp AS (SELECT section_id, project_id, substr(coalesce(context, ''), 1, 200) AS ctx FROM known JOIN pl ON pl.lookup = lower(trim(name)) WHERE kind = 'projects'),
me AS (SELECT DISTINCT 'Section' AS src_kind, section_id AS src, 'MENTIONS' AS rel, 'Project' AS dst_kind, project_id AS dst, ctx FROM tp
  UNION ALL SELECT DISTINCT 'Project', project_id, 'DESCRIBED_IN', 'Section', section_id, NULL FROM tp
  UNION ALL SELECT DISTINCT 'Section', section_id, 'MENTIONS', CASE kind WHEN 'skills' THEN 'Skill' ELSE 'Concept' END, trim(name), NULL
    FROM known WHERE kind IN ('skills', 'concepts') AND trim(name) <> '')
"""
GRAPH = with_(DOCS, CATALOGUE, PROJECT_ENTITIES, SECTION_MENTIONS, MENTION_SQL)


def _mention_edges(spark, sf):
    return graph.section_mention_edges(tables.section_mentions(spark, sf),
                                       tables.section_ids(spark, sf), tables.catalogue(spark, sf))


@query("section_mention_edges", GRAPH + "SELECT * FROM me")
def section_mention_edges(spark, sf):
    return _mention_edges(spark, sf).select(
        "src_kind", "src", "rel", "dst_kind", "dst", F.col("props")["context"].alias("ctx"))


@query("created_nodes", GRAPH + """
SELECT DISTINCT dst_kind AS node_kind, dst AS name FROM me WHERE dst_kind IN ('Skill', 'Concept')
  AND NOT (dst_kind = 'Skill' AND dst IN (SELECT p_name FROM part WHERE p_size < 25))""")
def created_nodes(spark, sf):
    nodes = tables.table(spark, sf, "part").where(F.col("p_size") < 25).select(
        F.lit("Skill").alias("node_kind"), F.col("p_name").alias("name"))
    return graph.created_nodes(_mention_edges(spark, sf), nodes)


@query("entity_mention_counts", GRAPH + f"""
SELECT section, {big("count(DISTINCT other) FILTER (WHERE side = 'p')")} AS projects_described,
  {big("count(DISTINCT other) FILTER (WHERE side = 'e')")} AS entities_mentioned FROM (
  SELECT dst AS section, 'p' AS side, src AS other FROM me WHERE rel = 'DESCRIBED_IN'
  UNION ALL SELECT src, 'e', concat(dst_kind, '|', dst) FROM me WHERE rel = 'MENTIONS') GROUP BY 1""")
def entity_mention_counts(spark, sf):
    return graph.entity_mention_counts(_mention_edges(spark, sf))


SIMILARITY = """
sim AS (SELECT x.kind, x.project AS a, y.project AS b, count(*) AS shared FROM uses x JOIN uses y
  ON x.kind = y.kind AND x.entity = y.entity AND x.project < y.project GROUP BY 1, 2, 3 HAVING count(*) >= 2)
"""


@query("project_similarity", with_(PROJECT_USES, SIMILARITY) + f"""
SELECT coalesce(m.a, t.a) AS a, coalesce(m.b, t.b) AS b, {big('m.shared')} AS shared_methods, {big('t.shared')} AS shared_technologies,
  CASE WHEN m.shared IS NOT NULL THEN 'methods' ELSE 'technologies' END AS basis
FROM (SELECT * FROM sim WHERE kind = 'methods') m FULL JOIN (SELECT * FROM sim WHERE kind = 'technologies') t ON m.a = t.a AND m.b = t.b""")
def project_similarity(spark, sf):
    return graph.project_similarity(tables.project_uses(spark, sf))


@query("projects_sharing_with", with_(PROJECT_USES) + f"""
SELECT y.project, {big('count(*)')} AS shared_count FROM uses x JOIN uses y ON x.kind = y.kind AND x.entity = y.entity
WHERE x.project = '7' AND y.project <> '7' GROUP BY 1""")
def projects_sharing_with(spark, sf):
    return graph.projects_sharing_with(tables.project_uses(spark, sf), "7")


@query("projects_by_entity_keyword", with_(PROJECT_ENTITIES) + """
SELECT DISTINCT project_id AS project FROM pe WHERE kind IN ('skills', 'methods') AND (contains(lower(name), 'anvil') OR contains(lower(name), 'hot gear'))""")
def projects_by_entity_keyword(spark, sf):
    uses = tables.project_entities(spark, sf).select(
        F.col("project_id").alias("project"), "kind", F.col("name").alias("entity"))
    return graph.projects_by_entity_keyword(uses, ["skills", "methods"], ["Anvil", "hot gear"])


# --- nodes -----------------------------------------------------------------

def _files(spark, sf):
    return tables.documents(spark, sf).select(
        F.concat(F.lit("kb_"), F.col("source"), F.lit("-"), F.col("lang"), F.lit("_"),
                 F.col("doc_id"), F.lit(".md")).alias("file_name"), "source_type", "text")


@query("build_document_nodes", with_(DOCS) + f"""
SELECT concat('kb_', source, '-', lang, '_', doc_id) AS id, source_type, concat('kb_', source, '-', lang, '_', doc_id, '.md') AS file_path,
  concat('S', source[2:], ' ', upper(lang[1]), lang[2:], ' ', doc_id) AS title, {TIER_SQL} AS sensitivity, sha256(text) AS content_hash FROM docs""")
def build_document_nodes(spark, sf):
    return graph.document_nodes(_files(spark, sf), tables.tiers(spark))


KEPT = with_(DOCS, MD_SECTIONS, f"""
kept AS (SELECT concat(doc_id, ':', section_name) AS id, doc_id, section_name, msec.text, section_order, {TIER_SQL} AS sensitivity
  FROM msec JOIN docs USING (doc_id) WHERE length(msec.text) >= 50)""")


def _kept(spark, sf):
    docs = corpus.sensitivity_of(tables.markdown_docs(spark, sf), tables.tiers(spark))
    return graph.kept_sections(docs)


@query("build_section_nodes", KEPT + """
SELECT id, arg_max(section_name, section_order) AS name, arg_max(text, section_order) AS full_text,
  arg_max(sensitivity, section_order) AS sensitivity, max(section_order) AS "order",
  CAST(length(arg_max(text, section_order)) AS INT) AS char_count FROM kept GROUP BY id""")
def build_section_nodes(spark, sf):
    return graph.section_nodes(_kept(spark, sf))


@query("has_section_edges", KEPT + "SELECT DISTINCT CAST(doc_id AS VARCHAR) AS src, 'HAS_SECTION' AS rel, id AS dst FROM kept")
def has_section_edges(spark, sf):
    return graph.has_section_edges(_kept(spark, sf)).select("src", "rel", "dst")


@query("next_section", KEPT + """
SELECT DISTINCT id AS src, 'NEXT_SECTION' AS rel, nxt AS dst FROM (
  SELECT id, lead(id) OVER (PARTITION BY doc_id ORDER BY section_order) AS nxt FROM kept) WHERE nxt IS NOT NULL""")
def next_section(spark, sf):
    return graph.next_section_edges(_kept(spark, sf)).select("src", "rel", "dst")


@query("build_project_nodes", with_(CATALOGUE) + """
SELECT project_id AS id, title, summary, design_insight, walkthrough_context, tags, 'public' AS sensitivity FROM cat""")
def build_project_nodes(spark, sf):
    return graph.project_nodes(tables.catalogue(spark, sf)).drop("diagram_filename")


@query("build_walkthrough_sections", with_(CATALOGUE) + """
SELECT concat('project-walkthrough:', project_id) AS id, concat(title, ' — Walkthrough') AS name, "order", 'public' AS sensitivity,
  concat_ws(chr(10) || chr(10), concat(title, ': ', summary), CASE WHEN design_insight <> '' THEN concat('What makes it distinctive: ', design_insight) END,
    walkthrough_context, concat('Tags: ', array_to_string(tags, ', '))) AS full_text FROM cat WHERE walkthrough_context <> ''""")
def build_walkthrough_sections(spark, sf):
    nodes, _ = graph.walkthrough_sections(tables.catalogue(spark, sf))
    return nodes.drop("char_count")


@query("walkthrough_edges", with_(CATALOGUE) + """
SELECT 'Document' AS src_kind, 'project-walkthroughs' AS src, 'HAS_SECTION' AS rel, concat('project-walkthrough:', project_id) AS dst FROM cat WHERE walkthrough_context <> ''
UNION ALL SELECT 'Project', project_id, 'DESCRIBED_IN', concat('project-walkthrough:', project_id) FROM cat WHERE walkthrough_context <> ''""")
def walkthrough_edges(spark, sf):
    _, edges = graph.walkthrough_sections(tables.catalogue(spark, sf))
    return edges.select("src_kind", "src", "rel", "dst")


@query("build_entity_nodes", with_(PROJECT_ENTITIES) + """
SELECT kind, name, arg_max(category, seq) AS category FROM pe GROUP BY 1, 2""")
def build_entity_nodes(spark, sf):
    rows = tables.project_entities(spark, sf)
    return entities.entity_nodes(*[rows.where(F.col("kind") == k)
                                   for k in entities.PROJECT_KINDS]).select(
        "kind", "name", "category")


@query("graph_summary", GRAPH + f"""
SELECT dst_kind AS label, {big('count(DISTINCT dst)')} AS count FROM me GROUP BY 1
UNION ALL SELECT 'Relationships', {big('count(*)')} FROM me""")
def graph_summary(spark, sf):
    edges = _mention_edges(spark, sf)
    nodes = edges.select(F.col("dst_kind").alias("node_kind"), "dst").distinct()
    return graph.graph_summary(nodes, edges)


@query("ingest_summary", with_(DOCS) + f"""
SELECT source_type, {big('count(DISTINCT source)')} AS documents, {big('count(*)')} AS sections, {big('count_if(vec_id IS NULL)')} AS unembedded
FROM docs LEFT JOIN embeddings ON vec_id = doc_id GROUP BY 1""")
def ingest_summary(spark, sf):
    v = tables.table(spark, sf, "embeddings").select(F.col("vec_id").alias("d"), "embedding")
    docs = tables.documents(spark, sf)
    return graph.ingest_summary(docs.join(v, docs.doc_id == v.d, "left").select(
        "source_type", F.col("source").alias("doc_id"), "embedding"))


@query("dq_unique_keys", f"SELECT text, {big('count(*)')} AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def dq_unique_keys(spark, sf):
    return graph.duplicate_keys(tables.documents(spark, sf), ["text"])


@query("dq_vocab", with_(DOCS) + f"""
SELECT field, term, {big('count(*)')} AS rows FROM (SELECT 'lang' AS field, lang AS term FROM docs UNION ALL SELECT 'source_type', source_type FROM docs)
WHERE (field, term) NOT IN (VALUES ('lang', 'en'), ('lang', 'fr'), ('source_type', 'notes-public')) GROUP BY 1, 2""")
def dq_vocab(spark, sf):
    vocabulary = spark.sql("SELECT * FROM VALUES ('lang', 'en'), ('lang', 'fr'), "
                           "('source_type', 'notes-public') AS t(field, term)")
    return graph.outside_vocabulary(tables.documents(spark, sf), ["lang", "source_type"], vocabulary)
