"""Registered corpus-preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.catalog.registry import query
from murmur.catalog.sqlparts import (DOCS, LINE_CHUNKS, MD_DOCS, MD_SECTIONS, SQUASH, big,
                                     chunk_ctes, merge_ctes, with_, with_recursive)
from murmur.functions import text
from murmur.operators import corpus
from murmur.session import scratch_dir
from murmur.sources import section_store, tables

TIER_SQL = "CASE source_type WHEN 'notes-personal' THEN 'personal' WHEN 'notes-inner' THEN 'inner_circle' ELSE 'public' END"
PARA_DOCS = DOCS.strip() + ",\npd AS (SELECT * REPLACE (replace(text, chr(10), chr(10) || chr(10)) AS text) FROM docs)"


@query("sensitivity_of", with_(DOCS) + f"""
SELECT doc_id, source_type, {TIER_SQL} AS sensitivity FROM docs""")
def sensitivity_of(spark, sf):
    return corpus.sensitivity_of(tables.documents(spark, sf), tables.tiers(spark)).select(
        "doc_id", "source_type", "sensitivity")


@query("tier_predicate", with_(DOCS) + f"""
SELECT doc_id, visitor FROM (SELECT doc_id, {TIER_SQL} AS t, CASE lang WHEN 'en' THEN 'public' WHEN 'fr' THEN 'personal'
  WHEN 'de' THEN 'inner_circle' ELSE 'someone' END AS visitor FROM docs)
WHERE list_position(['public', 'personal', 'inner_circle'], t) <= coalesce(list_position(['public', 'personal', 'inner_circle'], visitor), 1)""")
def tier_predicate(spark, sf):
    from murmur.operators import enrich
    docs = corpus.sensitivity_of(tables.documents(spark, sf), tables.tiers(spark))
    visitor = (F.when(F.col("lang") == "en", "public").when(F.col("lang") == "fr", "personal")
               .when(F.col("lang") == "de", "inner_circle").otherwise("someone"))
    return docs.withColumn("visitor", visitor).where(
        enrich.tier_allows(F.col("sensitivity"), F.col("visitor"))).select("doc_id", "visitor")


@query("build_chunk_metadata", with_(DOCS, LINE_CHUNKS) + f"""
SELECT id, source, section, chunk_index, CASE WHEN section = 'part 0' THEN 'personal' ELSE {TIER_SQL} END AS sensitivity,
  CAST(char_count AS VARCHAR) AS chars_attr FROM lc""")
def build_chunk_metadata(spark, sf):
    rows = tables.line_chunks(spark, sf).withColumns({
        "source_type": text.source_type_of(F.col("source")),
        "ident": text.source_id_of(F.col("source")),
        "explicit": F.when(F.col("section") == "part 0", "personal")})
    return corpus.chunk_metadata(rows, tables.tiers(spark), "ident", "section",
                                 {"chars": F.col("char_count")}, "explicit").select(
        "id", "source", "section", "chunk_index", "sensitivity",
        F.col("attrs")["chars"].alias("chars_attr"))


@query("split_paragraphs", with_(PARA_DOCS) + f"""
SELECT doc_id, CAST(generate_subscripts(ps, 1) - 1 AS INT) AS paragraph_index, unnest(ps) AS paragraph FROM (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: {SQUASH}), lambda p: p <> '') AS ps FROM pd)""")
def split_paragraphs(spark, sf):
    return corpus.split_paragraphs(tables.paragraph_docs(spark, sf))


@query("chunk_paragraphs", with_recursive(PARA_DOCS, chunk_ctes("pd", "doc_id", 900, 100)) + """
SELECT key AS doc_id, CAST(k AS INT) AS chunk_index, text, CAST(s AS INT) AS para_start, CAST(e AS INT) AS para_end,
  CAST(length(text) AS INT) AS char_count FROM ch""")
def chunk_paragraphs(spark, sf):
    return corpus.chunk(tables.paragraph_docs(spark, sf), ["doc_id"])


@query("merge_tiny_chunks", with_recursive(PARA_DOCS, chunk_ctes("pd", "doc_id", 300, 60), merge_ctes(150)) + """
SELECT key AS doc_id, k AS chunk_index, text FROM mg""")
def merge_tiny_chunks(spark, sf):
    return corpus.chunk(tables.paragraph_docs(spark, sf), ["doc_id"], size=300, overlap=60,
                        min_chars=150).select("doc_id", "chunk_index", "text")


@query("chunk_or_whole", with_recursive(PARA_DOCS, "long AS (SELECT * FROM pd WHERE length(text) > 1200)",
                                        chunk_ctes("long", "doc_id", 900, 100)) + """
SELECT key AS doc_id, CAST(k AS INT) AS chunk_index, text FROM ch
UNION ALL SELECT doc_id, 0, text FROM pd WHERE length(text) <= 1200""")
def chunk_or_whole(spark, sf):
    return corpus.chunk(tables.paragraph_docs(spark, sf), ["doc_id"],
                        whole_below=corpus.WHOLE_PAGE_CHARS).select("doc_id", "chunk_index", "text")


@query("parse_markdown_sections", with_(DOCS, MD_SECTIONS) + """
SELECT doc_id, section_order, section_name, text, header_level, start_line, end_line FROM msec""")
def parse_markdown_sections(spark, sf):
    return corpus.markdown_sections(tables.markdown_docs(spark, sf), ["doc_id"],
                                    include_nested=True)


@query("parse_markdown_nested", with_(DOCS, MD_DOCS, r"""
h AS (SELECT *, CASE WHEN regexp_matches(line, '^##\s+.') THEN 2 WHEN regexp_matches(line, '^###\s+.') AND n > 0 THEN 3 ELSE 0 END AS lv FROM ml),
g AS (SELECT *, sum(CAST(lv > 0 AS INT)) OVER w AS seg, sum(CAST(lv = 2 AS INT)) OVER w AS outer_seg FROM h
  WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
seg AS (SELECT doc_id, seg, any_value(outer_seg) AS outer_seg, max(lv) AS lv, min(n) AS start_line, max(n) AS end_line,
  coalesce(max(CASE WHEN lv > 0 THEN trim(ltrim(line, '#')) END), 'Preamble') AS title,
  regexp_replace(string_agg(line, chr(10) ORDER BY n), '^\s+|\s+$', '', 'g') AS text FROM g GROUP BY doc_id, seg)""") + """
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seg) - 1 AS section_order,
  string_agg(title, ' > ') OVER (PARTITION BY doc_id, outer_seg ORDER BY seg) AS section_name, text,
  CAST(lv AS INT) AS header_level, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line
FROM seg WHERE text <> ''""")
def parse_markdown_nested(spark, sf):
    sections = corpus.markdown_sections(tables.markdown_docs(spark, sf), ["doc_id"])
    return corpus.with_section_order(sections, "doc_id").drop("section_position")


@query("section_forward_fill", with_(DOCS, MD_DOCS) + r"""
SELECT doc_id, CAST(n AS INT) AS line_number, coalesce(last_value(CASE WHEN regexp_matches(line, '^##\s+.') THEN trim(substr(line, 4)) END IGNORE NULLS)
  OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING), 'Preamble') AS section_name FROM ml""")
def section_forward_fill(spark, sf):
    return corpus.section_forward_fill(tables.markdown_docs(spark, sf)).drop("line")


@query("parse_sections_delimiter", with_(DOCS, r"""
dl AS (SELECT doc_id, unnest(string_split(replace(text, '.' || chr(10), chr(10) || '======' || chr(10)), chr(10))) AS line,
  generate_subscripts(string_split(replace(text, '.' || chr(10), chr(10) || '======' || chr(10)), chr(10)), 1) AS n FROM docs),
g AS (SELECT *, trim(line) = '======' AS d, sum(CAST(trim(line) = '======' AS INT)) OVER (PARTITION BY doc_id ORDER BY n) AS seg,
  lag(line) OVER (PARTITION BY doc_id ORDER BY n) AS prev, count_if(trim(line) = '======') OVER (PARTITION BY doc_id) AS nd FROM dl),
s AS (SELECT doc_id, seg, any_value(nd) AS nd, max(CASE WHEN d THEN CASE WHEN trim(prev) = '======' OR trim(coalesce(prev, '')) = '' THEN 'Untitled Section' ELSE trim(prev) END END) AS title,
  regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT d), ''), '^\s+|\s+$', '', 'g') AS text FROM g GROUP BY 1, 2)""") + """
SELECT doc_id, CAST(seg AS INT) AS section_order, CASE WHEN nd = 0 THEN 'Full Document' WHEN seg = 0 THEN 'Preamble' ELSE title END AS section_name, text
FROM s WHERE text <> '' OR nd = 0""")
def parse_sections_delimiter(spark, sf):
    docs = tables.documents(spark, sf).withColumn(
        "text", F.replace("text", F.lit(".\n"), F.lit("\n======\n")))
    return corpus.delimiter_sections(docs, ["doc_id"])


SUMMARY_TEXT = """concat('The ', source, ' tool — One Page', chr(10), chr(10), 'What it is', chr(10), text, chr(10),
  CASE WHEN lang = 'en' THEN concat('Who it''s for (all)', chr(10), 'People of ', source, chr(10)) ELSE '' END,
  'Sources: notes, March 2024', chr(10), 'How it works', chr(10), 'first', chr(10), 'How it works', chr(10), 'Step ', doc_id)"""


def _summaries(spark, sf):
    d = tables.documents(spark, sf)
    return d.withColumn("text", F.concat(
        F.lit("The "), F.col("source"), F.lit(" tool — One Page\n\nWhat it is\n"), F.col("text"),
        F.lit("\n"), F.when(F.col("lang") == "en", F.concat(
            F.lit("Who it's for (all)\nPeople of "), F.col("source"), F.lit("\n"))).otherwise(""),
        F.lit("Sources: notes, March 2024\nHow it works\nfirst\nHow it works\nStep "),
        F.col("doc_id")))


STRIP_TEXT = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@query("parse_labelled_sections", with_(DOCS) + f"""
SELECT doc_id, concat('The ', source, ' tool — One Page') AS title, {STRIP_TEXT} AS what_it_is,
  CASE WHEN lang = 'en' THEN concat('People of ', source) END AS who, concat('Step ', doc_id) AS how,
  'Sources: notes, March 2024' AS footer, 'March 2024' AS date FROM docs""")
def parse_labelled_sections(spark, sf):
    parsed = corpus.labelled_sections(_summaries(spark, sf), ["doc_id"])
    s = F.col("sections")
    return parsed.select("doc_id", "title", s["What it is"].alias("what_it_is"),
                         s["Who it's for"].alias("who"), s["How it works"].alias("how"),
                         "footer", "date")


@query("overview_chunk", with_(DOCS) + f"""
SELECT doc_id, 0 AS chunk_index, 'overview' AS label, concat_ws(chr(10) || chr(10), concat('The ', source, ' tool'),
  nullif({STRIP_TEXT}, ''), CASE WHEN lang = 'en' THEN concat('People of ', source) END) AS text FROM docs
UNION ALL SELECT doc_id, 1, 'What it is', {STRIP_TEXT} FROM docs WHERE {STRIP_TEXT} <> ''
UNION ALL SELECT doc_id, CASE WHEN {STRIP_TEXT} <> '' THEN 2 ELSE 1 END, 'Who it''s for', concat('People of ', source) FROM docs WHERE lang = 'en'
UNION ALL SELECT doc_id, 1 + CAST({STRIP_TEXT} <> '' AS INT) + CAST(lang = 'en' AS INT), 'How it works', concat('Step ', doc_id) FROM docs""")
def overview_chunk(spark, sf):
    return corpus.summary_chunks(corpus.labelled_sections(_summaries(spark, sf), ["doc_id"]),
                                 ["doc_id"])


def _kb(spark, sf):
    docs = tables.markdown_docs(spark, sf).withColumn(
        "file", F.concat("source", F.lit("-"), "doc_id", F.lit(".md")))
    return corpus.kb_chunks(docs, tables.tiers(spark), "file")


KB = with_recursive(DOCS, MD_SECTIONS,
                    "ks AS (SELECT concat(doc_id, '/', section_order) AS sk, doc_id, section_name, text FROM msec WHERE length(text) >= 160)",
                    chunk_ctes("ks", "sk", 900, 100, "k_"), merge_ctes(150, "k_"))


@query("kb_chunks", KB + f"""
SELECT concat(source_type, ':', source, '-', doc_id, '.md') AS source, ks.section_name AS section, k AS chunk_index,
  {TIER_SQL} AS sensitivity, concat('[', ks.section_name, ']', chr(10), mg.text) AS text, sha256(md.text) AS content_hash
FROM k_mg AS mg JOIN ks ON ks.sk = mg.key JOIN md USING (doc_id)""")
def kb_chunks(spark, sf):
    return _kb(spark, sf).select("source", "section", "chunk_index", "sensitivity", "text",
                                 "content_hash")


@query("incremental_sections", with_(DOCS, LINE_CHUNKS) + """
SELECT id, source, section FROM lc WHERE (source, coalesce(section, '')) NOT IN (
  SELECT source, coalesce(section, '') FROM lc WHERE section IN ('part 0', 'part 1'))""")
def incremental_sections(spark, sf):
    fresh = tables.line_chunks(spark, sf)
    stored = fresh.where(F.col("section").isin("part 0", "part 1"))
    return corpus.new_sections(fresh, stored).select("id", "source", "section")


@query("replace_source", with_(DOCS, LINE_CHUNKS) + """
SELECT id, source, text FROM lc WHERE NOT starts_with(source, 'notes-public:src1')
UNION ALL SELECT id, source, concat('* ', text) FROM lc WHERE source = 'notes-public:src1'""")
def replace_source(spark, sf):
    stored = tables.line_chunks(spark, sf).select("id", "source", "text")
    fresh = stored.where(F.col("source") == "notes-public:src1").withColumn("text", F.concat(F.lit("* "), F.col("text")))
    return corpus.replace_source(stored, fresh, "notes-public:src1")


def _stored_sections(spark, sf):
    """Earlier snapshot: other languages only, Spanish texts since changed, with vectors."""
    d = tables.documents(spark, sf).where(F.col("lang") != "fr")
    v = tables.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    old = F.when(F.col("lang") == "es", F.upper("text")).otherwise(F.col("text"))
    return d.join(v, "doc_id", "left").select(
        F.col("doc_id").alias("section_id"), old.alias("full_text"),
        F.sha2(old, 256).alias("content_hash"), "embedding")


def _current_sections(spark, sf):
    return tables.documents(spark, sf).where(F.col("source") != "src7").select(
        F.col("doc_id").alias("section_id"), F.col("text").alias("full_text"),
        F.sha2("text", 256).alias("content_hash"))


UPSERTED = """
SELECT c.doc_id AS section_id, CASE WHEN lang IN ('fr') THEN 'new' WHEN lang = 'es' AND upper(text) <> text THEN 'changed' ELSE 'unchanged' END AS state,
  sha256(c.text) AS content_hash, CASE WHEN lang NOT IN ('fr', 'es') OR (lang = 'es' AND upper(text) = text) THEN e.embedding END IS NOT NULL AS has_vector
FROM docs c LEFT JOIN embeddings e ON e.vec_id = c.doc_id WHERE c.source <> 'src7'
UNION ALL SELECT c.doc_id, 'kept', sha256(CASE WHEN lang = 'es' THEN upper(text) ELSE text END), e.vec_id IS NOT NULL
FROM docs c LEFT JOIN embeddings e ON e.vec_id = c.doc_id WHERE c.source = 'src7' AND lang <> 'fr'"""


@query("upsert_sections_by_hash", with_(DOCS) + UPSERTED)
def upsert_sections_by_hash(spark, sf):
    return corpus.upsert_sections(_stored_sections(spark, sf), _current_sections(spark, sf)).select(
        "section_id", "state", "content_hash", F.col("embedding").isNotNull().alias("has_vector"))


@query("section_store", with_(DOCS, f"up AS ({UPSERTED})") + """
SELECT section_id, content_hash, has_vector FROM up""")
def section_store_query(spark, sf):
    root = scratch_dir(spark, "section-store")
    section_store.create(spark, root, _stored_sections(spark, sf), buckets=16)
    section_store.upsert(spark, root, _current_sections(spark, sf))
    return section_store.read(spark, root).select(
        "section_id", "content_hash", F.col("embedding").isNotNull().alias("has_vector"))


@query("ingest_gate", with_(DOCS) + rf"""
SELECT coalesce(r, 'accepted') AS reason, {big('count(*)')} AS n FROM (
  SELECT CASE WHEN lang = 'es' THEN 'draft' WHEN length(CASE WHEN lang = 'de' THEN {STRIP_TEXT} ELSE {STRIP_TEXT} END) < 200 THEN 'too_short' END AS r FROM docs)
GROUP BY 1""")
def ingest_gate(spark, sf):
    posts = tables.documents(spark, sf).select(
        "doc_id", text.strip(F.col("text")).alias("body"), (F.col("lang") != "es").alias("published"))
    return corpus.ingest_gate(posts).groupBy(
        F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n"))


@query("drift_check", with_(DOCS, LINE_CHUNKS) + """
SELECT DISTINCT source, CASE WHEN source LIKE '%src3' THEN 'missing' WHEN source LIKE '%src5' THEN 'not embedded'
  WHEN source LIKE '%src6' THEN 'unhashed' WHEN source LIKE '%src8' THEN 'drifted' ELSE 'in sync' END AS status FROM lc""")
def drift_check(spark, sf):
    rows = tables.line_chunks(spark, sf)
    ends = lambda s: F.col("source").endswith(s)
    registry = rows.select("source").distinct()
    files = registry.where(~ends("src3")).withColumn("file_hash", F.sha2("source", 256))
    stored = rows.where(~ends("src5")).select(
        "source", "id", F.when(ends("src6"), None).when(ends("src8"), F.sha2(F.upper("source"), 256))
        .otherwise(F.sha2("source", 256)).alias("content_hash"))
    return corpus.drift_check(registry, files, stored)


@query("orphans", with_(DOCS, LINE_CHUNKS) + """
SELECT id, doc_id FROM lc WHERE doc_id IN (SELECT doc_id FROM docs WHERE lang = 'fr' AND source_type <> 'notes-inner')""")
def orphans(spark, sf):
    docs = tables.documents(spark, sf)
    gone, _, _ = corpus.drop_orphans(docs, tables.line_chunks(spark, sf),
                                     docs.where(F.col("lang") != "fr"),
                                     ["notes-public", "notes-personal"])
    return gone.select("id", "doc_id")


@query("orphans_surviving", with_(DOCS) + """
SELECT doc_id FROM docs WHERE NOT (lang = 'fr' AND source_type <> 'notes-inner')""")
def orphans_surviving(spark, sf):
    docs = tables.documents(spark, sf)
    _, kept, _ = corpus.drop_orphans(docs, tables.line_chunks(spark, sf),
                                     docs.where(F.col("lang") != "fr"),
                                     ["notes-public", "notes-personal"])
    return kept.select("doc_id")


def _targets(spark, sf):
    """Every inner-circle source, and names that match nothing."""
    src = tables.documents(spark, sf).select(F.concat_ws(":", "source_type", "source").alias("source"))
    return src.where(F.col("source").startswith("notes-inner")).distinct().unionByName(
        src.where(F.col("source").startswith("notes-personal")).distinct()
        .withColumn("source", F.concat("source", F.lit("-gone"))))


@query("retract_sources", with_(DOCS, LINE_CHUNKS) + f"""
SELECT source, {big('count(*)')} AS chunks FROM lc WHERE source_type = 'notes-inner' GROUP BY 1
UNION ALL SELECT DISTINCT concat(source, '-gone'), CAST(0 AS BIGINT) FROM lc WHERE source_type = 'notes-personal'""")
def retract_sources(spark, sf):
    return corpus.retract_counts(tables.line_chunks(spark, sf), _targets(spark, sf))


@query("retract_surviving", with_(DOCS, LINE_CHUNKS) + "SELECT id FROM lc WHERE source_type <> 'notes-inner'")
def retract_surviving(spark, sf):
    return corpus.retract(tables.line_chunks(spark, sf), _targets(spark, sf), dry_run=False).select("id")


BROWSE = """contains(lower(text), 'heron') AND source_type = 'notes-public'"""


@query("browse_chunks", with_(DOCS, LINE_CHUNKS) + f"""
SELECT id, source_type, section, char_count, total FROM (
  SELECT id, source_type, coalesce(section, '—') AS section, CAST(char_count AS INT) AS char_count, {big('count(*) OVER ()')} AS total
  FROM lc WHERE {BROWSE} OR (source_type = 'notes-public' AND contains(lower(coalesce(section, '')), 'heron'))) ORDER BY id LIMIT 100""")
def browse_chunks(spark, sf):
    found = corpus.browse(tables.line_chunks(spark, sf), "notes-public", " Heron ")
    page = corpus.browse_page(found).withColumn("__one", F.lit(1))
    total = corpus.browse_total(found).withColumn("__one", F.lit(1))
    return page.join(total, "__one").select("id", "source_type", "section", "char_count", "total")


@query("chunk_detail", with_(DOCS, LINE_CHUNKS) + "SELECT id, source, text FROM lc WHERE char_count < 40")
def chunk_detail(spark, sf):
    chunks = tables.line_chunks(spark, sf)
    return corpus.chunk_detail(chunks, chunks.where(F.col("char_count") < 40)).select(
        "id", "source", "text")


@query("embedding_backfill", with_(DOCS) + f"""
SELECT action, {big('count(*)')} AS n FROM (SELECT d.doc_id, CASE WHEN md5(d.text) IN (
    SELECT md5(text) FROM docs JOIN embeddings ON vec_id = doc_id) THEN 'reuse' ELSE 'embed' END AS action
  FROM docs d LEFT JOIN embeddings e ON e.vec_id = d.doc_id WHERE e.vec_id IS NULL) GROUP BY 1""")
def embedding_backfill(spark, sf):
    v = tables.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    sections = tables.documents(spark, sf).join(v, "doc_id", "left").select(
        "doc_id", F.col("text").alias("full_text"), "embedding")
    cache = sections.where(F.col("embedding").isNotNull()).groupBy(
        F.md5("full_text").alias("text_hash")).agg(F.min_by("embedding", "doc_id").alias("embedding"))
    return corpus.embedding_backfill(sections, cache).groupBy("action").agg(
        F.count(F.lit(1)).alias("n"))


@query("source_type_counts", with_(DOCS, LINE_CHUNKS) + f"""
SELECT source_type, {big('count(*)')} AS chunks, {big('count(DISTINCT source)')} AS sources, {big('count(section)')} AS with_section,
  {big("count(DISTINCT (source, section)) FILTER (WHERE section IS NOT NULL)")} AS sections,
  {big('count(*) - count(section)')} AS without_section, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS share_pct
FROM lc GROUP BY 1""")
def source_type_counts(spark, sf):
    return corpus.source_type_counts(tables.line_chunks(spark, sf))


@query("top_sources", with_(DOCS, LINE_CHUNKS) + f"""
SELECT source_type, source, chunks, CAST(rank AS INT) AS rank FROM (SELECT source_type, source, {big('count(*)')} AS chunks,
  row_number() OVER (PARTITION BY source_type ORDER BY count(*) DESC, source) AS rank FROM lc GROUP BY 1, 2) WHERE rank <= 5""")
def top_sources(spark, sf):
    return corpus.top_sources(tables.line_chunks(spark, sf))


@query("chunk_audit", with_(DOCS, LINE_CHUNKS) + f"""
SELECT source_type, {big('count(*)')} AS chunks, CAST(min(char_count) AS INT) AS min_chars, CAST(max(char_count) AS INT) AS max_chars,
  {big('sum(char_count) // count(*)')} AS avg_chars, {big('count_if(char_count < 150)')} AS tiny FROM lc GROUP BY ROLLUP (source_type)""")
def chunk_audit(spark, sf):
    return corpus.chunk_audit(tables.line_chunks(spark, sf))


@query("chunk_size_hist", with_(DOCS, LINE_CHUNKS) + f"""
SELECT CASE WHEN char_count < 150 THEN '<150' WHEN char_count < 300 THEN '150-300' WHEN char_count < 600 THEN '300-600'
  WHEN char_count < 900 THEN '600-900' ELSE '>900' END AS bucket, {big('count(*)')} AS chunks FROM lc GROUP BY 1""")
def chunk_size_hist(spark, sf):
    return corpus.chunk_size_hist(tables.line_chunks(spark, sf))


@query("tiny_chunks", with_(DOCS, LINE_CHUNKS) + """
SELECT id, source, text FROM lc WHERE char_count < 150 ORDER BY id LIMIT 20""")
def tiny_chunks(spark, sf):
    return corpus.tiny_chunks(tables.line_chunks(spark, sf)).select("id", "source", "text")
