"""Node and edge tables of the knowledge graph.

Edges are (src_kind, src, rel, dst_kind, dst, props); ``rel`` is a good partition
column for the written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions.loose import strip
from murmur.operators import corpus, entities, projects
from murmur.scale import following
from murmur.session import materialize

# Shared entities two projects need, context length, walkthrough ids.
MIN_SHARED = 2
WIDE = 256  # projects of an entity that are paired outright
PAIRS_A_TASK = 2_000_000
CONTEXT_CHARS = 200
WALKTHROUGH_DOC = "project-walkthroughs"
WALKTHROUGH_PREFIX = "project-walkthrough:"
PROJECT_RELATIONS = {
    "skills": ("DEMONSTRATES", "Skill", "role"),
    "methods": ("USES_METHOD", "Method", "stage"),
    "technologies": ("USES_TECHNOLOGY", "Technology", None),
}
# end of fixed values

NO_PROPS = "map<string,string>"


def _edge(df: DataFrame, src_kind, src, rel, dst_kind, dst, props: Column | None = None):
    wrap = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select(
        wrap(src_kind).alias("src_kind"), src.cast("string").alias("src"),
        wrap(rel).alias("rel"), wrap(dst_kind).alias("dst_kind"),
        dst.cast("string").alias("dst"),
        (props if props is not None else F.create_map().cast(NO_PROPS)).alias("props"))


def title_case(name: Column) -> Column:
    """Every run of letters capitalised."""
    runs = F.regexp_extract_all(name, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, F.initcap), "")


def document_nodes(files: DataFrame, tiers: DataFrame) -> DataFrame:
    """File → document node; one row per id. ``files`` has file_name, source_type, text."""
    doc_id = F.replace("file_name", F.lit(".md"), F.lit(""))
    title = title_case(F.translate(F.replace(doc_id, F.lit("kb_"), F.lit("")), "-_", "  "))
    out = corpus.sensitivity_of(files, tiers).select(
        doc_id.alias("id"), "source_type", F.col("file_name").alias("file_path"),
        title.alias("title"), "sensitivity", F.sha2("text", 256).alias("content_hash"))
    return out.groupBy("id").agg(F.max_by(
        F.struct("source_type", "file_path", "title", "sensitivity", "content_hash"),
        "file_path").alias("d")).select("id", "d.*")


def kept_sections(docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Level-2 sections of at least 50 characters with their position before that filter."""
    parsed = corpus.markdown_sections(docs, [doc, "sensitivity"], "text", 2, include_nested=True)
    return parsed.where(F.length("text") >= corpus.MIN_SECTION_CHARS).withColumn(
        "id", F.concat_ws(":", F.col(doc), "section_name"))


def section_nodes(kept: DataFrame) -> DataFrame:
    """One node per id; of same-named sections the last text counts."""
    return kept.groupBy("id").agg(F.max_by(
        F.struct(F.col("section_name").alias("name"), F.col("text").alias("full_text"),
                 "sensitivity", F.col("section_order").alias("order")),
        "section_order").alias("s")).select(
        "id", "s.*", F.length("s.full_text").alias("char_count"))


def has_section_edges(kept: DataFrame, doc: str = "doc_id") -> DataFrame:
    return _edge(kept.select(doc, "id").distinct(), "Document", F.col(doc), "HAS_SECTION",
                 "Section", F.col("id"))


def next_section_edges(kept: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Link to the following kept section of the document."""
    chained = following(kept.select(doc, "id", "section_order"), [doc], ["section_order"],
                        F.floor(F.col("section_order") / 1000), {"__next": F.col("id")})
    pairs = chained.where(F.col("__next").isNotNull()).select("id", "__next").distinct()
    return _edge(pairs, "Section", F.col("id"), "NEXT_SECTION", "Section", F.col("__next"))


def project_nodes(catalogue: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return catalogue.select(
        F.col("project_id").alias("id"), "title", text("summary"), text("design_insight"),
        text("walkthrough_context"), text("diagram_filename"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.lit("public").alias("sensitivity"))


def walkthrough_sections(catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(section nodes, edges): one composite section per project that has notes."""
    composed = projects.composite_text(catalogue)
    section_id = F.concat(F.lit(WALKTHROUGH_PREFIX), F.col("project_id"))
    nodes = composed.select(
        section_id.alias("id"), F.concat("title", F.lit(" — Walkthrough")).alias("name"),
        "full_text", F.lit("public").alias("sensitivity"), "order",
        F.length("full_text").alias("char_count"))
    edges = _edge(composed, "Document", F.lit(WALKTHROUGH_DOC), "HAS_SECTION", "Section",
                  section_id).unionByName(
        _edge(composed, "Project", F.col("project_id"), "DESCRIBED_IN", "Section", section_id))
    return nodes, edges


def project_entity_edges(project_entities: DataFrame, catalogue_ids: DataFrame,
                         canonical: DataFrame) -> DataFrame:
    """Project → skill, method, technology; rows without a known end are dropped."""
    lookup = entities.name_lookup(canonical)
    resolved = entities.resolve_names(project_entities, lookup)
    known = canonical.select("kind", F.col("name").alias("resolved")).distinct()
    rows = (resolved.join(catalogue_ids.select("project_id").distinct(), "project_id",
                          "left_semi")
            .join(known, ["kind", "resolved"], "left_semi"))
    relation = lambda i: F.create_map(*[x for k, v in PROJECT_RELATIONS.items()
                                        for x in (F.lit(k), F.lit(v[i]))])[F.col("kind")]
    detail = F.create_map(*[x for k, v in PROJECT_RELATIONS.items() if v[2]
                            for x in (F.lit(k), F.lit(v[2]))])[F.col("kind")]
    value = F.coalesce("detail", F.lit(""))
    slim = rows.select("project_id", relation(0).alias("rel"), relation(1).alias("dst_kind"),
                       "resolved", detail.alias("k"),
                       F.when(detail.isNotNull(), value).alias("v")).distinct()
    props = F.when(F.col("k").isNotNull(), F.create_map("k", "v")).otherwise(
        F.create_map().cast(NO_PROPS))
    return _edge(slim, "Project", F.col("project_id"), F.col("rel"), F.col("dst_kind"),
                 F.col("resolved"), props)


def project_name_lookup(catalogue: DataFrame) -> DataFrame:
    """Lower-cased title or keyword → project; later entries overwrite, keywords after titles."""
    titles = catalogue.select(F.lower("title").alias("lookup"), "project_id",
                              F.struct(F.lit(0), "order", F.lit(0)).alias("__at"))
    keywords = catalogue.select("project_id", "order", F.posexplode("mention_keywords").alias(
        "__p", "__kw")).select(F.lower("__kw").alias("lookup"), "project_id",
                               F.struct(F.lit(1), "order", F.col("__p")).alias("__at"))
    return titles.union(keywords).groupBy("lookup").agg(
        F.max_by("project_id", "__at").alias("project_id"))


def section_mention_edges(mentions: DataFrame, section_ids: DataFrame,
                          catalogue: DataFrame) -> DataFrame:
    """Section → project, skill, concept plus project → section; unknown projects skipped."""
    known = mentions.join(section_ids.select("section_id").distinct(), "section_id", "left_semi"
                          ).withColumn("name", strip(F.col("name")))
    to_project = (known.where(F.col("kind") == "projects").withColumn("lookup", F.lower("name"))
                  .join(project_name_lookup(catalogue), "lookup"))
    context = F.substring(F.coalesce("context", F.lit("")), 1, CONTEXT_CHARS)
    mentioned = to_project.select("section_id", "project_id", context.alias("ctx")).distinct()
    described = to_project.select("section_id", "project_id").distinct()
    others = (known.where(F.col("kind").isin("skills", "concepts") & (F.col("name") != ""))
              .select("section_id", "kind", "name").distinct())
    kind = F.when(F.col("kind") == "skills", "Skill").otherwise("Concept")
    return (_edge(mentioned, "Section", F.col("section_id"), "MENTIONS", "Project",
                  F.col("project_id"), F.create_map(F.lit("context"), F.col("ctx")))
            .unionByName(_edge(described, "Project", F.col("project_id"), "DESCRIBED_IN",
                               "Section", F.col("section_id")))
            .unionByName(_edge(others, "Section", F.col("section_id"), "MENTIONS", kind,
                               F.col("name"))))


def created_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Skills and concepts that only exist because a section mentions them."""
    named = edges.where((F.col("rel") == "MENTIONS") & F.col("dst_kind").isin("Skill", "Concept")
                        ).select(F.col("dst_kind").alias("node_kind"), F.col("dst").alias("name")
                                 ).distinct()
    return named.join(nodes.select("node_kind", "name"), ["node_kind", "name"], "left_anti")


def _numbered(names: DataFrame, label: str) -> DataFrame:
    """Distinct names with numbers from 0, without gaps."""
    raw = materialize(names.distinct().select("*", F.monotonically_increasing_id().alias("__id")), label)
    part = F.shiftright("__id", 33)  # the upper bits name the partition, the lower ones count its rows
    sizes = sorted((r["part"], r["n"]) for r in raw.groupBy(part.alias("part")).agg(
        F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for at, n in sizes:
        starts.append((at, total))
        total += n
    known = raw.sparkSession.createDataFrame(starts, "__part bigint, __start bigint")
    number = F.col("__id") - F.shiftleft(F.col("__part"), 33) + F.col("__start")
    return raw.join(F.broadcast(known), part == F.col("__part")).select(
        *names.columns, (number.cast("int") if total < 2 ** 31 else number).alias("number"))


def _met(rows: DataFrame, pairs: int) -> DataFrame:
    """(kind, a, b, seen) from rows of a project and the later projects it meets on an entity.

    Rows are dealt by ``a`` before they become pairs: a pair's count is made up inside one task, and
    numbers in arrays are all that is shuffled.
    """
    dealt = rows.repartition(max(1, -(-pairs // PAIRS_A_TASK)), "a")
    return (dealt.select("kind", "a", "pa", F.inline(F.arrays_zip("bs", "ps")).alias("b", "pb"))
            .groupBy("kind", "a", "b").agg(F.sum(F.col("pa").cast("bigint") * F.col("pb")).alias("seen")))


def _members() -> Column:
    """Projects of an entity, sorted, with their paths."""
    return F.array_sort(F.collect_list(F.struct("project", "paths")))


def _later(members: Column, a: Column, pa: Column) -> list:
    return ["kind", a.alias("a"), pa.alias("pa"), members["project"].alias("bs"), members["paths"].alias("ps")]


def _shared_paths(paths: DataFrame) -> DataFrame:
    """(kind, a, b, shared) for project pairs with at least two shared paths, a < b.

    Entities of up to ``WIDE`` projects pair them all. A pair with two common entities also
    meets on one that is not the most widespread of either project, so candidates are not
    drawn from a project's most widespread entity if that is a wider one: one entity used by a
    third of the projects does not pair them all. An entity with parallel edges can qualify a
    pair alone, so those are matched separately. Paths over a widest entity are then added
    for pairs that are already candidates.
    """
    on = ["kind", "entity"]
    spread = paths.groupBy(*on).agg(F.count(F.lit(1)).alias("__spread"))
    pairs = spread.agg(F.sum(F.expr("__spread * (__spread - 1) div 2"))).first()[0] or 0
    wide = materialize(spread.where(F.col("__spread") > WIDE), "wide-entities")
    lists = paths.groupBy(*on).agg(_members().alias("m"))
    if not wide.isEmpty():
        lists = paths.join(wide, on, "left_anti").groupBy(*on).agg(_members().alias("m"))
    each = lists.where(F.size("m") > 1).select("kind", "m", F.posexplode("m").alias("i", "x"))
    rest = F.slice("m", F.col("i") + 2, F.size("m"))
    rows = each.where(F.col("i") < F.size("m") - 1).select(
        *_later(rest, F.col("x.project"), F.col("x.paths")))
    if wide.isEmpty():
        return _met(rows, pairs).toDF("kind", "a", "b", "shared").where(F.col("shared") >= MIN_SHARED)

    over = paths.join(wide, on)
    widest = over.groupBy("kind", "project").agg(F.max(F.struct("__spread", "entity")).alias("__w"))
    # Read several times below: written once to the shared folder instead of recomputed.
    tagged = materialize(over.join(widest, ["kind", "project"]).select(
        "kind", "project", "entity", "paths", "__spread",
        (F.col("__w.entity") == F.col("entity")).alias("widest")), "project-paths")
    # The other wide entities: every project meets the members in parts of ``WIDE`` of them.
    left_over = tagged.where("not widest")
    parts = left_over.withColumn("part", F.pmod(F.xxhash64("project"), F.expr(f"__spread div {WIDE} + 1"))
                                 ).groupBy(*on, "part").agg(_members().alias("m"))
    met_over = left_over.select(*on, F.col("project").alias("x"), F.col("paths").alias("px")).join(parts, on)
    after = F.filter("m", lambda y: y["project"] > F.col("x"))
    rows = rows.unionByName(met_over.select(*_later(after, F.col("x"), F.col("px"))).where(F.size("bs") > 0))
    met = materialize(_met(rows, pairs), "met")

    def side(project: str, mark: str) -> DataFrame:
        return tagged.select("kind", "entity", F.col("project").alias(project),
                             F.col("paths").alias(f"p{mark}"), F.col("widest").alias(f"w{mark}"))

    left, right = side("a", "a"), side("b", "b")
    one_widest = (F.col("a") < F.col("b")) & (F.col("wa") | F.col("wb"))
    alone = (left.where(F.col("pa") > 1).join(right, on).where(one_widest)
             .select("kind", "a", "b").unionByName(
        left.where(F.col("pa") == 1).join(right.where(F.col("pb") > 1), on).where(one_widest)
        .select("kind", "a", "b")))
    found = met.select("kind", "a", "b").unionByName(alone).distinct()
    over_a = (found.join(left.where("wa"), ["kind", "a"])
              .join(right, ["kind", "entity", "b"]))
    over_b = (found.join(right.where("wb"), ["kind", "b"])
              .join(left.where("not wa"), ["kind", "entity", "a"]))
    seen = lambda df: df.select(
        "kind", "a", "b", (F.col("pa").cast("bigint") * F.col("pb")).alias("seen"))
    return (met.unionByName(seen(over_a)).unionByName(seen(over_b))
            .groupBy("kind", "a", "b").agg(F.sum("seen").alias("shared"))
            .where(F.col("shared") >= MIN_SHARED))


def project_similarity(uses: DataFrame) -> DataFrame:
    """RELATED_TO pairs from shared methods and technologies, merged into one edge.

    ``uses`` has project, kind (methods or technologies), entity and optional detail;
    parallel edges of a pair with different details count as separate paths.
    """
    # Pairs are formed over numbers: names would be most of what the pair shuffles carry.
    projects = _numbered(uses.select("project"), "projects")
    known = F.col("kind").isNotNull() & F.col("entity").isNotNull()
    counted = uses.distinct().where(known).groupBy("kind", "project", "entity").agg(
        F.count(F.lit(1)).cast("int").alias("paths"))
    paths = materialize(counted.join(projects, "project").select(
        "kind", F.col("number").alias("project"), "entity", "paths"), "paths")
    count_of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("shared")))
    found = _shared_paths(paths).groupBy("a", "b").agg(
        count_of("methods").alias("shared_methods"),
        count_of("technologies").alias("shared_technologies"))
    named = (found.join(projects.toDF("name_a", "a"), "a").join(projects.toDF("name_b", "b"), "b"))
    return named.select(
        F.least("name_a", "name_b").alias("a"), F.greatest("name_a", "name_b").alias("b"),
        "shared_methods", "shared_technologies",
        F.when(F.col("shared_methods").isNotNull(), "methods").otherwise("technologies")
        .alias("basis"))


def projects_sharing_with(uses: DataFrame, project: str) -> DataFrame:
    """Other projects over shared entities, by number of shared paths."""
    mine = uses.where(F.col("project") == project).groupBy("kind", "entity").agg(
        F.count(F.lit(1)).alias("__mine"))
    return (uses.where(F.col("project") != project)
            .groupBy("kind", "entity", "project").agg(F.count(F.lit(1)).alias("__theirs"))
            .join(mine, ["kind", "entity"])
            .groupBy("project").agg(F.sum(F.col("__mine") * F.col("__theirs"))
                                    .alias("shared_count"))
            .orderBy(F.col("shared_count").desc(), "project"))


def projects_by_entity_keyword(uses: DataFrame, kinds: list[str], needles: list[str]
                               ) -> DataFrame:
    """Projects using an entity whose name contains any of the needles."""
    hit = F.lit(False)
    for n in needles:
        hit = hit | F.contains(F.lower("entity"), F.lit(n.lower()))
    return uses.where(F.col("kind").isin(kinds) & hit).select("project").distinct()


def entity_mention_counts(edges: DataFrame) -> DataFrame:
    """Per section: distinct projects describing it and distinct entities it mentions.

    Both sides are aggregated before they meet, so counts do not multiply rows.
    """
    described = edges.where(F.col("rel") == "DESCRIBED_IN").select(
        F.col("dst").alias("section"), F.lit("p").alias("side"), F.col("src").alias("other"))
    mentioned = edges.where(F.col("rel") == "MENTIONS").select(
        F.col("src").alias("section"), F.lit("e").alias("side"),
        F.concat_ws("\u0001", "dst_kind", "dst").alias("other"))
    return (described.unionByName(mentioned).distinct().groupBy("section").agg(
        F.count_if(F.col("side") == "p").alias("projects_described"),
        F.count_if(F.col("side") == "e").alias("entities_mentioned")))


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes per kind and the number of relationships."""
    per_kind = nodes.groupBy(F.col("node_kind").alias("label")).agg(
        F.count(F.lit(1)).alias("count"))
    return per_kind.unionByName(edges.agg(F.count(F.lit(1)).alias("count")).select(
        F.lit("Relationships").alias("label"), "count"))


def ingest_summary(sections: DataFrame) -> DataFrame:
    """Per source type: documents, sections, sections without a vector."""
    per_doc = sections.groupBy("source_type", "doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("embedding").isNull()).alias("u"))
    return per_doc.groupBy("source_type").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("n").alias("sections"),
        F.sum("u").alias("unembedded"))


def duplicate_keys(nodes: DataFrame, key: list[str]) -> DataFrame:
    """Keys held by more than one row."""
    return nodes.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def outside_vocabulary(rows: DataFrame, fields: list[str], vocabulary: DataFrame) -> DataFrame:
    """Values per field that the controlled vocabulary does not list, with their counts."""
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("term"))
                        for f in fields])
    used = (rows.select(F.explode(entries).alias("e")).select("e.*")
            .where(F.col("term").isNotNull()).groupBy("field", "term")
            .agg(F.count(F.lit(1)).alias("rows")))
    return used.join(vocabulary.select("field", "term"), ["field", "term"], "left_anti")
