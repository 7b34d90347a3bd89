"""Entity canonicalisation: first spelling kept, case variants folded, merges applied.

Raw entities carry kind, name, category and ``seq``, the position they were found at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions.loose import strip

PROJECT_KINDS = ["skills", "methods", "technologies"]
SECTION_KIND = "concepts"


def fold(name: Column) -> Column:
    return F.lower(strip(name))


def dedupe_first(rows: DataFrame, keys: list[Column], seq: str = "seq") -> DataFrame:
    """First row per key, as an aggregate that combines before the shuffle.

    Rows that differ in ``seq`` only are combined first, in a hash table of whole numbers: picking a
    row out of all of them would sort every row of a task.
    """
    rest = [c for c in rows.columns if c != seq]
    named = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    unlike = rows.groupBy(*rest).agg(F.min(seq).alias(seq)).select(*rows.columns)
    first = unlike.groupBy(*named).agg(F.min_by(F.struct(*rows.columns), seq).alias("r"))
    return first.select("r.*")


def collect_entities(project_entities: DataFrame, section_mentions: DataFrame) -> DataFrame:
    """Skills, methods, technologies from projects only; concepts from sections only."""
    own = project_entities.where(F.col("kind").isin(PROJECT_KINDS)).select(
        "kind", "name", "category", F.lit("").alias("source"), "seq")
    found = section_mentions.where(F.col("kind") == SECTION_KIND).select(
        "kind", strip(F.col("name")).alias("name"), F.lit("").alias("category"),
        F.lit("kb_sections").alias("source"), "seq")
    both = own.unionByName(found).where(strip(F.col("name")) != "")
    return dedupe_first(both, [F.col("kind"), fold(F.col("name"))])


def case_mapping(names: DataFrame) -> DataFrame:
    """(kind, variant, canonical): the longest spelling per folded name, earliest on ties."""
    keyed = names.groupBy("kind", F.col("name").alias("variant")).agg(
        F.min("seq").alias("seq")).withColumn("__key", fold(F.col("variant")))
    best = keyed.groupBy("kind", "__key").agg(F.max_by(
        "variant", F.struct(F.length("variant"), -F.col("seq"))).alias("canonical"))
    return keyed.join(best, ["kind", "__key"]).select("kind", "variant", "canonical", "seq")


def readable_tag(tag: Column) -> Column:
    return F.initcap(F.trim(F.regexp_replace(F.translate(tag, "-", " "), r"\s+", " ")))


def tag_anchor(mapping: DataFrame, tags: DataFrame) -> DataFrame:
    """Canonical names equal to a readable tag, ignoring case, take the tag's form.

    Adds ``previous``: the canonical name before the change.
    """
    forms = tags.select(readable_tag(F.col("tag")).alias("__form")).distinct().withColumn(
        "__low", F.lower("__form"))
    return (mapping.withColumnRenamed("canonical", "previous")
            .join(forms, F.lower("previous") == F.col("__low"), "left")
            .select("kind", "variant", "previous", "seq",
                    F.coalesce("__form", "previous").alias("canonical")))


def apply_merges(entities: DataFrame, mapping: DataFrame, merges: DataFrame) -> DataFrame:
    """Final entities: details of the first raw one, alternative labels of the others.

    ``merges`` is an outside decision table (kind, from_name, to_name).
    """
    m = merges.select("kind", F.col("from_name").alias("canonical"), "to_name")
    final = mapping.join(m, ["kind", "canonical"], "left").select(
        "kind", F.col("variant").alias("name"),
        F.coalesce("to_name", "canonical").alias("final"))
    joined = entities.join(final, ["kind", "name"])
    other = F.when(F.col("name") != F.col("final"), F.col("name"))
    return joined.groupBy("kind", "final").agg(
        F.min_by(F.struct("category", "source"), "seq").alias("d"),
        F.array_sort(F.collect_set(other)).alias("alt_labels")).select(
        "kind", F.col("final").alias("name"), "d.category", "d.source", "alt_labels")


def decisions(case_map: DataFrame, anchored: DataFrame, merges: DataFrame) -> DataFrame:
    """Log of every rename: phase, kind, variant, canonical, reason."""
    one = case_map.where(F.col("variant") != F.col("canonical")).select(
        F.lit(1).alias("phase"), "kind", "variant", "canonical",
        F.lit("case variant").alias("reason"))
    two = anchored.where(F.col("previous") != F.col("canonical")).select(
        F.lit(2).alias("phase"), "kind", "variant", "canonical",
        F.lit("matched catalogue tag").alias("reason"))
    three = merges.select(F.lit(3).alias("phase"), "kind", F.col("from_name").alias("variant"),
                          F.col("to_name").alias("canonical"), F.lit("merge").alias("reason"))
    return one.unionByName(two).unionByName(three)


def decision_totals(log: DataFrame) -> DataFrame:
    return log.groupBy("phase", "kind").agg(F.count(F.lit(1)).alias("decisions"))


def curate_replace(entities: DataFrame, curated: DataFrame, kind: str) -> DataFrame:
    """One kind replaced as a whole by a curated table."""
    return entities.where(F.col("kind") != kind).unionByName(
        curated.where(F.col("kind") == kind), allowMissingColumns=True)


def name_lookup(entities: DataFrame) -> DataFrame:
    """(kind, lookup, canonical) from names and alternative labels; later entities win."""
    labels = F.concat(F.array("name"), F.coalesce(
        "alt_labels", F.array().cast("array<string>")))
    rows = entities.select("kind", "name", "seq", F.posexplode(labels).alias("__p", "__label"))
    return rows.groupBy("kind", F.lower("__label").alias("lookup")).agg(
        F.max_by("name", F.struct("seq", "__p")).alias("canonical"))


def resolve_names(rows: DataFrame, lookup: DataFrame, name: str = "name") -> DataFrame:
    """Canonical name per row; unknown names stay as they are."""
    keyed = rows.withColumn("lookup", F.lower(F.col(name)))
    return keyed.join(lookup, ["kind", "lookup"], "left").withColumn(
        "resolved", F.coalesce("canonical", F.col(name))).drop("lookup", "canonical")


def concept_review(section_mentions: DataFrame) -> DataFrame:
    """Concept → source documents, one row per pair with its place in the sorted list.

    Long form: a concept found in very many documents stays many rows.
    """
    pairs = (section_mentions.where((F.col("kind") == SECTION_KIND)
                                    & (strip(F.col("name")) != ""))
             .select(strip(F.col("name")).alias("name"),
                     F.substring_index("section_id", ":", 1).alias("document")).distinct())
    counts = pairs.groupBy("name").agg(F.count(F.lit(1)).alias("documents"))
    return pairs.join(counts, "name").orderBy(F.lower("name"), "name", "document")


def entity_nodes(*frames: DataFrame) -> DataFrame:
    """All kinds in one table; the last row of a (kind, name) wins."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    columns = [c for c in out.columns if c not in ("kind", "name")]
    return out.groupBy("kind", "name").agg(
        F.max_by(F.struct(*columns), "seq").alias("d")).select("kind", "name", "d.*")
