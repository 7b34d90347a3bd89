"""Documents → paragraphs, sections, chunks; incremental upkeep of the chunk store.

Section parsing works inside each row with regular-expression splits, so a corpus is
split without a shuffle. Only paragraph *lengths* cross into Python for the chunk
fold; texts never leave the JVM.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.functions import numeric, text
from murmur.functions.pages import page_main_text
from murmur.functions.loose import strip

# Sizes, labels and names that results depend on.
CHUNK_SIZE = 900
CHUNK_OVERLAP = 100
MIN_CHUNK_CHARS = 150
WHOLE_PAGE_CHARS = 1200
MIN_PAGE_CHARS = 80
MIN_KB_SECTION_CHARS = 160
MIN_SECTION_CHARS = 50
MIN_BODY_CHARS = 200
DEFAULT_TIER = "public"
SUMMARY_LABELS = [
    "What it is",
    "Who it's for",
    "What it does",
    "How it works",
    "How to run",
]
SUMMARY_FOOTERS = ["Sources:", "Evidence:", "Status:", "Source:", "One-page summary"]
MONTH_YEAR = ("(January|February|March|April|May|June|July|August|September|October|November|"
              r"December)\s+\d{4}")
SIZE_BUCKETS = [(150, "<150"), (300, "150-300"), (600, "300-600"), (900, "600-900")]
# end of fixed values


# --- pages -----------------------------------------------------------------

def extract_pages(pages: DataFrame, min_chars: int = MIN_PAGE_CHARS) -> DataFrame:
    """Title and main text of HTML pages; pages with too little text go."""
    tail = F.element_at(F.split("url", "/"), -1)
    out = pages.select(
        "page_id", "url", text.page_title(F.col("html")).alias("__t"),
        page_main_text(F.col("html")).alias("text"))
    title = F.coalesce(F.nullif(F.col("__t"), F.lit("")), F.nullif(tail, F.lit("")), F.lit("home"))
    return out.where(F.length("text") >= min_chars).withColumn("title", title).drop("__t")


# --- paragraphs and chunks ---------------------------------------------------

def paragraphs(body: Column) -> Column:
    """Blank-line separated paragraphs, inner white space collapsed, empties dropped."""
    parts = F.transform(F.split(body, "\n\n", -1), text.squash)
    return F.filter(parts, lambda p: p != "")


def split_paragraphs(docs: DataFrame, doc_id: str = "doc_id", body: str = "text") -> DataFrame:
    return docs.select(doc_id, F.posexplode(paragraphs(F.col(body))).alias(
        "paragraph_index", "paragraph"))


SPAN = "struct<first:int,last:int>"
PIECE = f"array<struct<first:int,last:int,parts:array<{SPAN}>>>"


def chunk_spans(lengths: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Paragraph index ranges of greedy chunks; both prefix sums are searched, not scanned."""
    n = len(lengths)
    filled = list(accumulate((x + 1 for x in lengths), initial=0))
    plain = list(accumulate(lengths, initial=0))
    spans, start = [], 0
    while start < n:
        stop = max(start + 1, bisect_right(filled, filled[start] + size + 1) - 1)
        spans.append((start, stop - 1))
        if stop >= n:
            break
        start = max(start + 1, bisect_left(plain, plain[stop] - overlap))
    return spans


def merge_spans(spans: list[tuple[int, int]], lengths: list[int], min_chars: int):
    """Join runs of short chunks forward; a short tail joins the last kept chunk.

    Yields (kept span, all spans whose texts form the chunk).
    """
    plain = list(accumulate(lengths, initial=0))
    size_of = lambda s: plain[s[1] + 1] - plain[s[0]] + 2 * (s[1] - s[0])
    merged, run, run_chars = [], [], 0
    for span in spans:
        run_chars += size_of(span) + (2 if run else 0)
        run.append(span)
        if run_chars >= min_chars:
            merged.append((span, run))
            run, run_chars = [], 0
    if run:
        if merged:
            kept, parts = merged[-1]
            merged[-1] = (kept, parts + run)
        else:
            merged.append((run[-1], run))
    return merged


def _pieces(lengths: Column, size: int, overlap: int, min_chars: int) -> Column:
    @F.pandas_udf(PIECE)
    def fold(batch: pd.Series) -> pd.Series:
        def one(values):
            sizes = [int(v) for v in values]
            return [{"first": kept[0], "last": kept[1],
                     "parts": [{"first": a, "last": b} for a, b in parts]}
                    for kept, parts in merge_spans(chunk_spans(sizes, size, overlap), sizes,
                                                   min_chars)]
        return batch.map(one)
    return fold(lengths)


def chunk(docs: DataFrame, keys: list[str], body: str = "text", size: int = CHUNK_SIZE,
          overlap: int = CHUNK_OVERLAP, min_chars: int = 0,
          whole_below: int | None = None) -> DataFrame:
    """Chunks per row: ``keys``, chunk_index, text, para_start, para_end, char_count.

    ``min_chars`` joins short chunks; texts up to ``whole_below`` characters stay whole.
    """
    prepared = (docs.select(*keys, F.col(body).alias("__body"))
                .withColumn("__paras", paragraphs(F.col("__body")))
                .withColumn("__pieces", _pieces(
                    F.transform("__paras", lambda p: F.length(p)), size, overlap, min_chars)))
    span_text = lambda s: F.array_join(
        F.slice(F.col("__paras"), s["first"] + 1, s["last"] - s["first"] + 1), "\n\n")
    built = F.transform("__pieces", lambda p: F.struct(
        F.array_join(F.transform(p["parts"], span_text), "\n\n").alias("text"),
        p["first"].alias("para_start"), p["last"].alias("para_end")))
    if whole_below is not None:
        whole = F.array(F.struct(F.col("__body").alias("text"), F.lit(0).alias("para_start"),
                                 F.lit(-1).alias("para_end")))
        built = F.when(F.length("__body") <= whole_below, whole).otherwise(built)
    return (prepared.select(*keys, F.posexplode(built).alias("chunk_index", "__c"))
            .select(*keys, "chunk_index", "__c.text", "__c.para_start", "__c.para_end",
                    F.length("__c.text").alias("char_count")))


# --- sections --------------------------------------------------------------

def _newlines(s: Column) -> Column:
    return F.size(F.split(s, "\n", -1)) - 1


def _header_lines(body: Column, low: int, high: int) -> Column:
    """Numbers of the lines that ``_header_split`` splits before, with 0 for the first part.

    They are found in one pass, so no part has to add up the lines of those before it.
    """
    mark = rf"^#{{{low},{high}}}[^\S\n]+[^\n]"
    at = F.transform(F.split(body, "\n", -1),
                     lambda line, i: F.when((i > 0) & line.rlike(mark), i))
    return F.concat(F.array(F.lit(0)), F.filter(at, lambda i: i.isNotNull()))


def _header_split(body: Column, low: int, high: int) -> Column:
    """Split before header lines of levels low..high (not at the very start)."""
    return F.split(body, rf"(?<=\n)(?=#{{{low},{high}}}[^\S\n]+[^\n])", -1)


def _header_level(s: Column) -> Column:
    return F.length(F.regexp_extract(s, r"^(#{1,6})[^\S\n]+[^\n]", 1))


def _header_title(s: Column) -> Column:
    return strip(F.regexp_extract(s, r"^#{1,6}[^\S\n]+([^\n]*)", 1))


def markdown_sections(docs: DataFrame, keys: list[str], body: str = "text", level: int = 2,
                      include_nested: bool = False) -> DataFrame:
    """Sections by header level: section_order, section_name, text, header_level, lines.

    Nested headers stay inside their section, or become sections named
    ``parent > child``. Text before the first target header is ``Preamble``; a document
    without any text yields one empty ``Full Document``.
    """
    outer = (docs.select(*keys, F.col(body).alias("__body"))
             .withColumn("__outer", _header_split(F.col("__body"), level, level))
             .withColumn("__first", F.get("__outer", F.lit(0)))
             .select(*keys, F.size("__outer").alias("__n_outer"),
                     (strip(F.col("__first")) == "").alias("__no_preamble"),
                     F.posexplode(F.arrays_zip(
                         F.col("__outer").alias("seg"),
                         _header_lines(F.col("__body"), level, level).alias("at")))
                     .alias("__i", "__o")))
    seg = F.col("__o.seg")
    is_target = _header_level(seg) == level
    base = F.when(is_target, _header_title(seg)).otherwise("Preamble")
    nested = F.array(seg) if include_nested else _header_split(seg, level + 1, 6)
    lines = F.array(F.lit(0)) if include_nested else _header_lines(seg, level + 1, 6)
    titles = F.transform("__inner", lambda s, j: F.when(j == 0, F.col("__base")).otherwise(
        _header_title(s)))
    # Names add up along nested headers; a part carries its own name and line only.
    names = F.transform("__titles", lambda t, j: F.array_join(
        F.slice("__titles", F.lit(1), j + 1), " > "))
    parts = (outer.select(
        *keys, "__i", "__no_preamble", is_target.alias("__target"), base.alias("__base"),
        nested.alias("__inner"), lines.alias("__lines"), F.col("__o.at").alias("__at"),
        (F.col("__i") == F.col("__n_outer") - 1).alias("__last_outer"))
        .withColumn("__titles", titles)
        .select(*keys, "__i", "__no_preamble", "__target", "__at", "__last_outer",
                F.size("__inner").alias("__n_inner"),
                F.posexplode(F.arrays_zip(F.col("__inner").alias("s"), F.col("__lines").alias("at"),
                                          names.alias("name"))).alias("__j", "__p")))
    start = F.col("__at") + F.col("__p.at")
    is_last = F.col("__last_outer") & (F.col("__j") == F.col("__n_inner") - 1)
    named = parts.select(
        *keys, "__i", "__j", "__no_preamble",
        F.col("__p.name").alias("section_name"), strip(F.col("__p.s")).alias("text"),
        F.when((F.col("__j") == 0) & ~F.col("__target"), 0).otherwise(
            _header_level(F.col("__p.s"))).alias("header_level"),
        start.alias("start_line"),
        (start + _newlines(F.col("__p.s")) - F.when(is_last, 0).otherwise(1)).alias("end_line"),
        is_last.alias("__is_last"))
    empty_doc = (F.col("__i") == 0) & F.col("__is_last")
    # Only the text before the first header can be blank, so with nested headers kept
    # inside, the position among kept sections needs no window.
    order = (F.col("__i") - F.when(F.col("__no_preamble") & (F.col("__i") > 0), 1).otherwise(0)
             ).cast("bigint")
    place = (order.alias("section_order") if include_nested
             else F.struct("__i", "__j").alias("section_position"))
    return named.where((F.col("text") != "") | empty_doc).select(
        *keys, place,
        F.when(F.col("text") == "", "Full Document").otherwise(F.col("section_name"))
        .alias("section_name"), "text", "header_level", "start_line", "end_line")


def with_section_order(sections: DataFrame, doc: str) -> DataFrame:
    """0-based position for sections that carry section_position, spread over blocks."""
    from murmur.scale import Running, running

    block = F.floor(F.col("section_position.__i") / 1000)
    out = running(sections, [doc], ["section_position"], block,
                  [Running("section_order", "count", F.lit(1), inclusive=False)])
    return out.withColumn("section_order", F.coalesce("section_order", F.lit(0)))


def section_forward_fill(docs: DataFrame, doc: str = "doc_id", body: str = "text",
                         level: int = 2) -> DataFrame:
    """Every line with the last header of the level above it; very long documents are split."""
    from murmur.scale import Running, running

    lines = docs.select(doc, F.posexplode(F.split(body, "\n", -1)).alias("line_number", "line"))
    title = F.when(_header_level(F.col("line")) == level, _header_title(F.col("line")))
    out = running(lines, [doc], ["line_number"], F.floor(F.col("line_number") / 1000),
                  [Running("section_name", "last", title)])
    return out.withColumn("section_name", F.coalesce("section_name", F.lit("Preamble")))


def delimiter_sections(docs: DataFrame, keys: list[str], body: str = "text",
                       delimiter: str = "======") -> DataFrame:
    """Sections between delimiter lines, titled by the line above the delimiter.

    The title line stays at the end of the section before it as well.
    """
    import re

    mark = rf"(?:^|\n)[^\S\n]*{re.escape(delimiter.strip())}[^\S\n]*(?=\n|$)"
    split = docs.select(*keys, F.split(F.col(body), mark, -1).alias("__segs"))
    tail = lambda s: strip(F.regexp_extract(s, r"([^\n]*)$", 1))
    named = F.transform("__segs", lambda s, i: F.struct(
        F.when(F.size("__segs") == 1, "Full Document").when(i == 0, "Preamble").otherwise(
            F.coalesce(F.nullif(tail(F.get("__segs", i - 1)), F.lit("")),
                       F.lit("Untitled Section"))).alias("section_name"),
        strip(s).alias("text")))
    return (split.select(*keys, F.size("__segs").alias("__n"),
                         F.posexplode(named).alias("section_order", "__s"))
            .where((F.col("__s.text") != "") | (F.col("__n") == 1))
            .select(*keys, "section_order", "__s.section_name", "__s.text"))


def labelled_sections(docs: DataFrame, keys: list[str], body: str = "text",
                      labels: list[str] | None = None,
                      footers: list[str] | None = None) -> DataFrame:
    """One-page summaries: title block, labelled sections, footer and its date, as columns.

    ``sections`` maps label → text; when a label repeats, its last text counts.
    """
    import re

    labels, footers = labels or SUMMARY_LABELS, footers or SUMMARY_FOOTERS
    is_footer = lambda s: F.ltrim(s).rlike("^(?:" + "|".join(map(re.escape, footers)) + ")")
    any_label = "(" + "|".join(map(re.escape, labels)) + ")"
    lines = F.split(F.col(body), "\n", -1)
    kept = docs.select(*keys, F.array_join(F.filter(lines, lambda s: ~is_footer(s)), "\n")
                       .alias("__kept"),
                       F.array_join(F.transform(F.filter(lines, is_footer), strip), "\n")
                       .alias("footer"))
    segs = kept.withColumn("__segs", F.split(
        F.concat(F.lit("\n"), F.col("__kept")), rf"\n(?=[^\S\n]*{any_label})", -1))
    found = F.transform(
        F.filter(F.slice("__segs", 2, F.greatest(F.size("__segs") - 1, F.lit(0))),
                 lambda s: s.contains("\n")),
        lambda s: F.struct(F.regexp_extract(s, rf"^[^\S\n]*{any_label}", 1).alias("key"),
                           strip(F.regexp_replace(s, r"^[^\n]*\n", "")).alias("value")))
    title = F.array_join(F.filter(F.transform(F.split(F.get("__segs", F.lit(0)), "\n", -1), strip),
                                  lambda s: s != ""), " ")
    names = F.array_distinct(F.transform("__found", lambda e: e["key"]))
    last = F.map_from_entries(F.transform(names, lambda k: F.struct(
        k.alias("key"), F.element_at(F.filter(F.col("__found"), lambda e: e["key"] == k), -1)
        ["value"].alias("value"))))
    return segs.withColumn("__found", found).select(
        *keys, F.when(F.size("__segs") > 1, title).alias("title"), last.alias("sections"),
        "footer", F.nullif(F.regexp_extract("footer", MONTH_YEAR, 0), F.lit("")).alias("date"))


def summary_chunks(parsed: DataFrame, keys: list[str], include_how_to_run: bool = False,
                   labels: list[str] | None = None) -> DataFrame:
    """Overview chunk (title + first two labels) followed by the labelled sections."""
    labels = labels or SUMMARY_LABELS
    wanted = [x for x in labels if include_how_to_run or x != "How to run"]
    part = lambda k: F.nullif(F.col("sections")[k], F.lit(""))
    overview = F.concat_ws("\n\n", F.nullif(text.clean_title(F.col("title")), F.lit("")),
                           part(labels[0]), part(labels[1]))
    rows = F.filter(F.array(
        F.struct(F.lit("overview").alias("label"), F.nullif(overview, F.lit("")).alias("text")),
        *[F.struct(F.lit(x).alias("label"), part(x).alias("text")) for x in wanted]),
        lambda r: r["text"].isNotNull())
    return (parsed.select(*keys, F.posexplode(rows).alias("chunk_index", "__r"))
            .select(*keys, "chunk_index", "__r.label", "__r.text"))


# --- metadata and the chunk pipeline ---------------------------------------------

def sensitivity_of(rows: DataFrame, tiers: DataFrame, source_type: str = "source_type"
                   ) -> DataFrame:
    """Tier per source type from a mapping table; unlisted types are public."""
    mapping = tiers.select(F.col("source_type").alias("__st"), F.col("tier").alias("__tier"))
    return (rows.join(mapping, F.col(source_type) == F.col("__st"), "left")
            .withColumn("sensitivity", F.coalesce("__tier", F.lit(DEFAULT_TIER)))
            .drop("__st", "__tier"))


def chunk_metadata(rows: DataFrame, tiers: DataFrame, identifier: str, section: str | None,
                   extras: dict[str, Column] | None = None,
                   explicit_tier: str | None = None) -> DataFrame:
    """source, section, chunk_index, sensitivity (explicit wins) and extra attributes."""
    out = sensitivity_of(rows, tiers)
    if explicit_tier:
        out = out.withColumn("sensitivity", F.coalesce(explicit_tier, "sensitivity"))
    pairs = [F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
             for k, v in (extras or {}).items()]
    attrs = (F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["value"].isNotNull()))
             if pairs else F.create_map().cast("map<string,string>"))
    return out.withColumns({
        "source": F.concat_ws(":", F.col("source_type"), F.col(identifier)),
        "section": F.col(section) if section else F.lit(None).cast("string"),
        "attrs": attrs})


def chunk_id(source: Column, section: Column, index: Column) -> Column:
    """Stable id, so a re-run writes the same rows."""
    return F.md5(F.concat_ws("\u0001", source, F.coalesce(section, F.lit("")),
                             index.cast("string")))


def kb_chunks(docs: DataFrame, tiers: DataFrame, identifier: str, body: str = "text",
              size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
              min_chars: int = MIN_CHUNK_CHARS) -> DataFrame:
    """Documents → sections ≥ 160 chars → chunks with metadata and the document hash."""
    hashed = docs.withColumn("content_hash", F.sha2(F.col(body), 256))
    keys = ["source_type", identifier, "content_hash"]
    sections = markdown_sections(hashed, keys, body, level=2, include_nested=True)
    long_enough = sections.where(F.length("text") >= MIN_KB_SECTION_CHARS)
    pieces = chunk(long_enough, [*keys, "section_name"], "text", size, overlap, min_chars)
    labelled = pieces.withColumn("text", F.concat(F.lit("["), F.col("section_name"),
                                                  F.lit("]\n"), F.col("text")))
    tagged = chunk_metadata(labelled, tiers, identifier, "section_name",
                            {"para_start": F.col("para_start")})
    return tagged.select(
        chunk_id(F.col("source"), F.col("section"), F.col("chunk_index")).alias("id"),
        "source", "source_type", "section", "chunk_index", "sensitivity", "text",
        F.length("text").alias("char_count"), "content_hash", "attrs")


# --- upkeep ----------------------------------------------------------------

def new_sections(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks of (source, section) pairs the store does not hold yet."""
    known = stored.select("source", "section").distinct()
    return candidates.join(known, ["source", "section"], "left_anti")


def replace_source(stored: DataFrame, fresh: DataFrame, prefix: str) -> DataFrame:
    """Forced refresh: rows of the source prefix replaced by ``fresh``."""
    kept = stored.where(~F.col("source").startswith(prefix))
    return kept.unionByName(fresh, allowMissingColumns=True)


def upsert_sections(stored: DataFrame, current: DataFrame) -> DataFrame:
    """New snapshot: unchanged hash keeps its vector, changed or new text gets a null one.

    Stored sections of documents that are not in ``current`` stay as they are.
    """
    s = stored.select(F.col("section_id"), *[F.col(c).alias(f"__s_{c}") for c in
                                             stored.columns if c != "section_id"])
    joined = current.join(s, "section_id", "full_outer")
    only_stored = F.col("content_hash").isNull()
    same = F.col("__s_content_hash") == F.col("content_hash")
    columns = [F.when(only_stored, F.col(f"__s_{c}")).otherwise(F.col(c)).alias(c)
               for c in current.columns if c != "section_id"]
    state = (F.when(only_stored, "kept").when(F.col("__s_content_hash").isNull(), "new")
             .when(same, "unchanged").otherwise("changed"))
    vector = F.when(only_stored | same, F.col("__s_embedding"))
    return joined.select("section_id", *columns, vector.alias("embedding"), state.alias("state"))


def ingest_gate(posts: DataFrame, body: str = "body", published: str = "published") -> DataFrame:
    """Reject reason per document, null when accepted."""
    reason = (F.when(~F.coalesce(F.col(published), F.lit(True)), "draft")
              .when(F.length(F.col(body)) < MIN_BODY_CHARS, "too_short"))
    return posts.withColumn("reject_reason", reason)


def drift_check(registry: DataFrame, files: DataFrame, stored: DataFrame) -> DataFrame:
    """Registry ↔ files ↔ stored hashes. ``stored`` rows carry source, id, content_hash."""
    first = stored.groupBy("source").agg(
        F.min("id").isNotNull().alias("__embedded"),
        F.min_by(F.struct("content_hash"), "id").alias("__h"))
    status = (F.when(F.col("file_hash").isNull(), "missing")
              .when(F.col("__embedded").isNull(), "not embedded")
              .when(F.col("__h.content_hash").isNull(), "unhashed")
              .when(F.col("__h.content_hash") == F.col("file_hash"), "in sync")
              .otherwise("drifted"))
    return (registry.join(files.select("source", "file_hash"), "source", "left")
            .join(first, "source", "left").select("source", status.alias("status")))


def orphan_documents(stored_docs: DataFrame, current: DataFrame,
                     source_types: list[str]) -> DataFrame:
    """Stored documents of the given types that no longer exist."""
    return (stored_docs.where(F.col("source_type").isin(source_types))
            .join(current.select("doc_id"), "doc_id", "left_anti"))


def drop_orphans(stored_docs: DataFrame, stored_sections: DataFrame, current: DataFrame,
                 source_types: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sections to delete, surviving documents, surviving sections)."""
    gone = orphan_documents(stored_docs, current, source_types).select("doc_id")
    return (stored_sections.join(gone, "doc_id", "left_semi"),
            stored_docs.join(gone, "doc_id", "left_anti"),
            stored_sections.join(gone, "doc_id", "left_anti"))


def retract_counts(stored: DataFrame, targets: DataFrame) -> DataFrame:
    """Chunks each exact target source would lose; 0 for targets that match nothing."""
    counts = stored.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return targets.join(counts, "source", "left").select(
        "source", F.coalesce("n", F.lit(0)).alias("chunks"))


def retract(stored: DataFrame, targets: DataFrame, dry_run: bool = True) -> DataFrame:
    """Surviving table; a dry run changes nothing."""
    return stored if dry_run else stored.join(targets.select("source"), "source", "left_anti")


def embedding_backfill(sections: DataFrame, cache: DataFrame) -> DataFrame:
    """Sections without a vector: reuse a cached one by text hash, or mark to embed."""
    missing = sections.where(F.col("embedding").isNull()).drop("embedding").withColumn(
        "text_hash", F.md5("full_text"))
    return missing.join(cache.select("text_hash", "embedding"), "text_hash", "left").withColumn(
        "action", F.when(F.col("embedding").isNull(), "embed").otherwise("reuse"))


def browse(chunks: DataFrame, source_type: str | None = None, needle: str | None = None
           ) -> DataFrame:
    """Chunks by source type and case-insensitive text in any of four fields."""
    out = chunks.withColumns({
        "source_type": text.source_type_of(F.col("source")),
        "source_id": text.source_id_of(F.col("source")),
        "section": F.coalesce("section", F.lit("—"))})
    if source_type and source_type != "All":
        out = out.where(F.col("source_type") == source_type)
    if needle and needle.strip():
        q = F.lit(needle.strip().lower())
        hit = F.lit(False)
        for c in ("text", "source_type", "section", "source_id"):
            hit = hit | F.contains(F.lower(c), q)
        out = out.where(hit)
    return out


def browse_page(found: DataFrame, n: int = 100, order: str = "id") -> DataFrame:
    return found.orderBy(order).limit(n)


def browse_total(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("total"))


def chunk_detail(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Full rows of the chunks whose ids are asked for."""
    return chunks.join(wanted.select("id"), "id", "left_semi")


# --- audits ----------------------------------------------------------------

def source_type_counts(chunks: DataFrame) -> DataFrame:
    """Per source type: chunks, share, distinct sources and sections, with/without section."""
    per_section = chunks.groupBy(text.source_type_of(F.col("source")).alias("source_type"),
                                 "source", "section").agg(F.count(F.lit(1)).alias("n"))
    per_source = per_section.groupBy("source_type", "source").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("section").isNotNull(), F.col("n")).otherwise(0)).alias("with_section"),
        F.count("section").alias("sections"))
    grouped = per_source.groupBy("source_type").agg(
        F.sum("n").alias("chunks"), F.count(F.lit(1)).alias("sources"),
        F.sum("with_section").alias("with_section"),
        F.sum("sections").alias("sections"))
    total = F.sum("chunks").over(Window.partitionBy(F.lit(0)))
    return grouped.withColumns({
        "without_section": F.col("chunks") - F.col("with_section"),
        "share_pct": 100.0 * F.col("chunks") / total})


def top_sources(chunks: DataFrame, n: int = 5) -> DataFrame:
    """The n largest sources of each source type."""
    counts = chunks.groupBy(text.source_type_of(F.col("source")).alias("source_type"),
                            "source").agg(F.count(F.lit(1)).alias("chunks"))
    w = Window.partitionBy("source_type").orderBy(F.col("chunks").desc(), "source")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def chunk_audit(chunks: DataFrame) -> DataFrame:
    """Size statistics per source type and overall (source_type null)."""
    size = F.length("text")
    return (chunks.withColumn("source_type", text.source_type_of(F.col("source")))
            .rollup("source_type").agg(
                F.count(F.lit(1)).alias("chunks"), F.min(size).alias("min_chars"),
                F.max(size).alias("max_chars"),
                F.expr("sum(length(text)) div count(1)").alias("avg_chars"),
                F.count_if(size < numeric.TINY_CHARS).alias("tiny")))


def chunk_size_hist(chunks: DataFrame) -> DataFrame:
    size = F.length("text")
    bucket = F.when(size < SIZE_BUCKETS[0][0], SIZE_BUCKETS[0][1])
    for bound, label in SIZE_BUCKETS[1:]:
        bucket = bucket.when(size < bound, label)
    return chunks.groupBy(bucket.otherwise(">900").alias("bucket")).agg(
        F.count(F.lit(1)).alias("chunks"))


def tiny_chunks(chunks: DataFrame, n: int = 20, order: str = "id") -> DataFrame:
    return chunks.where(F.length("text") < numeric.TINY_CHARS).orderBy(order).limit(n)
