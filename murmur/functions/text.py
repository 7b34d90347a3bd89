"""Text helpers shared by batch and streaming jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from murmur.functions.loose import strip

# Patterns and word lists that results depend on.
EMAIL_PATTERN = r"(?U)[\w\.-]+@[\w\.-]+\.\w+"
PHONE_PATTERN = r"(?U)\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}\b"
LINK_PATTERN = r"(?i)\[[^\]]+\]\([^)]+\)|https?://\S+"
BULLET_PATTERN = r"(?m)^\s*(?:[-*]|\d+\.)\s+"
FOLLOWUP_PHRASES = [
    r"\blet me know\b",
    r"\bif you want\b",
    r"\bif you['']re curious\b",
    r"\bwant me to\b",
    r"\bhappy to\b",
    r"\bI can walk through\b",
    r"\bI can talk more\b",
    r"\bI can share more\b",
]
PROMPT_MARKS = "\"'?!.,:;—-()"
TECH_KEYWORDS = [
    "Streamlit", "Gradio", "Neo4j", "ChromaDB", "OpenAI", "SQLite",
    "Ollama", "NetworkX", "Folium", "MySQL", "FastAPI", "Flask",
    "PostgreSQL", "MongoDB", "Pinecone", "LangChain", "DSPy",
    "MLflow", "SpatiaLite", "Plotly", "Matplotlib", "PyTorch",
    "Google Cloud Vision", "Open-Meteo", "KMeans", "BeautifulSoup",
    "Anthropic", "Claude",
]
# end of fixed values

WORD = r"[\p{L}\p{N}_]+"


def redact_pii(text: Column) -> Column:
    """E-mail addresses and US phone numbers masked; null becomes ''."""
    masked = F.regexp_replace(text, EMAIL_PATTERN, "[EMAIL]")
    return F.coalesce(F.regexp_replace(masked, PHONE_PATTERN, "[PHONE]"), F.lit(""))


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(
        F.concat(F.substring(text, 1, n - 1), F.lit("…")))


def response_preview(text: Column, n: int = 300) -> Column:
    """One-line preview of at most ``n`` characters."""
    return truncate(strip(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" "))), n)


def squash(text: Column) -> Column:
    """Runs of white space become one blank; ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_prompt(text: Column) -> Column:
    bare = F.translate(squash(F.lower(F.coalesce(text, F.lit("")))), PROMPT_MARKS, "")
    return squash(bare)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD))


def words(text: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1))


def has_link(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(LINK_PATTERN)


def has_followup(text: Column) -> Column:
    """Cheap substring test first; the word-boundary pattern only runs on likely texts."""
    low = F.lower(F.coalesce(text, F.lit("")))
    likely = F.lit(False)
    for phrase in FOLLOWUP_PHRASES:
        likely = likely | F.contains(low, F.lit(
            phrase.replace(r"\b", "").lower().rsplit("]", 1)[-1]))
    return F.when(likely, low.rlike("(?iU)" + "|".join(FOLLOWUP_PHRASES))).otherwise(F.lit(False))


def markdown_level(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    signals = (t.rlike(BULLET_PATTERN).cast("int")
               + (t.contains("**") | t.contains("__")).cast("int")
               + t.contains("#").cast("int")
               + has_link(t).cast("int"))
    return F.when(signals == 0, "none").when(signals == 1, "light").otherwise("strong")


def matching_terms(text: Column, terms: list[str]) -> Column:
    """Terms of a short fixed list found in the text, ignoring case, in list order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    listed = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    return F.filter(listed, lambda t: F.contains(low, F.lower(t)))


def tech_stack_tags(text: Column, keywords: list[str] | None = None) -> Column:
    return F.array_join(matching_terms(text, keywords or TECH_KEYWORDS), ",")


def slugify(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug_from_filename(path: Column) -> Column:
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"(?i)\.pdf$", "")
    return F.lower(F.regexp_replace(
        name, r"(?i)[-_](one-pager|onepager|summary|one_pager)$", ""))


def clean_title(raw: Column) -> Column:
    out = strip(F.regexp_replace(raw, r"(?i)\s*[—–-]+\s*One.?Page.*$", ""))
    out = strip(F.regexp_replace(out, r"(?i)\s*\(One.?Page.*\)\s*$", ""))
    return F.when(out == "", raw).otherwise(out)


def clean_body(text: Column) -> Column:
    """Template tags and inline HTML removed, blank lines collapsed."""
    out = F.regexp_replace(text, r"\{%[^%]*%\}", "")
    out = F.regexp_replace(out, r"\{\{[^}]*\}\}", "")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def has_front_matter(raw: Column) -> Column:
    return raw.startswith("---") & (F.size(F.split(raw, "---", 3)) >= 3)


def front_matter_map(raw: Column) -> Column:
    """Flat ``key: value`` header lines as a map; empty without a header."""
    header = F.when(has_front_matter(raw), F.split(raw, "---", 3)[1]).otherwise(F.lit(""))
    lines = F.filter(F.split(header, "\n"), lambda s: s.contains(":"))
    pairs = F.transform(lines, lambda s: F.struct(
        strip(F.substring_index(s, ":", 1)).alias("key"),
        F.regexp_replace(strip(F.regexp_replace(s, r"^[^:]*:", "")), r"^[\"']|[\"']$", "")
        .alias("value")))
    last = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_entries(F.transform(last, lambda k: F.struct(
        k.alias("key"),
        F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"].alias("value"))))


def front_matter_body(raw: Column) -> Column:
    return F.when(has_front_matter(raw), strip(F.split(raw, "---", 3)[2])).otherwise(raw)


def date_from_filename(name: Column) -> Column:
    return F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2})-", 1)


def doc_id_for(source_type: Column, permalink: Column, stem: Column) -> Column:
    key = F.coalesce(F.nullif(F.regexp_replace(permalink, "^/+|/+$", ""), F.lit("")), stem)
    return F.concat(source_type, F.lit(":"), key)


def source_type_of(source: Column) -> Column:
    return F.substring_index(source, ":", 1)


def source_id_of(source: Column) -> Column:
    return F.when(source.contains(":"), F.regexp_replace(source, r"(?s)^[^:]*:", "")).otherwise("")


def provider_of_model(model: Column) -> Column:
    return F.when(model.contains("/"), F.substring_index(model, "/", 1)).otherwise("openai")


def format_duration(seconds: Column) -> Column:
    s = F.floor(seconds).cast("bigint")
    text = (F.when(s >= 3600, F.format_string("%dh %dm", F.floor(s / 3600),
                                              F.floor(s % 3600 / 60)))
            .when(s >= 60, F.format_string("%dm %ds", F.floor(s / 60), s % 60))
            .otherwise(F.format_string("%ds", s)))
    return F.when(seconds.isNull(), "—").otherwise(text)


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a non-empty literal term."""
    gone = F.length(text) - F.length(F.replace(text, term, F.lit("")))
    return F.when(F.length(term) > 0, F.floor(gone / F.length(term))).otherwise(F.lit(0))


# --- pages -----------------------------------------------------------------

def page_title(html: Column) -> Column:
    return unescape(strip(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def unescape(text: Column) -> Column:
    for entity, char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                         ("&nbsp;", " "), ("&amp;", "&")]:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def url_path(url: Column, base: Column | None = None) -> Column:
    """Path of a URL without its base and outer slashes; 'home' when empty."""
    if base is None:
        rest = F.regexp_replace(url, r"^[a-zA-Z]+://[^/]+", "")
    else:
        rest = F.replace(url, F.regexp_replace(base, "/+$", ""), F.lit(""))
    rest = F.regexp_replace(rest, "^/+|/+$", "")
    return F.when(rest == "", "home").otherwise(rest)


def path_matches(url: Column, prefixes: list[str], base: Column | None = None) -> Column:
    path = F.concat(F.lit("/"), url_path(url, base))
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | path.startswith(p.rstrip("/") or "/")
    return hit


def path_filter(url: Column, include: list[str] | None = None,
                exclude: list[str] | None = None, base: Column | None = None) -> Column:
    """Keep-predicate by path prefix; an include list wins over an exclude list."""
    if include:
        return path_matches(url, include, base)
    if exclude:
        return ~path_matches(url, exclude, base)
    return F.lit(True)
