"""Registered scalar and text queries, over whole documents, pages and turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.catalog.registry import query
from murmur.catalog.sqlparts import (CATALOGUE, DOCS, LOG, USER_MESSAGES, big, quantile, with_,
                                     words)
from murmur.functions import numeric, text
from murmur.operators import enrich, projects
from murmur.sources import tables

W = r"[\p{L}\p{N}_]"
REDACT = (r"regexp_replace(regexp_replace({x}, '[\p{{L}}\p{{N}}_\.-]+@[\p{{L}}\p{{N}}_\.-]+\.[\p{{L}}\p{{N}}_]+', "
          r"'[EMAIL]', 'g'), '\b(?:\+?1[-.\s]?)?(?:\(?\d{{3}}\)?[-.\s]?)\d{{3}}[-.\s]?\d{{4}}\b', '[PHONE]', 'g')")


def redact_sql(x: str) -> str:
    return REDACT.format(x=x)


def truncate_sql(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE concat(substr({x}, 1, {n - 1}), '…') END"


def _docs(spark, sf):
    return tables.documents(spark, sf)


@query("redact_pii", f"SELECT doc_id, {redact_sql('text')} AS redacted FROM documents")
def redact_pii(spark, sf):
    return _docs(spark, sf).select("doc_id", text.redact_pii(F.col("text")).alias("redacted"))


ONE_LINE = r"regexp_replace(replace(text, chr(10), ' '), '^\s+|\s+$', '', 'g')"


@query("response_preview", f"""SELECT conv_id, turn, {truncate_sql(ONE_LINE, 300)} AS preview
FROM conversations WHERE role = 'assistant'""")
def response_preview(spark, sf):
    return tables.history(spark, sf).where(F.col("role") == "assistant").select(
        "conv_id", "turn", text.response_preview(F.col("text")).alias("preview"))


@query("truncate_text", f"SELECT doc_id, {truncate_sql('text', 100)} AS short FROM documents")
def truncate_text(spark, sf):
    return _docs(spark, sf).select("doc_id", text.truncate(F.col("text"), 100).alias("short"))


@query("normalize_prompt", with_(USER_MESSAGES) + r"""
SELECT message_id, trim(regexp_replace(translate(trim(regexp_replace(lower(message), '\s+', ' ', 'g')),
  '"''?!.,:;—-()', ''), '\s+', ' ', 'g')) AS prompt FROM um""")
def normalize_prompt(spark, sf):
    return tables.messages(spark, sf).select(
        "message_id", text.normalize_prompt(F.col("message")).alias("prompt"))


@query("sim_from_l2", with_(LOG) + """
SELECT row_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - d * d / 2.0::DOUBLE)) AS sim
FROM (SELECT row_id, latency_ms / 5000.0::DOUBLE AS d FROM log)""")
def sim_from_l2(spark, sf):
    d = F.col("latency_ms") / 5000.0
    return tables.query_log(spark, sf).select("row_id", numeric.sim_from_l2(d).alias("sim"))


@query("sim_from_cosdist", with_(LOG) + """
SELECT row_id, CASE WHEN chunk_similarity_avg IS NOT NULL THEN
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - 2.0::DOUBLE * chunk_similarity_avg)) END AS sim FROM log""")
def sim_from_cosdist(spark, sf):
    d = 2.0 * F.col("chunk_similarity_avg")
    return tables.query_log(spark, sf).select(
        "row_id", numeric.sim_from_cosine_distance(d).alias("sim"))


@query("l2_from_score", with_(LOG) + """
SELECT row_id, sqrt(greatest(0.0::DOUBLE, 2.0::DOUBLE * (1.0::DOUBLE - chunk_similarity_avg))) AS l2
FROM log WHERE chunk_similarity_avg IS NOT NULL""")
def l2_from_score(spark, sf):
    return tables.query_log(spark, sf).where(F.col("chunk_similarity_avg").isNotNull()).select(
        "row_id", numeric.l2_from_score(F.col("chunk_similarity_avg")).alias("l2"))


@query("sim_stats", with_(LOG, """
h AS (SELECT model, CAST(ts AS DATE) AS day,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - d * d / 2.0::DOUBLE)) AS sim
  FROM (SELECT *, n_chunks_retrieved / 8.0::DOUBLE AS d FROM chats))""") + """
SELECT model, day, round_even(CAST(sum(CAST(sim AS DECIMAL(20,9))) AS DOUBLE) / count(sim), 3) AS similarity_avg,
  round_even(max(sim), 3) AS similarity_max FROM h GROUP BY 1, 2""")
def sim_stats(spark, sf):
    hits = tables.chat_log(spark, sf).select(
        "model", F.to_date("ts").alias("day"), (F.col("n_chunks_retrieved") / 8.0).alias("distance"))
    return enrich.sim_stats(hits, ["model", "day"])


@query("sim_band", with_(LOG) + f"""
SELECT CASE WHEN chunk_similarity_avg IS NULL THEN 'none' WHEN chunk_similarity_avg >= 0.75 THEN 'strong'
  WHEN chunk_similarity_avg >= 0.55 THEN 'moderate' ELSE 'weak' END AS band, {big('count(*)')} AS n
FROM chats GROUP BY 1""")
def sim_band(spark, sf):
    return tables.chat_log(spark, sf).groupBy(
        numeric.sim_band(F.col("chunk_similarity_avg")).alias("band")).agg(
        F.count(F.lit(1)).alias("n"))


@query("provider_of_model", with_(LOG) + """
SELECT row_id, CASE WHEN contains(m, '/') THEN split_part(m, '/', 1) ELSE 'openai' END AS provider
FROM (SELECT row_id, CASE WHEN tool_called THEN split_part(model, '/', 2) ELSE model END AS m FROM log)""")
def provider_of_model(spark, sf):
    m = F.when(F.col("tool_called"), F.substring_index("model", "/", -1)).otherwise(F.col("model"))
    return tables.query_log(spark, sf).select(
        "row_id", text.provider_of_model(m).alias("provider"))


@query("source_split", with_(DOCS) + """
SELECT doc_id, source_type, concat(source, ':', lang) AS source_id,
  coalesce(CASE WHEN lang <> 'en' THEN lang END, '—') AS section, length(text) AS chars,
  replace(substr(text, 1, 120), chr(10), ' ') AS preview FROM docs""")
def source_split(spark, sf):
    source = F.concat_ws(":", "source_type", "source", "lang")
    section = F.when(F.col("lang") != "en", F.col("lang"))
    return _docs(spark, sf).select(
        "doc_id", text.source_type_of(source).alias("source_type"),
        text.source_id_of(source).alias("source_id"),
        F.coalesce(section, F.lit("—")).alias("section"), F.length("text").alias("chars"),
        F.replace(F.substring("text", 1, 120), F.lit("\n"), F.lit(" ")).alias("preview"))


@query("word_count", rf"""
SELECT doc_id, {big(f"len(regexp_extract_all(text, '{W}+'))")} AS words FROM documents""")
def word_count(spark, sf):
    return _docs(spark, sf).select(
        "doc_id", text.word_count(F.col("text")).cast("bigint").alias("words"))


LINK_SQL = r"regexp_matches({x}, '(?i)\[[^\]]+\]\([^)]+\)|https?://\S+')"
MARKDOWN_SIGNALS = (r"(CAST(regexp_matches({x}, '(?m)^\s*(?:[-*]|\d+\.)\s+') AS INT) "
                    r"+ CAST(contains({x}, '**') OR contains({x}, '__') AS INT) "
                    r"+ CAST(contains({x}, '#') AS INT) + CAST(" + LINK_SQL + " AS INT))")
MARKDOWN_SQL = ("CASE WHEN " + MARKDOWN_SIGNALS + " = 0 THEN 'none' WHEN " + MARKDOWN_SIGNALS
                + " = 1 THEN 'light' ELSE 'strong' END")


@query("markdown_level", f"SELECT doc_id, {MARKDOWN_SQL.format(x='text')} AS level FROM documents")
def markdown_level(spark, sf):
    return _docs(spark, sf).select("doc_id", text.markdown_level(F.col("text")).alias("level"))


@query("has_link", f"SELECT page_id, {LINK_SQL.format(x='html')} AS has_link FROM pages")
def has_link(spark, sf):
    return tables.table(spark, sf, "pages").select(
        "page_id", text.has_link(F.col("html")).alias("has_link"))


FOLLOWUP_SQL = ("regexp_matches({x}, '(?i)\\blet me know\\b|\\bif you want\\b|\\bif you['']re curious\\b|"
                "\\bwant me to\\b|\\bhappy to\\b|\\bI can walk through\\b|\\bI can talk more\\b|\\bI can share more\\b')")


@query("has_followup", f"""SELECT conv_id, turn, {FOLLOWUP_SQL.format(
    x="concat(text, CASE WHEN turn % 4 = 1 THEN ' Happy TO explain' ELSE '' END)")} AS has_followup FROM conversations""")
def has_followup(spark, sf):
    said = F.concat("text", F.when(F.col("turn") % 4 == 1, " Happy TO explain").otherwise(""))
    return tables.history(spark, sf).select(
        "conv_id", "turn", text.has_followup(said).alias("has_followup"))


NAMES = ["thble", "Nicht", "erble", "que", "the thing"]


@query("projects_mentioned", "SELECT doc_id, list_filter(['thble','Nicht','erble','que','the thing'], "
       "lambda p: contains(lower(text), lower(p))) AS projects FROM documents")
def projects_mentioned(spark, sf):
    return projects.projects_mentioned(_docs(spark, sf), NAMES).select("doc_id", "projects")


@query("tech_stack_tags", "SELECT doc_id, array_to_string(list_filter(['thble','Nicht','erble','que'], "
       "lambda p: contains(lower(text), lower(p))), ',') AS tags FROM documents")
def tech_stack_tags(spark, sf):
    return _docs(spark, sf).select(
        "doc_id", text.tech_stack_tags(F.col("text"), NAMES[:4]).alias("tags"))


@query("slugify", """SELECT item_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') AS slug
FROM benchmark""")
def slugify(spark, sf):
    return tables.table(spark, sf, "benchmark").select(
        "item_id", text.slugify(F.col("text")).alias("slug"))


@query("slug_from_filename", r"""SELECT doc_id, lower(concat(source, '-', doc_id)) AS slug FROM documents""")
def slug_from_filename(spark, sf):
    suffix = F.element_at(F.array(*[F.lit(s) for s in
                                    ["-one-pager", "_summary", "-onepager", ""]]),
                          (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("in/"), F.upper("source"), F.lit("-"), F.col("doc_id"), suffix,
                    F.lit(".PDF"))
    return _docs(spark, sf).select("doc_id", text.slug_from_filename(path).alias("slug"))


@query("clean_title", with_(CATALOGUE) + "SELECT project_id, trim(title) AS title FROM cat")
def clean_title(spark, sf):
    raw = F.concat("title", F.when(F.col("order") % 2 == 0, " — One-Page Summary")
                   .otherwise(" (One Page Summary)"))
    return tables.catalogue(spark, sf).select("project_id", text.clean_title(raw).alias("title"))


@query("clean_body", r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(html, '\{%[^%]*%\}', '', 'g'), '\{\{[^}]*\}\}', '', 'g'), '<[^>]+>', '', 'g'),
  '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS body FROM pages""")
def clean_body(spark, sf):
    return tables.table(spark, sf, "pages").select(
        "page_id", text.clean_body(F.col("html")).alias("body"))


def _raw_posts(spark, sf):
    """Documents as posts with a flat header."""
    d = _docs(spark, sf)
    header = F.concat(F.lit("---\ntitle: \"Post "), F.col("doc_id"), F.lit("\"\npermalink: /"),
                      F.when(F.col("doc_id") % 3 == 0, "").otherwise(
                          F.concat(F.lit("posts/"), F.col("doc_id"), F.lit("/"))),
                      F.lit("\npublished: "),
                      F.when(F.col("lang") == "es", "false").otherwise("true"), F.lit("\n---\n"))
    raw = F.when(F.col("lang") == "de", F.col("text")).otherwise(F.concat(header, F.col("text")))
    stem = F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"),
                    F.lit("-post-"), F.col("doc_id"))
    return d.select("doc_id", "lang", "source_type", raw.alias("raw"), stem.alias("stem"))


STRIPPED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@query("front_matter", with_(DOCS) + f"""
SELECT doc_id, CASE WHEN lang <> 'de' THEN concat('Post ', doc_id) END AS title,
  CASE WHEN lang <> 'de' THEN lang <> 'es' END AS published,
  CASE WHEN lang = 'de' THEN text ELSE {STRIPPED} END AS body FROM docs""")
def front_matter(spark, sf):
    meta = text.front_matter_map(F.col("raw"))
    return _raw_posts(spark, sf).select(
        "doc_id", meta["title"].alias("title"), meta["published"].cast("boolean").alias("published"),
        text.front_matter_body(F.col("raw")).alias("body"))


@query("date_from_filename", """SELECT doc_id, concat('2024-01-', lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0')) AS day
FROM documents""")
def date_from_filename(spark, sf):
    return _raw_posts(spark, sf).select("doc_id", text.date_from_filename(F.col("stem")).alias("day"))


@query("doc_id_for", with_(DOCS) + """
SELECT doc_id, concat(source_type, ':', CASE WHEN lang <> 'de' AND doc_id % 3 <> 0 THEN concat('posts/', doc_id)
  ELSE concat('2024-01-', lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0'), '-post-', doc_id) END) AS document_id
FROM docs""")
def doc_id_for(spark, sf):
    link = F.coalesce(text.front_matter_map(F.col("raw"))["permalink"], F.lit(""))
    return _raw_posts(spark, sf).select(
        "doc_id", text.doc_id_for(F.col("source_type"), link, F.col("stem")).alias("document_id"))


@query("page_main_text", r"""
SELECT page_id, title, body FROM (
  SELECT page_id,
    replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS title,
    trim(regexp_replace(regexp_replace(
      replace(replace(replace(replace(replace(replace(b, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'),
      '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS body
  FROM (SELECT page_id, regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '^\s+|\s+$', '', 'g') AS t,
    regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?(p|h1|br)>', chr(10), 'g'), '<[^>]+>', '', 'g') AS b FROM pages))
WHERE length(body) >= 80""")
def page_main_text(spark, sf):
    from murmur.operators import corpus
    return corpus.extract_pages(tables.table(spark, sf, "pages")).select(
        "page_id", "title", F.col("text").alias("body"))


@query("url_path_filter", r"""
SELECT page_id, path FROM (SELECT page_id, CASE WHEN p = '' THEN 'home' ELSE p END AS path
  FROM (SELECT page_id, trim(regexp_replace(url, '^[a-zA-Z]+://[^/]+', ''), '/') AS p FROM pages))
WHERE starts_with('/' || path, '/en') OR starts_with('/' || path, '/de')""")
def url_path_filter(spark, sf):
    pages = tables.table(spark, sf, "pages")
    return (pages.where(text.path_filter(F.col("url"), include=["/en/", "/de"], exclude=["/en"]))
            .select("page_id", text.url_path(F.col("url")).alias("path")))


@query("safe_mean", with_(LOG) + """
SELECT model, round_even(CAST(sum(CAST(v AS DECIMAL(20,6))) AS DOUBLE) / count(v), 2) AS mean_value
FROM (SELECT model, CASE WHEN had_error THEN NULL ELSE latency_ms END AS v FROM chats) GROUP BY 1""")
def safe_mean(spark, sf):
    messy = F.when(F.col("had_error"), "n/a").otherwise(F.col("latency_ms").cast("string"))
    return tables.chat_log(spark, sf).groupBy("model").agg(
        numeric.numeric_mean(messy, 2).alias("mean_value"))


@query("safe_median", with_(LOG, "ok AS (SELECT latency_ms AS v FROM chats WHERE NOT had_error)") + f"""
SELECT {quantile('ok', 'v', 1, 2)} AS median_value""")
def safe_median(spark, sf):
    from murmur.scale import Quantile, exact_quantiles
    messy = F.when(F.col("had_error"), "n/a").otherwise(F.col("latency_ms").cast("string"))
    numbers = tables.chat_log(spark, sf).select(messy.try_cast("bigint").alias("v"))
    return exact_quantiles(numbers, "v", [Quantile("median_value", 1, 2)]).drop("n")


@query("safe_rate", with_(LOG) + """
SELECT model, CASE WHEN d = 0 THEN 0.0 ELSE round_even(100.0::DOUBLE * n / d, 1) END AS rate
FROM (SELECT model, count_if(had_error AND chunk_similarity_avg IS NULL) AS n, count_if(chunk_similarity_avg IS NULL) AS d
  FROM chats GROUP BY 1)""")
def safe_rate(spark, sf):
    none = F.col("chunk_similarity_avg").isNull()
    return tables.chat_log(spark, sf).groupBy("model").agg(
        F.count_if(F.col("had_error") & none).alias("n"), F.count_if(none).alias("d")).select(
        "model", numeric.rate_pct_1dp(F.col("n"), F.col("d")).alias("rate"))


EXAMPLES = {"Q1": "the thing", "Q2": "nicht der die", "Q3": "an the of", "Q4": "le de la que"}


@query("example_question_match", with_(USER_MESSAGES) + r"""
SELECT message_id, coalesce(arg_max(id, (share, -o)) FILTER (WHERE share >= 0.7), 'none') AS which_example,
  max(share) >= 0.7 AS is_example
FROM (SELECT message_id, id, o, len(list_intersect(w, ws)) / CAST(len(ws) AS DOUBLE) AS share
  FROM (SELECT message_id, list_distinct(string_split(trim(regexp_replace(lower(message), '\s+', ' ', 'g')), ' ')) AS w FROM um)
  CROSS JOIN (VALUES ('Q1', 0, ['the', 'thing']), ('Q2', 1, ['nicht', 'der', 'die']), ('Q3', 2, ['an', 'the', 'of']),
    ('Q4', 3, ['le', 'de', 'la', 'que'])) e(id, o, ws)) GROUP BY 1""")
def example_question_match(spark, sf):
    return enrich.example_question_match(tables.messages(spark, sf), EXAMPLES).select(
        "message_id", "which_example", "is_example")


ASKED = ("CASE length(message) % 4 WHEN 0 THEN concat('Walk me  through ', message) "
         "WHEN 1 THEN concat('explain ', message, ' nicht') ELSE message END")


def _asking(spark, sf):
    """User turns, a part of them phrased as walkthrough requests."""
    n = F.length("message") % 4
    return tables.messages(spark, sf).withColumn(
        "message", F.when(n == 0, F.concat(F.lit("Walk me  through "), F.col("message")))
        .when(n == 1, F.concat(F.lit("explain "), F.col("message"), F.lit(" nicht")))
        .otherwise(F.col("message")))


INTENT_SQL = r"""regexp_matches(lower(message), 'walk\s*(me\s+)?through|show\s+me\s+a\s+project|(portfolio|featured)\s+project|project\s+you.*(proud|excited|built|worked)|(proud|excited)\s+.*(project|built)|(tell|talk)\s+(me\s+)?about\s+.*(nicht|thble|project)|(explain|describe)\s+.*?(nicht|thble|project)|how\s+(does|did|do|is)\s+.*(nicht|thble)')"""


@query("walkthrough_intent", with_(f"um AS (SELECT concat(conv_id, '-', turn) AS message_id, {ASKED} AS message "
       "FROM (SELECT conv_id, turn, text AS message FROM conversations WHERE role = 'user'))") + f"""
SELECT message_id, {INTENT_SQL} AS wants FROM um""")
def walkthrough_intent(spark, sf):
    return _asking(spark, sf).select("message_id", enrich.walkthrough_intent(
        F.col("message"), ["nicht", "thble"]).alias("wants"))


@query("route_model", with_(LOG) + f"""
SELECT CASE WHEN chunk_similarity_avg < 0.55 THEN 'notify' WHEN workflow = 'walkthrough' THEN 'best' ELSE 'cheap' END AS route,
  {big('count(*)')} AS n FROM chats GROUP BY 1""")
def route_model(spark, sf):
    route = enrich.route_model(F.col("chunk_similarity_avg") < numeric.GAP_SIMILARITY,
                               F.col("workflow") == "walkthrough", "best", "cheap")
    return tables.chat_log(spark, sf).groupBy(route.alias("route")).agg(
        F.count(F.lit(1)).alias("n"))


@query("config_override", with_(LOG) + """
SELECT row_id, (n_chunks_config <> 10 OR temperature <> 0.7 OR model <> 'openai/m1') AS config_override FROM chats""")
def config_override(spark, sf):
    return tables.chat_log(spark, sf).select("row_id", enrich.config_override({
        "k": (F.col("n_chunks_config"), 10), "temperature": (F.col("temperature"), 0.7),
        "model": (F.col("model"), "openai/m1")}).alias("config_override"))


# --- turns -----------------------------------------------------------------

@query("turn_index", f"""
SELECT conv_id, turn, {big('n')} AS turn_index FROM (SELECT conv_id, turn, role,
  count(CASE WHEN role = 'user' THEN 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
WHERE role = 'user'""")
def turn_index(spark, sf):
    return enrich.turn_index(tables.history(spark, sf)).select("conv_id", "turn", "turn_index")


PHRASES = {"inner_circle": ["THTION"], "personal": ["thble", "Nicht", "heing"]}


@query("tier_escalation", """
SELECT conv_id, turn, CASE max(r) OVER (PARTITION BY conv_id ORDER BY turn) WHEN 2 THEN 'inner_circle'
  WHEN 1 THEN 'personal' ELSE 'public' END AS audience_tier
FROM (SELECT conv_id, turn, CASE WHEN role <> 'user' THEN 0 WHEN contains(lower(text), 'thtion') THEN 2
  WHEN contains(lower(text), 'thble') OR contains(lower(text), 'nicht') OR contains(lower(text), 'heing') THEN 1
  ELSE 0 END AS r FROM conversations)""")
def tier_escalation(spark, sf):
    return enrich.tier_escalation(tables.history(spark, sf), PHRASES).select(
        "conv_id", "turn", "audience_tier")


@query("history_truncate", """
SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r
  FROM conversations) WHERE r <= 6""")
def history_truncate(spark, sf):
    return enrich.history_truncate(tables.history(spark, sf), keep=6)


@query("vote_attribute_turn", """
SELECT conv_id, turn, liked, user_message FROM (SELECT conv_id, turn, role, length(text) % 2 = 0 AS liked,
  last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS user_message FROM conversations)
WHERE role = 'assistant'""")
def vote_attribute_turn(spark, sf):
    history = tables.history(spark, sf)
    votes = history.where(F.col("role") == "assistant").select(
        "conv_id", "turn", (F.length("text") % 2 == 0).alias("liked"))
    return enrich.vote_attribute_turn(history, votes)


KEY = ("CASE WHEN trim(session_id) = '' THEN concat('__missing_session__:', row_id) ELSE session_id END")


@query("vote_attribute_call", with_(LOG) + f"""
SELECT row_id, ts, liked, c.row_id AS call_row_id, c.model AS call_model, c.cost_usd AS call_cost_usd
FROM (SELECT row_id, ts, event, liked, last_value(CASE WHEN event IS NULL THEN
    {{'row_id': row_id, 'model': model, 'cost_usd': cost_usd}} END IGNORE NULLS) OVER (
      PARTITION BY {KEY} ORDER BY ts, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c
  FROM log) WHERE event = 'vote'""")
def vote_attribute_call(spark, sf):
    return enrich.vote_attribute_call(tables.query_log(spark, sf))


@query("session_cost_running", with_(LOG) + f"""
SELECT row_id, {KEY} AS session_key,
  CAST(sum(CAST(cost_usd AS DECIMAL(20,6))) OVER w AS DOUBLE) AS running_cost_usd,
  {big('sum(coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0)) OVER w')} AS running_tokens
FROM chats WINDOW w AS (PARTITION BY {KEY} ORDER BY ts, row_id ROWS UNBOUNDED PRECEDING)""")
def session_cost_running(spark, sf):
    return enrich.session_cost_running(tables.chat_log(spark, sf))


@query("gap_rate_last_n", with_(LOG) + """
SELECT row_id, provider, pct AS gap_pct, pct > 20 AS alert FROM (
  SELECT row_id, provider, 100.0::DOUBLE * count(CASE WHEN chunk_similarity_avg < 0.55 THEN 1 END) OVER w
    / count(*) OVER w AS pct FROM chats
  WINDOW w AS (PARTITION BY provider ORDER BY ts, row_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))""")
def gap_rate_last_n(spark, sf):
    return enrich.gap_rate_last_n(tables.chat_log(spark, sf))


@query("gap_rate_latest", with_(LOG) + """
SELECT pct AS gap_pct, pct > 20 AS alert FROM (SELECT 100.0::DOUBLE * count_if(chunk_similarity_avg < 0.55) / count(*) AS pct
  FROM (SELECT * FROM chats ORDER BY ts DESC, row_id DESC LIMIT 100))""")
def gap_rate_latest(spark, sf):
    return enrich.gap_rate_latest(tables.chat_log(spark, sf))


# --- projects --------------------------------------------------------------

UM_WORDS = with_(USER_MESSAGES, CATALOGUE)


def score_sql(messages: str) -> str:
    return f"""
scores AS (SELECT message_id, project_id, "order", CAST(
    10 * len(list_filter(mention_keywords, lambda k: k <> '' AND contains(lower(message), lower(k))))
    + CASE WHEN contains(lower(message), lower(title)) THEN 8 ELSE 2 * len(list_intersect(
        list_filter({words('title')}, lambda x: length(x) >= 4), {words('message')})) END
    + len(list_intersect(tags, {words('message')})) AS BIGINT) AS score
  FROM {messages} CROSS JOIN cat)"""


@query("project_mention_score", with_(USER_MESSAGES, CATALOGUE, score_sql("um")) + """
SELECT message_id, project_id, score FROM scores WHERE score > 0""")
def project_mention_score(spark, sf):
    return projects.mention_scores(tables.messages(spark, sf), tables.catalogue(spark, sf))


@query("find_mentioned_project", with_(USER_MESSAGES, CATALOGUE, score_sql("um")) + """
SELECT message_id, arg_max(project_id, (score, -"order")) AS project_id, max(score) AS score
FROM scores WHERE score >= 5 GROUP BY 1""")
def find_mentioned_project(spark, sf):
    return projects.find_mentioned(tables.messages(spark, sf), tables.catalogue(spark, sf))


STOP = "('" + "','".join(projects.GENERIC_WORDS) + "')"


def walkthrough_sql(catalogue):
    return with_(
        f"um AS (SELECT concat(conv_id, '-', turn) AS message_id, {ASKED} AS message "
        "FROM (SELECT conv_id, turn, text AS message FROM conversations WHERE role = 'user'))",
        catalogue, f"asked AS (SELECT * FROM um WHERE {INTENT_SQL})", score_sql("asked"), f"""
m AS (SELECT message_id, arg_max(project_id, (score, -"order")) AS project_id FROM scores WHERE score >= 5 GROUP BY 1),
rest AS (SELECT message_id, list_filter({words('message')}, lambda x: length(x) > 2 AND x NOT IN {STOP}) AS mw
  FROM asked WHERE message_id NOT IN (SELECT message_id FROM m)),
ov AS (SELECT message_id, project_id, len(list_intersect(mw, {words("concat_ws(' ', lower(title), lower(summary), array_to_string(tags, ' '))")})) AS n
  FROM rest CROSS JOIN cat WHERE len(mw) >= 2),
best AS (SELECT message_id, arg_min(project_id, (-n, md5(concat_ws('|', message_id, project_id, '0')))) AS project_id
  FROM ov WHERE n > 0 GROUP BY 1)""") + """
SELECT message_id, project_id, 'mention' AS how FROM m UNION ALL SELECT message_id, project_id, 'overlap' FROM best
UNION ALL SELECT message_id, project_id, 'draw' FROM (SELECT message_id,
  CAST(concat('0x', md5(concat_ws('|', message_id, '0'))[1:8]) AS BIGINT) % (SELECT count(*) FROM cat) AS o
  FROM rest WHERE message_id NOT IN (SELECT message_id FROM best)) r JOIN (SELECT project_id, row_number() OVER (ORDER BY "order", project_id) - 1 AS nth FROM cat) ON nth = r.o"""


def _walkthrough(spark, sf, catalogue):
    return projects.walkthrough_select(
        _asking(spark, sf), catalogue,
        enrich.walkthrough_intent(F.col("message"), ["nicht", "thble"]))


@query("walkthrough_select", walkthrough_sql(CATALOGUE))
def walkthrough_select(spark, sf):
    return _walkthrough(spark, sf, tables.catalogue(spark, sf))


@query("walkthrough_select_gaps", walkthrough_sql(
    CATALOGUE.replace('item_id AS "order"', '7 * item_id + 3 AS "order"')))
def walkthrough_select_gaps(spark, sf):
    """The same with gaps in the order of the catalogue."""
    catalogue = tables.catalogue(spark, sf)
    return _walkthrough(spark, sf, catalogue.withColumn("order", F.col("order") * 7 + 3))


PROMINENT_SQL = """
prom AS (SELECT doc_id, arg_min(project_id, "order") AS project_id FROM documents CROSS JOIN cat
  WHERE contains(lower(substr(text, 1, 300)), lower(title))
    OR (length(lower(text)) - length(replace(lower(text), lower(title), ''))) // length(title) >= 2 GROUP BY 1)"""


@query("prominent_project", with_(CATALOGUE, PROMINENT_SQL) + "SELECT * FROM prom")
def prominent_project(spark, sf):
    return projects.prominent_project(_docs(spark, sf), tables.catalogue(spark, sf))


@query("workflow_label", with_(CATALOGUE, PROMINENT_SQL) + f"""
SELECT CASE WHEN lang = 'de' THEN 'walkthrough' WHEN project_id IS NOT NULL THEN 'diagram_only' ELSE 'standard' END AS workflow,
  {big('count(*)')} AS n FROM documents LEFT JOIN prom USING (doc_id) GROUP BY 1""")
def workflow_label(spark, sf):
    docs = _docs(spark, sf)
    found = projects.prominent_project(docs, tables.catalogue(spark, sf))
    label = enrich.workflow_label(F.col("lang") == "de", F.col("project_id").isNotNull())
    return docs.join(found, "doc_id", "left").groupBy(label.alias("workflow")).agg(
        F.count(F.lit(1)).alias("n"))


@query("prompt_reference_block", with_(CATALOGUE) + """
SELECT project_id, concat_ws(chr(10), concat('Project: ', title), concat('In short: ', summary),
  CASE WHEN design_insight <> '' THEN concat('Design idea: ', design_insight) END,
  concat('Notes: ', walkthrough_context), concat('Links:', chr(10), '- demo <', demo, '>'),
  CASE WHEN post_title IS NOT NULL THEN concat('Articles:', chr(10), '- ', post_title, ' <', post_url, '>') END) AS block FROM cat""")
def prompt_reference_block(spark, sf):
    return projects.reference_block(tables.catalogue(spark, sf))


@query("composite_text", with_(CATALOGUE) + """
SELECT project_id, title, "order", concat_ws(chr(10) || chr(10), concat(title, ': ', summary),
  CASE WHEN design_insight <> '' THEN concat('Design idea: ', design_insight) END,
  walkthrough_context, concat('Topics: ', array_to_string(tags, ', '))) AS full_text FROM cat WHERE walkthrough_context <> ''""")
def composite_text(spark, sf):
    return projects.composite_text(tables.catalogue(spark, sf))
