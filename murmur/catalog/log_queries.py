"""Registered log-analytics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.catalog.registry import query
from murmur.catalog.sqlparts import (LOG, MESSAGES, OWNER, SESSION_KEY, big, mean, quantile,
                                     rate, total, with_)
from murmur.operators import breakdowns, filters, kpis, sessions, toplists
from murmur.sources import logs, tables

ZONE = "America/Chicago"
CUTOFF = "2024-01-10"


def local_day(ts: str) -> str:
    return f"CAST(timezone('{ZONE}', timezone('UTC', {ts})) AS DATE)"


SESSION_SQL = f"""
sess AS (
  SELECT {SESSION_KEY} AS session_id, min(ts) AS session_start, max(ts) AS session_end,
    {big('count(message)')} AS turns, {mean('latency_ms')} AS avg_latency_ms,
    {mean('chunk_similarity_avg')} AS avg_similarity, {total('cost_usd')} AS total_cost_usd,
    {big('count_if(had_error)')} AS error_turns,
    (array_agg(message ORDER BY ts, turn_index, row_id) FILTER (WHERE message IS NOT NULL))[1] AS first_message,
    (array_agg(message ORDER BY ts DESC, turn_index DESC, row_id DESC) FILTER (WHERE message IS NOT NULL))[1] AS last_message,
    (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE AS duration_seconds
  FROM chats_m GROUP BY 1
)
"""
FULL = with_(LOG, MESSAGES, SESSION_SQL)

SIZES = f"sizes AS (SELECT {SESSION_KEY} AS session_id, count(*) AS turns FROM kept GROUP BY 1)"


def kpi_sql(kept: str) -> str:
    return with_(LOG, OWNER, f"kept AS ({kept})", SIZES) + f"""
SELECT {big('count(*)')} AS total_chat_turns,
  {big('(SELECT count(*) FROM sizes)')} AS total_sessions,
  count(*) / (SELECT count(*) FROM sizes)::DOUBLE AS avg_turns_per_session,
  {quantile('sizes', 'turns', 1, 2)} AS median_turns_per_session,
  {big('(SELECT count(*) FROM sizes WHERE turns = 1)')} AS one_turn_sessions,
  100.0::DOUBLE * (SELECT count(*) FROM sizes WHERE turns = 1) / (SELECT count(*) FROM sizes) AS bounce_rate_pct,
  {big('count_if(had_error)')} AS had_error_turns,
  {big('count_if(empty_response)')} AS empty_response_turns,
  {mean('latency_ms')} AS avg_latency_ms,
  {quantile('kept', 'latency_ms', 95, 100)} AS p95_latency_ms,
  {mean('chunk_similarity_avg')} AS avg_similarity,
  {rate('count_if(chunk_similarity_avg < 0.55)', 'count(*)')} AS knowledge_gap_rate_pct,
  {total('cost_usd')} AS total_cost_usd
FROM kept"""


NO_OWNER_SQL = ("SELECT * FROM chats WHERE NOT is_owner_traffic AND session_id NOT IN "
                "(SELECT session_id FROM touched)")


def _chats(spark, sf):
    return tables.chat_log(spark, sf)


def _chats_m(spark, sf):
    return tables.chat_log(spark, sf, message=True)


def _filtered(spark, sf, mode="session"):
    log = tables.query_log(spark, sf)
    return filters.exclude_owner(*logs.split_rows(log), mode)


def _sessions(spark, sf):
    return sessions.session_summary(_chats_m(spark, sf))


@query("flagship_kpis", kpi_sql(NO_OWNER_SQL))
def flagship_kpis(spark, sf):
    chats, _ = _filtered(spark, sf)
    return kpis.overall_kpis(chats)


@query("overall_kpis", kpi_sql("SELECT * FROM chats"))
def overall_kpis(spark, sf):
    return kpis.overall_kpis(_chats(spark, sf))


@query("session_summary", FULL + "SELECT * FROM sess")
def session_summary(spark, sf):
    return _sessions(spark, sf)


@query("session_summary_ext", with_(LOG, MESSAGES) + f"""
SELECT session_id, min(ts) AS start_ts, max(ts) AS end_ts, {big('count(*)')} AS turns,
  arg_min(trim(coalesce(message,'')), (ts, row_id)) AS first_prompt,
  arg_max(trim(coalesce(message,'')), (ts, row_id)) AS last_prompt,
  {mean('latency_ms')} AS avg_latency_ms, {mean('chunk_similarity_avg')} AS avg_similarity,
  {big('sum(response_chars)')} AS total_response_chars, {total('cost_usd')} AS total_cost_usd,
  string_agg(DISTINCT provider, ', ' ORDER BY provider) AS providers,
  string_agg(DISTINCT model, ', ' ORDER BY model) AS models,
  string_agg(DISTINCT audience_tier, ', ' ORDER BY audience_tier) AS audience_tiers,
  bool_or(is_owner_traffic) AS contains_owner_marked_rows, bool_or(had_error) AS has_error,
  bool_or(empty_response) AS has_empty_response, {local_day('min(ts)')} AS start_local_date
FROM chats_m WHERE trim(session_id) <> '' GROUP BY session_id""")
def session_summary_ext(spark, sf):
    return sessions.session_summary_ext(sessions.analysable_turns(
        _chats_m(spark, sf).withColumn("message", F.coalesce("message", F.lit("")))))


@query("first_last_prompt",
       FULL + "SELECT session_id, first_message, last_message FROM sess")
def first_last_prompt(spark, sf):
    return sessions.first_last_prompt(_chats_m(spark, sf))


@query("filter_owner_session", with_(LOG, OWNER) + """
SELECT row_id, session_id, event FROM log
WHERE NOT is_owner_traffic AND session_id NOT IN (SELECT session_id FROM touched)""")
def filter_owner_session(spark, sf):
    chats, votes = _filtered(spark, sf)
    return chats.unionByName(votes).select("row_id", "session_id", "event")


@query("filter_owner_row", with_(LOG) + """
SELECT row_id, session_id, event FROM log WHERE NOT is_owner_traffic""")
def filter_owner_row(spark, sf):
    chats, votes = _filtered(spark, sf, "row")
    return chats.unionByName(votes).select("row_id", "session_id", "event")


@query("filter_date_range", with_(LOG) + """
SELECT row_id, ts FROM log WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-13'""")
def filter_date_range(spark, sf):
    return filters.date_range(tables.query_log(spark, sf), "2024-01-05", "2024-01-12").select(
        "row_id", "ts")


@query("filter_cutoff_local", with_(LOG) + f"""
SELECT CASE WHEN event = 'vote' THEN 'vote' ELSE 'chat' END AS row_class,
  {big(f"count_if({local_day('ts')} >= DATE '{CUTOFF}')")} AS kept,
  {big(f"count_if({local_day('ts')} < DATE '{CUTOFF}')")} AS removed
FROM log GROUP BY 1""")
def filter_cutoff_local(spark, sf):
    row_class = F.when(F.col("event") == "vote", "vote").otherwise("chat")
    return filters.cutoff_summary(tables.query_log(spark, sf), CUTOFF, ZONE, row_class)


@query("filter_last_n", with_(LOG) + """
SELECT row_id, ts, model FROM chats ORDER BY ts DESC, row_id DESC LIMIT 100""")
def filter_last_n(spark, sf):
    return filters.last_n(_chats(spark, sf), 100).select("row_id", "ts", "model")


@query("filter_workflow", with_(LOG) + """
SELECT row_id, workflow FROM chats WHERE workflow IN ('walkthrough', 'diagram_only')""")
def filter_workflow(spark, sf):
    return filters.by_workflow(_chats(spark, sf), ["walkthrough", "diagram_only"]).select(
        "row_id", "workflow")


@query("workflow_values", with_(LOG) + "SELECT DISTINCT workflow FROM chats")
def workflow_values(spark, sf):
    return filters.workflow_values(_chats(spark, sf))


@query("filter_real_sessions", with_(LOG) + """
SELECT row_id, session_id FROM chats WHERE trim(session_id) <> ''""")
def filter_real_sessions(spark, sf):
    turns = _chats(spark, sf)
    return sessions.real_turns(turns, sessions.session_sizes(turns)).select("row_id", "session_id")


@query("find_log_entry", with_(LOG, MESSAGES) + """
SELECT row_id, ts, session_id, message FROM chats_m WHERE contains(lower(message), 'therin')
ORDER BY ts DESC, row_id DESC LIMIT 1""")
def find_log_entry(spark, sf):
    return filters.find_latest(_chats_m(spark, sf), "THERIN").select(
        "row_id", "ts", "session_id", "message")


@query("flag_turns", with_(LOG) + """
SELECT row_id, chunk_similarity_avg < 0.55 AS is_knowledge_gap, latency_ms > 5000 AS is_slow,
  response_chars > 2000 AS is_verbose FROM chats""")
def flag_turns(spark, sf):
    return filters.flag_turns(_chats(spark, sf)).select(
        "row_id", "is_knowledge_gap", "is_slow", "is_verbose")


@query("log_split_votes", with_(LOG) + f"""
SELECT CASE WHEN event = 'vote' THEN 'vote' ELSE 'chat' END AS row_class, {big('count(*)')} AS n
FROM log GROUP BY 1""")
def log_split_votes(spark, sf):
    chats, votes = logs.split_rows(tables.query_log(spark, sf))
    tag = lambda d, c: d.groupBy(F.lit(c).alias("row_class")).agg(F.count(F.lit(1)).alias("n"))
    return tag(chats, "chat").unionByName(tag(votes, "vote"))


@query("log_project_schema", with_(LOG) + """
SELECT row_id, ts, session_id, turn_index, CAST(NULL AS VARCHAR) AS message,
  CAST(NULL AS VARCHAR) AS assistant_response_preview, CAST(NULL AS VARCHAR) AS project,
  CAST(NULL AS BOOLEAN) AS walkthrough, audience_tier, is_owner_traffic, tool_called, tool_name,
  had_error, empty_response, model, temperature, n_chunks_retrieved, n_chunks_config,
  response_chars, latency_ms, workflow, chunk_similarity_avg, chunk_similarity_max, provider,
  cost_usd, prompt_tokens, completion_tokens FROM chats""")
def log_project_schema(spark, sf):
    return logs.project_chat(_chats(spark, sf), carry=("row_id",))


@query("log_typed_defaults", with_(LOG) + """
SELECT row_id, coalesce(chunk_similarity_avg, 0.0) AS chunk_similarity_avg,
  coalesce(chunk_similarity_avg, 0.0) < 0.55 AS is_knowledge_gap FROM chats""")
def log_typed_defaults(spark, sf):
    filled = logs.fill_defaults(_chats(spark, sf))
    return filters.flag_turns(filled).select("row_id", "chunk_similarity_avg", "is_knowledge_gap")


@query("log_view", with_(LOG, MESSAGES) + """
SELECT ts, message, audience_tier, CAST(NULL AS VARCHAR) AS project,
  CAST(NULL AS VARCHAR) AS walkthrough, tool_called, tool_name, had_error FROM msgs""")
def log_view(spark, sf):
    return logs.log_view(tables.with_message(tables.query_log(spark, sf), spark, sf))


@query("field_coverage", with_(LOG) + "\nUNION ALL\n".join(
    f"SELECT '{f}' AS field, {big(f'count_if({f} IS NULL)')} AS missing, {big('count(*)')} AS total,"
    f" 100.0::DOUBLE * count_if({f} IS NULL) / count(*) AS missing_pct FROM chats"
    for f in ["chunk_similarity_avg", "tool_name", "completion_tokens", "model"]))
def field_coverage(spark, sf):
    return logs.field_coverage(_chats(spark, sf), [
        "chunk_similarity_avg", "tool_name", "completion_tokens", "model"])


# --- JSON lines ------------------------------------------------------------

LINES_SQL = """
lines AS (
  SELECT row_id, CASE
    WHEN row_id % 90 = 3 THEN '   '
    WHEN row_id % 90 = 4 THEN '{"a":'
    WHEN row_id % 90 = 5 THEN '[1]'
    WHEN row_id % 90 = 6 THEN 'null' ELSE 'ok' END AS shape, log.* EXCLUDE (row_id)
  FROM log
)
"""


def _lines(spark, sf):
    """One JSON line per log row; a share of rows become the malformed shapes seen in logs."""
    log = tables.query_log(spark, sf)
    m = F.col("row_id") % 90
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    body = F.to_json(F.struct(*[c for c in log.columns if c not in ("row_id", "ts")],
                              stamp.alias("ts"), F.lit("kept out").alias("unknown_extra")))
    text = (F.when(m == 3, "   ").when(m == 4, '{"a":').when(m == 5, "[1]")
            .when(m == 6, "null").otherwise(F.concat(F.lit(" "), body)))
    return log.select("row_id", F.explode(F.array(text)).alias("value"))


@query("log_parse_jsonl", with_(LOG, LINES_SQL) + """
SELECT row_id, ts, trim(session_id) AS session_id, model, had_error, is_owner_traffic,
  CAST(latency_ms AS DOUBLE) AS latency_ms, chunk_similarity_avg, cost_usd
FROM lines WHERE shape = 'ok' AND event IS NULL""")
def log_parse_jsonl(spark, sf):
    parsed = logs.parse_lines(_lines(spark, sf))
    return logs.chat_rows(parsed, ("row_id",)).select(
        "row_id", "ts", "session_id", "model", "had_error", "is_owner_traffic", "latency_ms",
        "chunk_similarity_avg", "cost_usd")


@query("log_bad_rows", with_(LOG, LINES_SQL) + """
SELECT row_id, CASE WHEN row_id % 90 = 4 THEN 'unterminated_object' ELSE 'not_an_object' END AS reason,
  CASE row_id % 90 WHEN 4 THEN '{"a":' WHEN 5 THEN '[1]' ELSE 'null' END AS raw
FROM lines WHERE row_id % 90 IN (4, 5, 6)""")
def log_bad_rows(spark, sf):
    return logs.bad_lines(logs.parse_lines(_lines(spark, sf)))


@query("log_artifacts", with_(LOG, LINES_SQL) + f"""
SELECT reason, {big('count(*)')} AS n FROM (
  SELECT CASE WHEN row_id % 90 IN (4, 5, 6) THEN 'json_decode_error'
              WHEN event IS NULL THEN 'missing_ts_or_empty_message' END AS reason
  FROM lines WHERE row_id % 90 <> 3) WHERE reason IS NOT NULL GROUP BY 1""")
def log_artifacts(spark, sf):
    parsed = logs.parse_lines(_lines(spark, sf))
    return logs.artifacts(parsed, ("row_id",)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("log_load_meta", with_(LOG, LINES_SQL) + f"""
SELECT {big("count_if(shape <> 'ok')")} AS malformed_rows, {big("count_if(shape = 'ok')")} AS total_rows,
  {big("count_if(shape = 'ok' AND event IS NULL)")} AS chat_rows,
  {big("count_if(shape = 'ok' AND event = 'vote')")} AS vote_rows
FROM lines WHERE row_id % 90 <> 3""")
def log_load_meta(spark, sf):
    return logs.load_meta(logs.parse_lines(_lines(spark, sf)))


@query("artifact_summary", with_(LOG, LINES_SQL) + f"""
SELECT {big('count(*)')} AS total, {big("count_if(shape = 'ok' AND is_owner_traffic)")} AS owner_marked,
  {big("count_if(shape <> 'ok')")} AS missing_ts,
  {big("count_if(shape = 'ok' AND session_id <> '')")} AS with_session
FROM lines WHERE row_id % 90 <> 3 AND (shape <> 'ok' OR event IS NULL)""")
def artifact_summary(spark, sf):
    return kpis.artifact_summary(logs.artifacts(logs.parse_lines(_lines(spark, sf))))


@query("recent_artifacts", with_(LOG, LINES_SQL) + """
SELECT row_id, CASE WHEN shape = 'ok' THEN 'missing_ts_or_empty_message' ELSE 'json_decode_error' END AS reason
FROM lines WHERE row_id % 90 <> 3 AND (shape <> 'ok' OR event IS NULL)
ORDER BY row_id DESC LIMIT 20""")
def recent_artifacts(spark, sf):
    odd = logs.artifacts(logs.parse_lines(_lines(spark, sf)), ("row_id",))
    return toplists.recent_artifacts(odd).select("row_id", "reason")


NORM_SQL = """
raw AS (SELECT event_id AS row_id, ts, value,
  CASE event_type WHEN 'click' THEN 'Yes' WHEN 'view' THEN ' n ' WHEN 'error' THEN 'TRUE'
    WHEN 'signup' THEN '1' ELSE 'maybe' END AS flag FROM events)
"""


def _raw_fields(spark, sf):
    e = tables.table(spark, sf, "events")
    kind = F.col("event_type")
    flag = (F.when(kind == "click", "Yes").when(kind == "view", " n ").when(kind == "error", "TRUE")
            .when(kind == "signup", "1").otherwise("maybe"))
    return e.select(F.col("event_id").alias("row_id"), "ts", "value", flag.alias("flag"))


@query("norm_bool", with_(NORM_SQL) + """
SELECT row_id, CASE lower(trim(flag)) WHEN 'yes' THEN true WHEN 'n' THEN false WHEN 'true' THEN true
  WHEN '1' THEN true END AS flag FROM raw""")
def norm_bool(spark, sf):
    from murmur.functions import loose
    return _raw_fields(spark, sf).select("row_id", loose.loose_bool_text(F.col("flag")).alias("flag"))


@query("norm_numeric", with_(NORM_SQL) + """
SELECT row_id, CASE WHEN flag = '1' THEN NULL ELSE value END AS value FROM raw""")
def norm_numeric(spark, sf):
    from murmur.functions import loose
    text = F.when(F.col("flag") == "1", F.concat(F.col("value").cast("string"), F.lit("ms"))
                  ).otherwise(F.col("value").cast("string"))
    return _raw_fields(spark, sf).select("row_id", loose.loose_double(text).alias("value"))


@query("norm_ts", with_(NORM_SQL) + """
SELECT row_id, CASE WHEN flag = 'maybe' THEN NULL ELSE ts END AS ts FROM raw""")
def norm_ts(spark, sf):
    from murmur.functions import loose
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = (F.when(F.col("flag") == "maybe", "not a time")
            .when(F.col("flag") == "1", F.concat(iso, F.lit("Z")))
            .otherwise(F.concat(iso, F.lit("+00:00"))))
    return _raw_fields(spark, sf).select("row_id", loose.loose_ts(text).alias("ts"))


@query("norm_text", with_(NORM_SQL) + """
SELECT row_id, CASE WHEN flag = 'maybe' THEN '' ELSE trim(flag) END AS flag FROM raw""")
def norm_text(spark, sf):
    from murmur.functions import loose
    padded = F.when(F.col("flag") != "maybe", F.concat(F.lit("\t"), F.col("flag"), F.lit(" \n")))
    return _raw_fields(spark, sf).select("row_id", loose.loose_text(padded).alias("flag"))


# --- KPIs ------------------------------------------------------------------

@query("summary_stats", with_(LOG, LINES_SQL, """
filled AS (SELECT * REPLACE (coalesce(chunk_similarity_avg, 0.0) AS chunk_similarity_avg) FROM chats)
""") + f"""
SELECT {big('count(*)')} AS total_queries, min(ts) AS first_ts, max(ts) AS last_ts,
  {big('floor(' + mean('latency_ms') + ')')} AS latency_mean, max(latency_ms) AS latency_max,
  {mean('chunk_similarity_avg')} AS similarity_mean, min(chunk_similarity_avg) AS similarity_min,
  {big('floor(' + mean('response_chars') + ')')} AS response_chars_mean,
  {big('count_if(chunk_similarity_avg < 0.55)')} AS knowledge_gaps,
  {big('count_if(latency_ms > 5000)')} AS slow_queries,
  {big('count_if(response_chars > 2000)')} AS verbose_queries,
  {big('count_if(tool_called)')} AS tool_calls, {big('count_if(had_error)')} AS errors,
  {big('count_if(n_chunks_retrieved = 0)')} AS zero_retrieval,
  {big('count_if(empty_response)')} AS empty_responses,
  {big('floor(' + quantile('filled', 'latency_ms', 1, 2) + ')')} AS latency_median,
  {big('floor(' + quantile('filled', 'latency_ms', 19, 20, 'exclusive', 20) + ')')} AS latency_p95,
  {big('floor(' + quantile('filled', 'response_chars', 1, 2) + ')')} AS response_chars_median,
  {quantile('filled', 'chunk_similarity_avg', 1, 2)} AS similarity_median,
  {big('(SELECT count(*) FROM votes)')} AS total_votes,
  {big('(SELECT count_if(liked) FROM votes)')} AS likes,
  {big('(SELECT count_if(NOT liked) FROM votes)')} AS dislikes,
  {big('''(SELECT count(*) FROM lines WHERE row_id % 90 <> 3 AND (shape <> 'ok' OR event IS NULL))''')} AS artifacts_total,
  {big('''(SELECT count(*) FROM lines WHERE shape = 'ok' AND event IS NULL AND is_owner_traffic)''')} AS artifacts_owner_marked,
  (SELECT {rate('count_if(liked)', '(count_if(liked) + count_if(NOT liked))')} FROM votes) AS satisfaction_rate
FROM filled""")
def summary_stats(spark, sf):
    odd = logs.artifacts(logs.parse_lines(_lines(spark, sf)))
    return kpis.summary_stats(logs.fill_defaults(_chats(spark, sf)), tables.vote_log(spark, sf), odd)


NAMED = "kept AS (SELECT * FROM chats WHERE trim(session_id) <> '')"


@query("engagement_summary", with_(LOG, NAMED, SIZES) + f"""
SELECT {big('count(*)')} AS total_chat_turns, {big('(SELECT count(*) FROM sizes)')} AS total_sessions,
  count(*) / (SELECT count(*) FROM sizes)::DOUBLE AS avg_turns_per_session,
  {quantile('sizes', 'turns', 1, 2)} AS median_turns_per_session,
  {big('(SELECT count(*) FROM sizes WHERE turns = 1)')} AS one_turn_sessions,
  100.0::DOUBLE * (SELECT count(*) FROM sizes WHERE turns = 1) / (SELECT count(*) FROM sizes) AS pct_one_turn_sessions,
  {big('(SELECT count(*) FROM votes)')} AS total_vote_events,
  {big('count_if(empty_response)')} AS empty_responses, {big('count_if(had_error)')} AS had_errors,
  {mean('latency_ms')} AS avg_latency_ms, {mean('chunk_similarity_avg')} AS avg_chunk_similarity,
  {mean('response_chars')} AS avg_response_chars, {total('cost_usd')} AS total_cost_usd,
  min(ts) AS first_ts, max(ts) AS last_ts
FROM kept""")
def engagement_summary(spark, sf):
    turns = sessions.analysable_turns(_chats(spark, sf).withColumn("message", F.lit("")))
    return kpis.engagement_summary(turns, tables.vote_log(spark, sf))


def _view_sql(view: str, keep: str) -> str:
    return f"""
SELECT '{view}' AS view,
  {big(f'(SELECT count(*) FROM chats WHERE {keep})')} AS chat_turns,
  {big(f"(SELECT count(DISTINCT session_id) FROM chats WHERE {keep} AND trim(session_id) <> '')")} AS sessions,
  {big(f'(SELECT count(*) FROM votes WHERE {keep})')} AS votes,
  (SELECT count(*) / count(DISTINCT session_id)::DOUBLE FROM chats WHERE {keep} AND trim(session_id) <> '') AS avg_turns_per_session,
  {mean('latency_ms')} AS avg_latency_ms, {mean('chunk_similarity_avg')} AS avg_chunk_similarity,
  {total('cost_usd')} AS total_cost_usd FROM chats WHERE {keep}"""


@query("owner_view_compare", with_(LOG, OWNER) + " UNION ALL ".join([
    _view_sql("none", "true"), _view_sql("row", "NOT is_owner_traffic"),
    _view_sql("session", "NOT is_owner_traffic AND session_id NOT IN (SELECT session_id FROM touched)")]))
def owner_view_compare(spark, sf):
    return kpis.owner_view_compare(*logs.split_rows(tables.query_log(spark, sf)))


@query("reliability_counts", with_(LOG, LINES_SQL) + f"""
SELECT {big('count_if(had_error)')} AS had_error_rows, {big('count_if(empty_response)')} AS empty_response_rows,
  {big('count_if(n_chunks_retrieved = 0)')} AS zero_retrieval_rows, {big('count_if(tool_called)')} AS tool_called_rows,
  {big("(SELECT count(*) FROM lines WHERE shape = 'ok' AND event IS NULL)")} AS empty_turn_artifacts,
  {big("(SELECT count(*) FROM lines WHERE shape <> 'ok' AND row_id % 90 <> 3)")} AS malformed_json_rows
FROM chats""")
def reliability_counts(spark, sf):
    odd = logs.artifacts(logs.parse_lines(_lines(spark, sf)))
    return kpis.reliability_counts(_chats(spark, sf), odd)


@query("retrieval_health", with_(LOG) + f"""
SELECT {mean('n_chunks_retrieved')} AS avg_chunks_retrieved, {mean('chunk_similarity_avg')} AS avg_similarity,
  max(chunk_similarity_max) AS max_similarity, {big('count_if(n_chunks_retrieved = 0)')} AS zero_retrieval_rows,
  {big('count_if(coalesce(chunk_similarity_avg, 0) < 0.10)')} AS low_similarity_rows,
  {quantile('chats', 'chunk_similarity_avg', 1, 2)} AS median_similarity FROM chats""")
def retrieval_health(spark, sf):
    return kpis.retrieval_health(_chats(spark, sf))


def _grade_sql(col: str, high: int, some: int) -> str:
    return f"CASE WHEN {col} > {high} THEN 'high' WHEN {col} > {some} THEN 'moderate' ELSE 'ok' END"


@query("health_rates", with_(LOG, NAMED, SIZES, f"""
r AS (SELECT {rate('count_if(chunk_similarity_avg < 0.55)', 'count(*)')} AS gap_rate,
  {rate('count_if(latency_ms > 5000)', 'count(*)')} AS slow_rate,
  {rate('count_if(had_error)', 'count(*)')} AS error_rate,
  (SELECT {rate('count_if(turns = 1)', 'count(*)')} FROM sizes) AS bounce_rate,
  {quantile('sizes', 'turns', 1, 2)} AS median_turns FROM kept)""") + f"""
SELECT *, {_grade_sql('gap_rate', 20, 10)} AS gap_severity, {_grade_sql('slow_rate', 10, 5)} AS slow_severity,
  {_grade_sql('error_rate', 5, 0)} AS error_severity, {_grade_sql('bounce_rate', 60, 40)} AS bounce_severity,
  median_turns >= 3 AS good_engagement FROM r""")
def health_rates(spark, sf):
    return kpis.health_rates(_chats(spark, sf))


@query("usage_totals", with_(LOG) + f"""
SELECT a.*, CAST(coalesce(b.c, 0) AS DOUBLE) AS last_query_cost FROM (
  SELECT {SESSION_KEY} AS session_id, {big('coalesce(sum(prompt_tokens), 0)')} AS total_prompt_tokens,
    {big('coalesce(sum(completion_tokens), 0)')} AS total_completion_tokens,
    {big('coalesce(sum(prompt_tokens), 0) + coalesce(sum(completion_tokens), 0)')} AS total_tokens,
    {total('cost_usd')} AS total_cost_usd, {big('count(*)')} AS total_calls FROM chats GROUP BY 1) a
JOIN (SELECT session_id, sum(CAST(cost_usd AS DECIMAL(20,6))) AS c FROM (
  SELECT {SESSION_KEY} AS session_id, cost_usd, ts,
    max(ts) OVER (PARTITION BY {SESSION_KEY}) AS last_ts FROM chats) WHERE ts = last_ts GROUP BY 1) b
USING (session_id)""")
def usage_totals(spark, sf):
    return kpis.usage_totals(_chats(spark, sf))


# --- breakdowns ------------------------------------------------------------

MEANS = f"{mean('chunk_similarity_avg')} AS avg_similarity, {mean('latency_ms')} AS avg_latency_ms"
COUNT = f"{big('count(*)')} AS count"
SHARE = "100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS share_pct"


@query("workflow_breakdown", with_(LOG) + f"""
SELECT workflow, {COUNT}, {MEANS}, {mean('response_chars')} AS avg_response_chars,
  {total('cost_usd')} AS total_cost_usd, {SHARE} FROM chats GROUP BY workflow""")
def workflow_breakdown(spark, sf):
    return breakdowns.workflow_breakdown(_chats(spark, sf))


@query("share_of_total", with_(LOG) + f"SELECT provider, {COUNT}, {SHARE} FROM chats GROUP BY 1")
def share_of_total(spark, sf):
    return breakdowns.with_share(_chats(spark, sf).groupBy("provider").agg(
        F.count(F.lit(1)).alias("count")))


@query("model_usage", with_(LOG) + f"""
SELECT model, {COUNT}, {MEANS}, {big('count_if(had_error)')} AS had_error_rows,
  {big('count_if(empty_response)')} AS empty_response_rows, {SHARE} FROM chats GROUP BY model""")
def model_usage(spark, sf):
    return breakdowns.model_usage(_chats(spark, sf))


MODEL_VOTES = f"""
mv AS (SELECT model, {big('count_if(liked)')} AS likes, {big('count_if(NOT liked)')} AS dislikes
  FROM votes GROUP BY model)"""


def _model_cmp_sql(name: str) -> str:
    return with_(LOG, MODEL_VOTES, f"""
g AS (SELECT model, {big('count(*)')} AS queries, {MEANS}, {total('cost_usd')} AS total_cost_usd
  FROM chats GROUP BY model)""") + """
SELECT g.*, coalesce(likes, 0) AS likes, coalesce(dislikes, 0) AS dislikes,
  total_cost_usd / queries AS cost_per_query,
  CASE WHEN coalesce(likes, 0) + coalesce(dislikes, 0) > 0 THEN 100.0::DOUBLE * likes / (likes + dislikes) END AS satisfaction_pct
FROM g LEFT JOIN mv USING (model)"""


@query("model_comparison", _model_cmp_sql("model_comparison"))
def model_comparison(spark, sf):
    return breakdowns.model_comparison(_chats(spark, sf), tables.vote_log(spark, sf))


@query("model_votes_join", with_(LOG, MODEL_VOTES) + f"""
SELECT model, queries, likes, dislikes FROM
  (SELECT model, {big('count(*)')} AS queries FROM chats GROUP BY model) LEFT JOIN mv USING (model)""")
def model_votes_join(spark, sf):
    queries = _chats(spark, sf).groupBy("model").agg(F.count(F.lit(1)).alias("queries"))
    return queries.join(breakdowns.model_votes(tables.vote_log(spark, sf)), "model", "left")


@query("provider_comparison", with_(LOG) + f"""
SELECT provider, {big('count(DISTINCT model)')} AS models, {big('count(*)')} AS queries, {MEANS},
  {total('cost_usd')} AS total_cost_usd FROM chats GROUP BY provider""")
def provider_comparison(spark, sf):
    return breakdowns.provider_comparison(_chats(spark, sf))


@query("cost_analysis", with_(LOG) + f"""
SELECT model, {big('count(*)')} AS queries, {mean('chunk_similarity_avg')} AS avg_similarity,
  {total('cost_usd')} AS total_cost_usd, {total('cost_usd')} / count(*) AS cost_per_query
FROM chats WHERE cost_usd > 0 GROUP BY model""")
def cost_analysis(spark, sf):
    return breakdowns.cost_analysis(_chats(spark, sf))


@query("cost_projection", with_(LOG) + f"""
SELECT model, {mean('cost_usd')} AS cost_per_query, {mean('cost_usd')} * 10000 AS projected_monthly_usd
FROM chats GROUP BY model""")
def cost_projection(spark, sf):
    return breakdowns.cost_projection(_chats(spark, sf), 10000)


@query("config_by_temperature", with_(LOG) + f"""
SELECT round_even(temperature * 10, 0) / 10 AS temperature, {big('count(*)')} AS queries, {MEANS}
FROM chats WHERE temperature > 0 GROUP BY 1""")
def config_by_temperature(spark, sf):
    return breakdowns.config_by_temperature(_chats(spark, sf))


@query("config_by_topk", with_(LOG) + f"""
SELECT n_chunks_config AS top_k, {big('count(*)')} AS queries, {MEANS}
FROM chats WHERE n_chunks_config > 0 GROUP BY 1""")
def config_by_topk(spark, sf):
    return breakdowns.config_by_topk(_chats(spark, sf))


@query("tool_usage", with_(LOG) + f"""
SELECT tool_name, {big('count(*)')} AS calls, {mean('chunk_similarity_avg')} AS avg_similarity,
  100.0::DOUBLE * count(*) / (SELECT count(*) FROM chats) AS pct_of_queries
FROM chats WHERE tool_called GROUP BY tool_name""")
def tool_usage(spark, sf):
    return breakdowns.tool_usage(_chats(spark, sf))


VOTE_COLS = f"""{big('count(*)')} AS total, {big('count_if(liked)')} AS likes,
  {big('count_if(NOT liked)')} AS dislikes, {big('count_if(liked IS NULL)')} AS other,
  {rate('count_if(liked)', '(count_if(liked) + count_if(NOT liked))')} AS satisfaction_pct"""


@query("vote_analysis", with_(LOG) + f"""
SELECT model, {VOTE_COLS} FROM votes GROUP BY ROLLUP (model)""")
def vote_analysis(spark, sf):
    return breakdowns.vote_analysis(tables.vote_log(spark, sf))


@query("vote_summary", with_(LOG) + f"SELECT {VOTE_COLS} FROM votes")
def vote_summary(spark, sf):
    return breakdowns.vote_summary(tables.vote_log(spark, sf))


@query("category_counters", with_(LOG) + " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {d} AS value, {COUNT} FROM chats GROUP BY {d}"
    for d in ["workflow", "provider", "model", "audience_tier"]))
def category_counters(spark, sf):
    return breakdowns.category_counters(_chats(spark, sf))


@query("daily_turns", with_(LOG) + f"""
SELECT CAST(ts AS DATE) AS day, {big('count(*)')} AS turns FROM chats GROUP BY 1""")
def daily_turns(spark, sf):
    return breakdowns.daily_turns(_chats(spark, sf))


@query("daily_sessions", with_(LOG) + f"""
SELECT day, {big('count(*)')} AS sessions FROM (
  SELECT session_id, CAST(min(ts) AS DATE) AS day FROM chats WHERE trim(session_id) <> '' GROUP BY 1)
GROUP BY day""")
def daily_sessions(spark, sf):
    turns = _chats(spark, sf).withColumn("message", F.lit(""))
    return breakdowns.daily_sessions(sessions.real_sessions(sessions.session_summary(turns)))


@query("session_depth_hist", with_(LOG, NAMED, SIZES) + f"""
SELECT {big('turns')} AS turns, {big('count(*)')} AS sessions FROM sizes GROUP BY 1""")
def session_depth_hist(spark, sf):
    return breakdowns.session_depth_hist(
        sessions.real_sessions(sessions.session_sizes(_chats(spark, sf))))


@query("daily_rollup", with_(LOG, f"""
s AS (SELECT {local_day('min(ts)')} AS day, count(*) AS n FROM chats WHERE trim(session_id) <> '' GROUP BY session_id),
sd AS (SELECT day, count(*) AS sessions, sum(n) AS st, count_if(n = 1) AS one FROM s GROUP BY day),
td AS (SELECT {local_day('ts')} AS day, count(*) AS turns FROM chats WHERE trim(session_id) <> '' GROUP BY 1),
vd AS (SELECT {local_day('ts')} AS day, count(*) AS votes FROM votes GROUP BY 1)""") + f"""
SELECT day, {big('coalesce(sessions, 0)')} AS sessions, {big('coalesce(turns, 0)')} AS turns,
  {big('coalesce(one, 0)')} AS one_turn_sessions,
  CASE WHEN sessions > 0 THEN CAST(st AS DOUBLE) / sessions ELSE 0.0 END AS avg_turns_per_session,
  {big('coalesce(votes, 0)')} AS votes
FROM sd FULL JOIN td USING (day) FULL JOIN vd USING (day)""")
def daily_rollup(spark, sf):
    turns = sessions.analysable_turns(_chats(spark, sf).withColumn("message", F.lit("")))
    return breakdowns.daily_rollup(turns, tables.vote_log(spark, sf), ZONE)


# --- top lists -------------------------------------------------------------

def _count_top_sql(key: str, source: str, name: str, n: int, where: str = "true") -> str:
    return (f"SELECT {key} AS {name}, {COUNT} FROM {source} WHERE {where} "
            f"GROUP BY 1 ORDER BY count DESC, {name} LIMIT {n}")


MSG = with_(LOG, MESSAGES)


@query("top_prompts", MSG + _count_top_sql("lower(trim(message))", "chats_m", "message", 20,
                                           "length(trim(message)) >= 1"))
def top_prompts(spark, sf):
    return toplists.top_prompts(_chats_m(spark, sf))


@query("top_prompts_exact", MSG + _count_top_sql("message", "chats_m", "prompt", 15,
                                                 "message IS NOT NULL"))
def top_prompts_exact(spark, sf):
    return toplists.top_prompts_exact(_chats_m(spark, sf))


NORM_PROMPT = r"""trim(regexp_replace(translate(trim(regexp_replace(lower(message), '\s+', ' ', 'g')),
  '"''?!.,:;—-()', ''), '\s+', ' ', 'g'))"""


@query("top_prompts_normalized", MSG + _count_top_sql(
    NORM_PROMPT, "chats_m", "normalized_prompt", 15, "message IS NOT NULL"))
def top_prompts_normalized(spark, sf):
    return toplists.top_prompts_normalized(_chats_m(spark, sf))


@query("top_first_prompts", FULL + _count_top_sql("trim(coalesce(first_message, ''))", "sess",
                                                  "prompt", 10))
def top_first_prompts(spark, sf):
    return toplists.top_first_prompts(sessions.first_last_prompt(_chats_m(spark, sf)))


@query("top_all_prompts", MSG + _count_top_sql("trim(message)", "chats_m", "prompt", 10,
                                               "trim(message) <> ''"))
def top_all_prompts(spark, sf):
    return toplists.top_all_prompts(_chats_m(spark, sf))


@query("low_similarity", with_(LOG) + """
SELECT row_id, session_id, chunk_similarity_avg FROM chats WHERE chunk_similarity_avg < 0.55
ORDER BY chunk_similarity_avg, row_id LIMIT 100""")
def low_similarity(spark, sf):
    return toplists.low_similarity(_chats(spark, sf)).select(
        "row_id", "session_id", "chunk_similarity_avg")


@query("slow_responses", with_(LOG) + """
SELECT row_id, session_id, latency_ms, model FROM chats WHERE latency_ms > 5000
ORDER BY latency_ms DESC, row_id LIMIT 100""")
def slow_responses(spark, sf):
    return toplists.slow_responses(_chats(spark, sf)).select(
        "row_id", "session_id", "latency_ms", "model")


@query("response_outliers", with_(LOG) + """
SELECT row_id, response_chars, workflow, model FROM chats ORDER BY response_chars DESC, row_id LIMIT 10""")
def response_outliers(spark, sf):
    return toplists.response_outliers(_chats(spark, sf)).select(
        "row_id", "response_chars", "workflow", "model")


@query("slowest_rows", with_(LOG) + """
SELECT row_id, latency_ms FROM chats ORDER BY latency_ms DESC, row_id LIMIT 15""")
def slowest_rows(spark, sf):
    return toplists.slowest_rows(_chats(spark, sf)).select("row_id", "latency_ms")


@query("best_worst_retrieval", with_(LOG) + """
(SELECT row_id, chunk_similarity_avg, 'worst' AS side FROM chats ORDER BY chunk_similarity_avg ASC NULLS LAST, row_id LIMIT 15)
UNION ALL
(SELECT row_id, chunk_similarity_avg, 'best' AS side FROM chats ORDER BY chunk_similarity_avg DESC NULLS LAST, row_id LIMIT 15)""")
def best_worst_retrieval(spark, sf):
    return toplists.best_worst_retrieval(_chats(spark, sf)).select(
        "row_id", "chunk_similarity_avg", "side")


@query("error_sessions", FULL + """
SELECT session_id, error_turns, turns FROM sess WHERE error_turns > 0""")
def error_sessions(spark, sf):
    return toplists.error_sessions(_sessions(spark, sf)).select(
        "session_id", "error_turns", "turns")


@query("recent_sessions", FULL + """
SELECT session_id, session_start, turns FROM sess
ORDER BY session_start DESC NULLS LAST, session_id LIMIT 100""")
def recent_sessions(spark, sf):
    return toplists.recent_sessions(_sessions(spark, sf)).select(
        "session_id", "session_start", "turns")


@query("longest_sessions", FULL + """
SELECT session_id, session_start, turns FROM sess
ORDER BY turns DESC, session_start, session_id LIMIT 15""")
def longest_sessions(spark, sf):
    return toplists.longest_sessions(_sessions(spark, sf)).select(
        "session_id", "session_start", "turns")


@query("recent_questions", MSG + """
SELECT row_id, ts, message FROM chats_m ORDER BY ts DESC, row_id DESC LIMIT 30""")
def recent_questions(spark, sf):
    return toplists.recent_questions(_chats_m(spark, sf)).select("row_id", "ts", "message")


@query("problem_rows", with_(LOG) + """
SELECT row_id, had_error, empty_response, n_chunks_retrieved FROM chats
WHERE had_error OR empty_response OR n_chunks_retrieved = 0 ORDER BY ts DESC, row_id DESC LIMIT 20""")
def problem_rows(spark, sf):
    return toplists.problem_rows(_chats(spark, sf)).select(
        "row_id", "had_error", "empty_response", "n_chunks_retrieved")


@query("disliked_responses", with_(LOG) + """
SELECT row_id, ts, model FROM votes WHERE liked = false ORDER BY ts, row_id LIMIT 10""")
def disliked_responses(spark, sf):
    return toplists.disliked_responses(tables.vote_log(spark, sf)).select("row_id", "ts", "model")


@query("golden_set_candidates", MSG + """
SELECT message, row_id, session_id, turn_index, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY trim(message) ORDER BY
    NOT (turn_index > 1), ts, row_id) AS rn FROM chats_m
  WHERE NOT is_owner_traffic AND trim(message) <> ''
    AND NOT regexp_matches(message, '[\\w\\.-]+@[\\w\\.-]+\\.\\w+')
    AND NOT regexp_matches(message, '\\d{3}[-.\\s]?\\d{4}'))
WHERE rn = 1 ORDER BY NOT (turn_index > 1), ts, row_id LIMIT 60""")
def golden_set_candidates(spark, sf):
    return toplists.golden_set_candidates(_chats_m(spark, sf))


@query("format_duration", FULL + """
SELECT session_id, CASE WHEN s >= 3600 THEN concat(s // 3600, 'h ', s % 3600 // 60, 'm')
  WHEN s >= 60 THEN concat(s // 60, 'm ', s % 60, 's') ELSE concat(s, 's') END AS duration
FROM (SELECT session_id, CAST(floor(duration_seconds) AS BIGINT) AS s FROM sess)""")
def format_duration(spark, sf):
    from murmur.functions import text
    return _sessions(spark, sf).select(
        "session_id", text.format_duration(F.col("duration_seconds")).alias("duration"))
