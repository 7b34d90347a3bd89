"""Registered streams: each runs to the end of its input and is compared with plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.catalog.log_queries import LINES_SQL, local_day
from murmur.catalog.registry import query
from murmur.catalog.sqlparts import LOG, SESSION_KEY, big, with_, with_recursive
from murmur.catalog.text_queries import ONE_LINE, PHRASES, redact_sql, truncate_sql
from murmur.sources import tables
from murmur.streaming import jobs, state
from murmur.streaming.sinks import latest

LATE_SECONDS = 7200  # rows arrive up to so much after their time, in four batches


def _log(spark, sf):
    return tables.replay(tables.query_log(spark, sf), "ts", LATE_SECONDS)


def _turns(spark, sf):
    return _log(spark, sf).where(F.col("event").isNull())


def _line_stream(spark, sf):
    log = _log(spark, sf)
    m = F.col("row_id") % 90
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    body = F.to_json(F.struct(*[c for c in log.columns if c not in ("row_id", "ts")],
                              stamp.alias("ts")))
    return log.select("row_id", F.when(m == 3, "   ").when(m == 4, '{"a":').when(m == 5, "[1]")
                      .when(m == 6, "null").otherwise(body).alias("value"))


@query("stream_log_ingest", with_(LOG, LINES_SQL) + """
SELECT row_id, CASE WHEN shape <> 'ok' THEN 'quarantine' WHEN event = 'vote' THEN 'votes' ELSE 'chats' END AS destination
FROM lines WHERE row_id % 90 <> 3""")
def stream_log_ingest(spark, sf):
    parts = jobs.ingest_available(_line_stream(spark, sf), ("row_id",))
    out = None
    for name, df in parts.items():
        part = df.select("row_id", F.lit(name).alias("destination"))
        out = part if out is None else out.unionByName(part)
    return out


SPEED = 1000  # replayed so much faster, for buffers that fill and buffers that wait
FIRST_DAY = 1_704_067_200_000_000


@query("stream_microbatch_flush", with_recursive(LOG, f"""
t AS (SELECT row_id, session_id, latency_ms, "user", tm, row_number() OVER (PARTITION BY "user" ORDER BY tm, row_id) AS i FROM (
  SELECT l.row_id, l.session_id, l.latency_ms, CAST(e.user_id AS VARCHAR) AS "user", {FIRST_DAY} + (epoch_us(e.ts) - {FIRST_DAY}) // {SPEED} AS tm
  FROM log l JOIN events e ON e.event_id = l.row_id)),
walk AS (SELECT "user", i, tm AS first, 1 AS n, 1 AS flush FROM t WHERE i = 1 UNION ALL
  SELECT t."user", t.i, CASE WHEN n = 10 OR tm - first >= 300000000 THEN tm ELSE first END,
    CASE WHEN n = 10 OR tm - first >= 300000000 THEN 1 ELSE n + 1 END, flush + CASE WHEN n = 10 OR tm - first >= 300000000 THEN 1 ELSE 0 END
  FROM walk JOIN t ON t."user" = walk."user" AND t.i = walk.i + 1)""") + f"""
SELECT row_id, session_id, latency_ms, {big('flush')} AS flush, CASE WHEN max(n) OVER f = 10 THEN 'count'
  WHEN flush < max(flush) OVER (PARTITION BY t."user") OR first + 300000000 <= (SELECT max(tm) // 1000 * 1000 - 60000000 FROM t)
  THEN 'time' ELSE 'end' END AS reason FROM t JOIN walk ON t."user" = walk."user" AND t.i = walk.i
WINDOW f AS (PARTITION BY t."user", flush)""")
def stream_microbatch_flush(spark, sf):
    """Turns of each user, written at the tenth or five minutes after the first."""
    log, events = tables.query_log(spark, sf), tables.table(spark, sf, "events")
    faster = F.timestamp_micros(F.lit(FIRST_DAY) + F.expr(
        f"(unix_micros(CAST(ts AS TIMESTAMP)) - {FIRST_DAY}) div {SPEED}"))
    turns = events.select(F.col("event_id").alias("row_id"), faster.alias("ts"),
                          F.col("user_id").cast("string").alias("session"))
    flushed = jobs.run_to_end(tables.replay(turns, "ts", 60), state.flush_job(), "flush", "1 minute")
    return flushed.join(log.select("row_id", "session_id", "latency_ms"), "row_id").drop("session")


@query("stream_enrich", f"""SELECT conv_id, turn, {redact_sql('text')} AS message,
  {truncate_sql(ONE_LINE.replace('text', 'red'), 300)} AS assistant_response_preview, text = '' AS empty_response
FROM (SELECT *, {redact_sql('text')} AS red FROM conversations)""")
def stream_enrich(spark, sf):
    rows = tables.stream_table(spark, sf, "conversations").select(
        "conv_id", "turn", F.col("text").alias("message"),
        F.col("text").alias("assistant_response"), F.lit("openai/m1").alias("model"))
    return jobs.run(jobs.enriched(rows), "enrich").select(
        "conv_id", "turn", "message", "assistant_response_preview", "empty_response")


@query("stream_session_summary", with_(LOG) + f"""
SELECT {SESSION_KEY} AS session_id, min(ts) AS session_start, max(ts) AS session_end, {big('count(*)')} AS turns,
  CAST(sum(CAST(cost_usd AS DECIMAL(20,6))) AS DOUBLE) AS total_cost_usd, {big('count_if(had_error)')} AS error_turns,
  arg_max(workflow, (ts, row_id)) AS last_workflow FROM chats GROUP BY 1""")
def stream_session_summary(spark, sf):
    parts = jobs.run(jobs.session_parts(_turns(spark, sf)), "sessions", "update")
    return jobs.merge_sessions(latest(parts, ["session_id", "w"]))


@query("stream_gap_sessions", """
WITH o AS (SELECT user_id AS user, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(first) OVER (PARTITION BY user ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o)
SELECT user, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, CAST(count(*) AS BIGINT) AS turns FROM g GROUP BY user, s""")
def stream_gap_sessions(spark, sf):
    """All sessions: those that the watermark has closed and those still open at the end."""
    turns = tables.table(spark, sf, "events").select(
        F.col("user_id").alias("user"), F.col("ts").cast("timestamp").alias("ts"))
    return jobs.whole_gap_sessions(tables.replay(turns, "ts", LATE_SECONDS))


@query("stream_usage_totals", with_(LOG) + f"""
SELECT {SESSION_KEY} AS session_id, {big('sum(coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0))')} AS total_tokens,
  CAST(sum(CAST(cost_usd AS DECIMAL(20,6))) AS DOUBLE) AS total_cost_usd, {big('count(*)')} AS total_calls FROM chats GROUP BY 1""")
def stream_usage_totals(spark, sf):
    parts = jobs.run(jobs.usage_parts(_turns(spark, sf)), "usage", "update")
    return jobs.merge_usage(latest(parts, ["session_id", "w"]))


@query("stream_daily_kpis", with_(LOG) + f"""
SELECT {local_day('ts')} AS day, {big('count(*)')} AS turns, {big('count_if(had_error)')} AS errors,
  {big('count_if(chunk_similarity_avg < 0.55)')} AS gaps FROM chats GROUP BY 1""")
def stream_daily_kpis(spark, sf):
    parts = jobs.run(jobs.kpi_parts(_turns(spark, sf)), "daily", "update")
    return jobs.merge_daily(latest(parts, ["w"]))


@query("stream_gap_alert", with_(LOG) + f"""
SELECT * FROM (SELECT time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE * i AS window_start, {big('count(*)')} AS turns,
  100.0::DOUBLE * count_if(chunk_similarity_avg < 0.55) / count(*) AS gap_pct FROM chats CROSS JOIN range(12) r(i) GROUP BY 1) WHERE gap_pct > 20""")
def stream_gap_alert(spark, sf):
    windows = jobs.run(jobs.gap_windows(_turns(spark, sf)), "alerts", "update")
    return jobs.gap_alerts(latest(windows, ["window_start"]))


@query("stream_dedupe", with_(LOG) + "SELECT row_id, model FROM log")
def stream_dedupe(spark, sf):
    doubled = _log(spark, sf).select("row_id", "ts", "model").withColumn(
        "copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return jobs.run(jobs.dedupe(doubled), "dedupe").select("row_id", "model")


# --- per-session state ---------------------------------------------------------

def _events(spark, sf):
    """Turns of a conversation, a vote after every answer, an owner mark in every system turn.

    A conversation starts every five minutes and takes a turn a minute; turns arrive out of order.
    """
    c = tables.table(spark, sf, "conversations")
    kinds = (F.when(F.col("role") == "assistant", F.array(F.lit("assistant"), F.lit("vote")))
             .when(F.col("role") == "system", F.array(F.lit("owner")))
             .otherwise(F.array(F.col("role"))))
    rows = c.select(F.col("conv_id").cast("string").alias("session"),
                    F.timestamp_seconds(FIRST_DAY // 1_000_000 + F.col("conv_id") * 300 + F.col("turn") * 60).alias("ts"),
                    F.col("turn").alias("pos"), F.explode(kinds).alias("kind"), "text",
                    (F.length("text") % 2 == 0).alias("flag"))
    return state.session_events(tables.replay(rows, "ts", 3600), PHRASES)


def _state(spark, sf):
    return jobs.run_to_end(_events(spark, sf), state.SESSION, "state", "1 hour")


@query("stream_turn_index", f"""
SELECT CAST(conv_id AS VARCHAR) AS session, turn AS pos, {big('n')} AS turn_index FROM (SELECT conv_id, turn, role,
  count(CASE WHEN role = 'user' THEN 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE role = 'user'""")
def stream_turn_index(spark, sf):
    return _state(spark, sf).where(F.col("kind") == "user").select("session", "pos", "turn_index")


@query("stream_tier_state", """
SELECT CAST(conv_id AS VARCHAR) AS session, turn AS pos, CASE max(r) OVER (PARTITION BY conv_id ORDER BY turn) WHEN 2 THEN 'inner_circle'
  WHEN 1 THEN 'personal' ELSE 'public' END AS audience_tier
FROM (SELECT conv_id, turn, CASE WHEN role <> 'user' THEN 0 WHEN contains(lower(text), 'thtion') THEN 2
  WHEN contains(lower(text), 'thble') OR contains(lower(text), 'nicht') OR contains(lower(text), 'heing') THEN 1
  ELSE 0 END AS r FROM conversations)""")
def stream_tier_state(spark, sf):
    return _state(spark, sf).where(F.col("kind") != "vote").select("session", "pos", "audience_tier")


@query("stream_owner_flag", """
SELECT CAST(conv_id AS VARCHAR) AS session, turn AS pos, coalesce(last_value(CASE WHEN role = 'system' THEN length(text) % 2 = 0 END IGNORE NULLS)
  OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), false) AS is_owner FROM conversations""")
def stream_owner_flag(spark, sf):
    return _state(spark, sf).where(F.col("kind") != "vote").select("session", "pos", "is_owner")


@query("stream_vote_attribution", """
SELECT session, pos, user_message FROM (SELECT CAST(conv_id AS VARCHAR) AS session, turn AS pos, role,
  last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS user_message FROM conversations)
WHERE role = 'assistant'""")
def stream_vote_attribution(spark, sf):
    return _state(spark, sf).where(F.col("kind") == "vote").select("session", "pos", "user_message")


@query("stream_vote_answer", """
SELECT CAST(conv_id AS VARCHAR) AS session, turn AS pos, text AS answer FROM conversations WHERE role = 'assistant'""")
def stream_vote_answer(spark, sf):
    """Every vote goes to the answer it follows."""
    return _state(spark, sf).where(F.col("kind") == "vote").select("session", "pos", "answer")
