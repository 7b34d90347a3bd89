"""Registered composed jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.catalog.log_queries import LINES_SQL, ZONE, local_day
from murmur.catalog.registry import query
from murmur.catalog.sqlparts import LOG, USER_MESSAGES, big, with_
from murmur.catalog.text_queries import MARKDOWN_SQL, redact_sql
from murmur.functions import sql as sql_functions
from murmur.plans import reports
from murmur.sources import logs, tables


@query("sql_functions", with_(USER_MESSAGES) + rf"""
SELECT message_id, {redact_sql('message')} AS redacted, {MARKDOWN_SQL.format(x='message')} AS level,
  trim(regexp_replace(translate(trim(regexp_replace(lower(message), '\s+', ' ', 'g')),
  '"''?!.,:;—-()', ''), '\s+', ' ', 'g')) AS prompt,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - (length(message) / 100.0::DOUBLE) * (length(message) / 100.0::DOUBLE) / 2.0::DOUBLE)) AS sim FROM um""")
def sql_functions_query(spark, sf):
    messages = tables.messages(spark, sf)
    sql_functions.register(spark)
    return messages.selectExpr(
        "message_id", "redact_pii(message) AS redacted", "markdown_level(message) AS level",
        "normalize_prompt(message) AS prompt", "sim_from_l2(length(message) / 100D) AS sim")


@query("plan_dashboard_daily", with_(LOG) + f"""
SELECT CAST(ts AS DATE) AS day, {big('count(*)')} AS turns FROM chats WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-21'
  AND workflow <> 'standard' AND NOT is_owner_traffic AND trim(session_id) <> '' AND session_id NOT IN (
    SELECT session_id FROM log WHERE is_owner_traffic AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-21') GROUP BY 1""")
def plan_dashboard_daily(spark, sf):
    chats, votes = logs.split_rows(tables.query_log(spark, sf).withColumn("message", F.lit("")))
    return reports.dashboard(chats, votes, "session", "2024-01-03", "2024-01-20",
                             ["walkthrough", "diagram_only"])["daily_turns"]


@query("plan_file_report_counters", with_(LOG) + " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {d} AS value, {big('count(*)')} AS count FROM chats WHERE trim(session_id) <> '' AND {local_day('ts')} >= DATE '2024-01-10' GROUP BY {d}"
    for d in ["workflow", "provider", "model", "audience_tier"]))
def plan_file_report_counters(spark, sf):
    chats, votes = logs.split_rows(tables.query_log(spark, sf).withColumn("message", F.lit("")))
    return reports.file_report(chats, votes, "none", "2024-01-10", ZONE)["counters"]


@query("plan_load_lines", with_(LOG, LINES_SQL) + f"""
SELECT model, {big('count(*)')} AS turns FROM lines WHERE shape = 'ok' AND event IS NULL AND NOT is_owner_traffic GROUP BY 1""")
def plan_load_lines(spark, sf):
    """The whole path from log files on storage to a breakdown."""
    from murmur.catalog.log_queries import _lines
    from murmur.session import scratch_dir
    path = scratch_dir(spark, "log")
    _lines(spark, sf).select("value").write.text(path)
    chats, _, _ = logs.load_query_log(spark, path, owner_filter="row")
    return chats.groupBy("model").agg(F.count(F.lit(1)).alias("turns"))


@query("plan_summary_export", with_(LOG) + f"""
SELECT 'workflow' AS section, workflow AS name, {big('count(*)')} AS count FROM chats GROUP BY workflow
UNION ALL SELECT 'model', model, {big('count(*)')} FROM chats GROUP BY model
UNION ALL SELECT 'gaps', 'lowest', {big('least(20, count_if(chunk_similarity_avg < 0.55))')} FROM chats
UNION ALL SELECT 'votes', 'disliked', {big('count_if(NOT liked)')} FROM votes""")
def plan_summary_export(spark, sf):
    """The export written and read again."""
    from murmur.session import scratch_dir
    chats, votes = logs.split_rows(tables.query_log(spark, sf).withColumn("message", F.lit("")))
    path = scratch_dir(spark, "export")
    reports.write_summary_export(reports.summary_export(chats, votes), path)
    row = spark.read.json(f"{path}/summary", schema="workflow struct<workflows: map<string, struct<count: bigint>>>, "
                          "model struct<models: map<string, struct<count: bigint>>>, "
                          "knowledge_gaps struct<lowest: array<struct<row_id: bigint>>>")
    part = lambda section, c: row.select(F.lit(section).alias("section"), F.explode(c).alias("name", "v")).select(
        "section", "name", "v.count")
    disliked = spark.read.option("header", True).csv(f"{path}/disliked")
    return (part("workflow", "workflow.workflows").unionByName(part("model", "model.models"))
            .unionByName(row.select(F.lit("gaps").alias("section"), F.lit("lowest").alias("name"),
                                    F.size("knowledge_gaps.lowest").cast("bigint").alias("count")))
            .unionByName(disliked.agg(F.count(F.lit(1)).alias("count")).select(
                F.lit("votes").alias("section"), F.lit("disliked").alias("name"), "count")))
