"""Log → report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.operators import breakdowns, filters, kpis, sessions, toplists
from murmur.sources import sinks


def dashboard(chats: DataFrame, votes: DataFrame, owner_mode: str = "session",
              start: str | None = None, end: str | None = None,
              workflows: list[str] | None = None) -> dict[str, DataFrame]:
    """Tables behind the dashboard, over sessions that carry a true id. All lazy."""
    chats = filters.date_range(chats, start, end)
    votes = filters.date_range(votes, start, end)
    chats, votes = filters.exclude_owner(chats, votes, owner_mode)
    chats = filters.by_workflow(chats, workflows)
    summary = sessions.session_summary(chats)
    real = sessions.real_sessions(summary)
    turns = sessions.real_turns(chats, summary)
    return {
        "kpis": kpis.overall_kpis(turns, real), "health": kpis.health_rates(turns),
        "daily_sessions": breakdowns.daily_sessions(real),
        "daily_turns": breakdowns.daily_turns(turns),
        "session_depth": breakdowns.session_depth_hist(real),
        "top_prompts": toplists.top_prompts(turns), "low_similarity": toplists.low_similarity(turns),
        "slow_responses": toplists.slow_responses(turns),
        "error_sessions": toplists.error_sessions(real),
        "recent_sessions": toplists.recent_sessions(real),
        "recent_questions": toplists.recent_questions(turns),
        "votes": breakdowns.vote_analysis(votes)}


def file_report(chats: DataFrame, votes: DataFrame, owner_mode: str = "none",
                cutoff: str | None = None, zone: str = "America/Chicago") -> dict[str, DataFrame]:
    """Tables of the file report: sessions, daily counts, totals and counters."""
    turns = sessions.analysable_turns(chats)
    views = kpis.owner_view_compare(filters.cutoff_local(turns, cutoff, zone),
                                    filters.cutoff_local(votes, cutoff, zone))
    turns, votes = filters.exclude_owner(turns, votes, owner_mode)
    turns = filters.cutoff_local(turns, cutoff, zone)
    votes = filters.cutoff_local(votes, cutoff, zone)
    rows = sessions.session_summary_ext(turns, zone)
    return {"summary": kpis.engagement_summary(turns, votes), "sessions": rows,
            "daily_counts": breakdowns.daily_rollup(turns, votes, zone),
            "counters": breakdowns.category_counters(turns), "owner_views": views,
            "top_prompts": toplists.top_all_prompts(turns)}


def _by_name(rows: DataFrame, name: str) -> DataFrame:
    """One row: map from a configured name to the other columns."""
    entry = F.struct(F.col(name), F.struct(*[c for c in rows.columns if c != name]).alias("v"))
    return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(f"{name}s"))


def summary_export(turns: DataFrame, votes: DataFrame, n_gaps: int = 20) -> dict[str, DataFrame]:
    """The nested summary as one row, and every disliked answer as a table of its own.

    Workflows and models are configured names, so their maps stay small; the lowest gaps are a
    top list. Disliked answers grow with the log and are written from the tasks.
    """
    totals = turns.agg(F.count(F.lit(1)).alias("turns"), F.count_if("had_error").alias("errors"))
    flows = breakdowns.workflow_breakdown(turns).select(
        "workflow", "count", F.round("avg_similarity", 3).alias("avg_similarity"),
        F.floor("avg_latency_ms").alias("avg_latency_ms"))
    models = breakdowns.model_usage(turns).select(
        "model", "count", F.floor("avg_latency_ms").alias("avg_latency_ms"),
        F.round("avg_similarity", 3).alias("avg_similarity"))
    gaps = toplists.low_similarity(turns, n=n_gaps).agg(F.array_sort(F.collect_list(F.struct(
        F.col("chunk_similarity_avg").alias("similarity"), "row_id"))).alias("lowest"))
    summary = sinks.summary_row(
        totals=totals, votes=breakdowns.vote_summary(votes), workflow=_by_name(flows, "workflow"),
        model=_by_name(models, "model"), knowledge_gaps=gaps)
    return {"summary": summary, "disliked": toplists.disliked_responses(votes, None)}


def write_summary_export(tables: dict[str, DataFrame], path: str) -> None:
    sinks.write_summary(tables["summary"], f"{path}/summary")
    sinks.write_csv(tables["disliked"], f"{path}/disliked")
