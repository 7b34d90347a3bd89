"""Session reconstruction from turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions import numeric

MISSING_PREFIX = "__missing_session__"


def session_key(row_id: str = "row_id") -> Column:
    """Blank ids get one synthetic session per row, so they never become one huge key."""
    sid = F.col("session_id")
    blank = sid.isNull() | (F.trim(sid) == "")
    return F.when(blank, F.concat(F.lit(f"{MISSING_PREFIX}:"), F.col(row_id).cast("string"))
                  ).otherwise(sid)


def _turn_order() -> Column:
    """(ts, turn_index) with nulls last, usable as a min_by/max_by key."""
    return F.struct(F.col("ts").isNull(), F.col("ts"), F.col("turn_index").isNull(),
                    F.col("turn_index"), F.col("row_id"))


def _seconds(start: str, end: str) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def session_summary(turns: DataFrame) -> DataFrame:
    """One row per session. All aggregates combine before the shuffle."""
    said = F.when(F.col("message").isNotNull(), _turn_order())
    out = turns.groupBy(session_key().alias("session_id")).agg(
        F.min("ts").alias("session_start"),
        F.max("ts").alias("session_end"),
        F.count("message").alias("turns"),
        numeric.exact_mean(F.col("latency_ms")).alias("avg_latency_ms"),
        numeric.exact_mean(F.col("chunk_similarity_avg")).alias("avg_similarity"),
        F.coalesce(numeric.exact_sum(F.col("cost_usd")), F.lit(0.0)).alias("total_cost_usd"),
        F.count_if(F.col("had_error")).alias("error_turns"),
        F.min_by("message", said).alias("first_message"),
        F.max_by("message", said).alias("last_message"))
    return out.withColumn("duration_seconds", _seconds("session_start", "session_end"))


def session_sizes(turns: DataFrame) -> DataFrame:
    """Only what KPI cards need: turns per session, no text in the shuffle."""
    return turns.groupBy(session_key().alias("session_id")).agg(
        F.count(F.lit(1)).alias("turns"))


def _distinct_list(c: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit("")))), ", ")


def session_summary_ext(turns: DataFrame, zone: str = "America/Chicago") -> DataFrame:
    """Report form: local start day, text of the first and last prompt, value lists, flags.

    The value lists range over configured providers, models and tiers, so their
    length is bounded by configuration and not by the number of turns.
    """
    order = F.struct("ts", "row_id")
    prompt = F.trim(F.coalesce(F.col("message"), F.lit("")))
    out = turns.groupBy("session_id").agg(
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.count(F.lit(1)).alias("turns"),
        F.min_by(prompt, order).alias("first_prompt"),
        F.max_by(prompt, order).alias("last_prompt"),
        numeric.exact_mean(F.col("latency_ms")).alias("avg_latency_ms"),
        numeric.exact_mean(F.col("chunk_similarity_avg")).alias("avg_similarity"),
        F.sum(F.col("response_chars").cast("bigint")).alias("total_response_chars"),
        F.coalesce(numeric.exact_sum(F.col("cost_usd")), F.lit(0.0)).alias("total_cost_usd"),
        _distinct_list("provider").alias("providers"),
        _distinct_list("model").alias("models"),
        _distinct_list("audience_tier").alias("audience_tiers"),
        F.bool_or(F.coalesce(F.col("is_owner_traffic"), F.lit(False)))
        .alias("contains_owner_marked_rows"),
        F.bool_or(F.coalesce(F.col("had_error"), F.lit(False))).alias("has_error"),
        F.bool_or(F.coalesce(F.col("empty_response"), F.lit(False))).alias("has_empty_response"))
    return out.withColumn("start_local_date",
                          F.to_date(F.from_utc_timestamp("start_ts", zone)))


def analysable_turns(turns: DataFrame, turn_validity: str = "report") -> DataFrame:
    """'report' keeps blank messages, 'analyzer' rejects them."""
    keep = (F.trim(F.coalesce("session_id", F.lit(""))) != "") & F.col("turn_index").isNotNull() \
        & F.col("message").isNotNull() & F.col("ts").isNotNull()
    if turn_validity == "analyzer":
        keep = F.col("ts").isNotNull() & (F.trim(F.coalesce("message", F.lit(""))) != "")
    elif turn_validity != "report":
        raise ValueError("turn_validity must be 'report' or 'analyzer'")
    return turns.where(keep)


def real_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.where(~F.col("session_id").startswith(MISSING_PREFIX))


def real_turns(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """Turns of sessions that carry a true id."""
    return turns.join(real_sessions(sessions).select("session_id"), "session_id", "left_semi")


def first_last_prompt(turns: DataFrame) -> DataFrame:
    said = F.when(F.col("message").isNotNull(), _turn_order())
    return turns.groupBy(session_key().alias("session_id")).agg(
        F.min_by("message", said).alias("first_message"),
        F.max_by("message", said).alias("last_message"))
