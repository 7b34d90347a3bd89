"""Stream forms of the log operators; projections and parsers are the batch ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.functions import numeric
from murmur.operators import enrich, sessions
from murmur.session import scratch_dir
from murmur.sources import logs
from murmur.streaming.ordered import Job, finish, run_ordered
from murmur.streaming.sinks import run_and_keep, run_available

LATE = "2 hours"


def split_batch(batch: DataFrame, carry: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Parsed lines of one micro-batch by destination."""
    parsed = logs.parse_lines(batch)
    return {"chats": logs.chat_rows(parsed, carry), "votes": logs.vote_rows(parsed, carry),
            "quarantine": logs.bad_lines(parsed)}


def ingest(lines: DataFrame, out: str, carry: tuple[str, ...] = ()):
    """Lines → chats, votes and quarantine tables, one folder per micro-batch each."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, part in split_batch(batch, carry).items():
                part.write.mode("overwrite").parquet(f"{out}/{name}/batch_id={batch_id}")
        finally:
            batch.unpersist()
    return lines.writeStream.foreachBatch(write)


def ingest_available(lines: DataFrame, carry: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    spark = lines.sparkSession
    out, checkpoint = scratch_dir(spark, "ingest"), scratch_dir(spark, "ingest-checkpoint")
    query = (ingest(lines, out, carry).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return {n: spark.read.parquet(f"{out}/{n}") for n in ("chats", "votes", "quarantine")}


def enriched(rows: DataFrame) -> DataFrame:
    """Write-time enrichment, stateless."""
    return enrich.enrich_turns(rows)


# Totals of keys that live for ever are kept by key and event-time window: a window's state goes
# once the watermark has passed it, and what was written of it stays. ``merge_*`` adds the
# windows of a key up. ``latest`` of ["session_id", "w"] or ["w"] comes first (update mode).

def session_parts(turns: DataFrame, late: str = LATE, window: str = "1 day") -> DataFrame:
    """Summary of each session in each window (update mode); sums are decimal."""
    return (turns.withWatermark("ts", late)
            .groupBy(sessions.session_key().alias("session_id"), F.window("ts", window).alias("w"))
            .agg(F.min("ts").alias("session_start"), F.max("ts").alias("session_end"),
                 F.count(F.lit(1)).alias("turns"),
                 F.sum(F.col("cost_usd").cast("decimal(20,6)")).alias("cost"),
                 F.count_if("had_error").alias("error_turns"),
                 F.max(F.struct("ts", "row_id", "workflow")).alias("last")))


def merge_sessions(parts: DataFrame) -> DataFrame:
    return parts.groupBy("session_id").agg(
        F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"),
        F.sum("turns").alias("turns"), F.sum("cost").cast("double").alias("total_cost_usd"),
        F.sum("error_turns").alias("error_turns"),
        F.max("last").getField("workflow").alias("last_workflow"))


def gap_sessions(turns: DataFrame, gap: str = "30 minutes", late: str = LATE,
                 key: str = "user") -> DataFrame:
    """Sessions by inactivity where the log carries no session id."""
    return (turns.withWatermark("ts", late)
            .groupBy(F.session_window("ts", gap).alias("w"), key)
            .agg(F.count(F.lit(1)).alias("turns"))
            .select(key, F.col("w.start").alias("session_start"),
                    F.col("w.end").alias("session_end"), "turns"))


def open_gap_sessions(spark: SparkSession, checkpoint: str, key: str = "user") -> DataFrame:
    """Sessions of ``gap_sessions`` that the watermark has not closed, from the job's state."""
    held = spark.read.format("statestore").load(checkpoint)
    window = "value.session_window"
    return held.select(F.col(f"value.{key}").alias(key), F.col(f"{window}.start").alias("session_start"),
                       F.col(f"{window}.end").alias("session_end"), F.col("value.count").alias("turns"))


def usage_parts(calls: DataFrame, late: str = LATE, window: str = "1 day") -> DataFrame:
    """Tokens and cost of each session in each window (update mode)."""
    return (calls.withWatermark("ts", late)
            .groupBy(sessions.session_key().alias("session_id"), F.window("ts", window).alias("w"))
            .agg(F.sum(F.coalesce("prompt_tokens", F.lit(0))
                       + F.coalesce("completion_tokens", F.lit(0))).alias("tokens"),
                 F.sum(F.col("cost_usd").cast("decimal(20,6)")).alias("cost"),
                 F.count(F.lit(1)).alias("calls")))


def merge_usage(parts: DataFrame) -> DataFrame:
    return parts.groupBy("session_id").agg(
        F.sum("tokens").alias("total_tokens"),
        F.sum("cost").cast("double").alias("total_cost_usd"), F.sum("calls").alias("total_calls"))


def kpi_parts(turns: DataFrame, late: str = LATE) -> DataFrame:
    """Counts by quarter of an hour (update mode), the step that all zones' days are made of."""
    return (turns.withWatermark("ts", late).groupBy(F.window("ts", "15 minutes").alias("w")).agg(
        F.count(F.lit(1)).alias("turns"), F.count_if("had_error").alias("errors"),
        F.count_if(F.col("chunk_similarity_avg") < numeric.GAP_SIMILARITY).alias("gaps")))


def merge_daily(parts: DataFrame, zone: str = "America/Chicago") -> DataFrame:
    day = F.to_date(F.from_utc_timestamp("w.start", zone))
    return parts.groupBy(day.alias("day")).agg(
        *[F.sum(c).alias(c) for c in ("turns", "errors", "gaps")])


def gap_windows(turns: DataFrame, late: str = LATE, length: str = "1 hour",
                slide: str = "5 minutes") -> DataFrame:
    """Turns and gap share of sliding windows (update mode)."""
    pct = 100.0 * F.count_if(F.col("chunk_similarity_avg") < numeric.GAP_SIMILARITY) / F.count(
        F.lit(1))
    return (turns.withWatermark("ts", late).groupBy(F.window("ts", length, slide).alias("w"))
            .agg(F.count(F.lit(1)).alias("turns"), pct.alias("gap_pct"))
            .select(F.col("w.start").alias("window_start"), "turns", "gap_pct"))


def gap_alerts(windows: DataFrame) -> DataFrame:
    """Windows above the alert level. Later turns may take a window out again, so this comes after
    ``latest``."""
    return windows.where(F.col("gap_pct") > enrich.ALERT_GAP_PCT)


def dedupe(rows: DataFrame, key: str = "row_id", late: str = LATE) -> DataFrame:
    """First copy of every event id within the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run(frame: DataFrame, label: str, mode: str = "append") -> DataFrame:
    return run_available(frame, label, mode)


def run_to_end(events: DataFrame, job: Job, label: str, late: str) -> DataFrame:
    """All output of an ordered job, what waits at the end of the input included."""
    rows, checkpoint = run_and_keep(run_ordered(events, job, late), label)
    return rows.drop("batch_id").unionByName(finish(events, job, checkpoint))


def whole_gap_sessions(turns: DataFrame) -> DataFrame:
    """Closed sessions and those still open at the end of the input."""
    closed, checkpoint = run_and_keep(gap_sessions(turns), "gap-sessions")
    return closed.drop("batch_id").unionByName(open_gap_sessions(turns.sparkSession, checkpoint))
