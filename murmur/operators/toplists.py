"""Top-k reports: ``orderBy(...).limit(n)`` with an id tie-break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions import loose, numeric, text


def _top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def _count_top(df: DataFrame, key: Column, name: str, n: int) -> DataFrame:
    counted = df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("count"))
    return _top(counted, n, F.col("count").desc(), F.col(name))


def top_prompts(turns: DataFrame, n: int = 20, min_len: int = 1) -> DataFrame:
    key = F.lower(loose.loose_text(F.col("message")))
    return _count_top(turns.where(F.length(key) >= min_len), key, "message", n)


def top_prompts_exact(turns: DataFrame, n: int = 15) -> DataFrame:
    return _count_top(turns.where(F.col("message").isNotNull()), F.col("message"), "prompt", n)


def top_prompts_normalized(turns: DataFrame, n: int = 15) -> DataFrame:
    return _count_top(turns.where(F.col("message").isNotNull()),
                      text.normalize_prompt(F.col("message")), "normalized_prompt", n)


def top_first_prompts(sessions: DataFrame, n: int = 10) -> DataFrame:
    """Blank first prompts count too."""
    return _count_top(sessions, loose.loose_text(F.col("first_message")), "prompt", n)


def top_all_prompts(turns: DataFrame, n: int = 10) -> DataFrame:
    key = loose.loose_text(F.col("message"))
    return _count_top(turns.where(key != ""), key, "prompt", n)


def low_similarity(turns: DataFrame, threshold: float = numeric.GAP_SIMILARITY,
                   n: int = 100) -> DataFrame:
    return _top(turns.where(F.col("chunk_similarity_avg") < threshold), n,
                F.col("chunk_similarity_avg"), F.col("row_id"))


def slow_responses(turns: DataFrame, threshold_ms: int = numeric.SLOW_MS,
                   n: int = 100) -> DataFrame:
    return _top(turns.where(F.col("latency_ms") > threshold_ms), n,
                F.col("latency_ms").desc(), F.col("row_id"))


def response_outliers(turns: DataFrame, n: int = 10) -> DataFrame:
    return _top(turns, n, F.col("response_chars").desc_nulls_last(), F.col("row_id"))


def slowest_rows(turns: DataFrame, n: int = 15) -> DataFrame:
    return _top(turns, n, F.col("latency_ms").desc_nulls_last(), F.col("row_id"))


def best_worst_retrieval(turns: DataFrame, n: int = 15) -> DataFrame:
    """The n best and n worst retrievals, tagged by side."""
    sim = F.col("chunk_similarity_avg")
    worst = _top(turns, n, sim.asc_nulls_last(), F.col("row_id"))
    best = _top(turns, n, sim.desc_nulls_last(), F.col("row_id"))
    return (worst.withColumn("side", F.lit("worst"))
            .unionByName(best.withColumn("side", F.lit("best"))))


def error_sessions(sessions: DataFrame, n: int | None = None) -> DataFrame:
    hit = sessions.where(F.col("error_turns") > 0)
    order = [F.col("error_turns").desc(), F.col("turns").desc(), F.col("session_id")]
    return _top(hit, n, *order) if n else hit.orderBy(*order)


def recent_sessions(sessions: DataFrame, n: int = 100) -> DataFrame:
    return _top(sessions, n, F.col("session_start").desc_nulls_last(), F.col("session_id"))


def longest_sessions(sessions: DataFrame, n: int = 15) -> DataFrame:
    return _top(sessions, n, F.col("turns").desc(), F.col("session_start"), F.col("session_id"))


def recent_questions(turns: DataFrame, n: int = 30) -> DataFrame:
    return _top(turns, n, F.col("ts").desc_nulls_last(), F.col("row_id").desc())


def problem_rows(turns: DataFrame, n: int = 20) -> DataFrame:
    bad = (F.coalesce("had_error", F.lit(False)) | F.coalesce("empty_response", F.lit(False))
           | (F.coalesce("n_chunks_retrieved", F.lit(0)) == 0))
    return recent_questions(turns.where(bad), n)


def disliked_responses(votes: DataFrame, n: int | None = 10) -> DataFrame:
    hit = votes.where(~F.col("liked"))
    order = [F.col("ts"), F.col("row_id")]
    return _top(hit, n, *order) if n else hit.orderBy(*order)


def recent_artifacts(artifacts: DataFrame, n: int = 20, order: str = "row_id") -> DataFrame:
    return _top(artifacts, n, F.col(order).desc())


def golden_set_candidates(turns: DataFrame, n: int = 60) -> DataFrame:
    """One row per message for labelling: owner rows and rows with personal data out,
    follow-up turns first, unknown owner flag after known, then oldest."""
    msg = loose.loose_text(F.col("message"))
    kept = turns.where(~F.coalesce("is_owner_traffic", F.lit(False)) & (msg != "")
                       & (text.redact_pii(msg) == msg))
    rank = F.struct((~(F.col("turn_index") > 1)).alias("a"),
                    F.col("is_owner_traffic").isNull().alias("b"),
                    F.col("ts").alias("ts"), F.col("row_id").alias("row_id"))
    per_message = kept.groupBy(msg.alias("message")).agg(
        F.min_by(F.struct("row_id", "session_id", "turn_index", "ts"), rank).alias("r"),
        F.min(rank).alias("k"))
    return _top(per_message, n, F.col("k")).select("message", "r.*")
