"""Whole-log metrics. Each is one row (or one row per view)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions import numeric
from murmur.operators import filters, sessions
from murmur.scale import Quantile, counted_quantiles, grains

GAP, SLOW, VERBOSE = numeric.GAP_SIMILARITY, numeric.SLOW_MS, numeric.VERBOSE_CHARS


def _beside(*one_row_frames: DataFrame) -> DataFrame:
    """Put single-row results side by side by joining on a constant key."""
    out = one_row_frames[0].withColumn("__one", F.lit(1))
    for frame in one_row_frames[1:]:
        out = out.join(frame.withColumn("__one", F.lit(1)), "__one", "left")
    return out.drop("__one")


def _session_sizes_stats(sizes: DataFrame, turns: str = "__c") -> DataFrame:
    n = F.col(turns)
    return sizes.agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.coalesce(F.sum(n), F.lit(0)).alias("__turns"),
        F.count_if(n == 1).alias("one_turn_sessions"))


def _sizes(sizes: DataFrame, turns: str = "__c") -> DataFrame:
    """How many sessions have how many turns."""
    return sizes.groupBy(F.col(turns).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))


def _quantiles(counts: dict[str, DataFrame], wanted: dict[str, list[Quantile]]) -> DataFrame:
    """One row with the quantiles of several columns, from their counted values."""
    both = None
    for tag in wanted:
        part = counts[tag].where(F.col("__v").isNotNull()).select(
            F.lit(tag).alias("tag"), F.col("__v").cast("double").alias("__v"), "__c")
        both = part if both is None else both.unionByName(part)
    found = counted_quantiles(both, [q for part in wanted.values() for q in part], ("tag",))
    return found.agg(*[F.max(F.when(F.col("tag") == tag, F.col(q.name))).alias(q.name)
                       for tag, part in wanted.items() for q in part])


def overall_kpis(turns: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """The 13 headline KPIs; a missing similarity counts in the gap denominator."""
    facts = [
        F.count(F.lit(1)).alias("total_chat_turns"),
        F.count_if("had_error").alias("had_error_turns"),
        F.count_if("empty_response").alias("empty_response_turns"),
        numeric.exact_mean(F.col("latency_ms")).alias("avg_latency_ms"),
        numeric.exact_mean(F.col("chunk_similarity_avg")).alias("avg_similarity"),
        F.count_if(F.col("chunk_similarity_avg") < GAP).alias("__gaps"),
        F.coalesce(numeric.exact_sum(F.col("cost_usd")), F.lit(0.0)).alias("total_cost_usd")]
    keys = {"latency": F.col("latency_ms")}
    if summary is None:
        keys["session"] = sessions.session_key()
    parts = grains(turns, facts, keys)
    sizes = parts["session"] if summary is None else summary.select(F.col("turns").alias("__c"))
    parts["size"] = _sizes(sizes)
    wide = _beside(parts[""], _session_sizes_stats(sizes), _quantiles(parts, {
        "size": [Quantile("median_turns_per_session", 1, 2)],
        "latency": [Quantile("p95_latency_ms", 95, 100)]}))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return wide.select(
        "total_chat_turns", "total_sessions",
        F.coalesce(F.col("total_chat_turns") / F.when(F.col("total_sessions") > 0,
                                                      F.col("total_sessions")),
                   F.lit(0.0)).alias("avg_turns_per_session"),
        zero("median_turns_per_session"), "one_turn_sessions",
        numeric.rate_pct(F.col("one_turn_sessions"), F.col("total_sessions"))
        .alias("bounce_rate_pct"),
        "had_error_turns", "empty_response_turns",
        zero("avg_latency_ms"), zero("p95_latency_ms"), zero("avg_similarity"),
        numeric.rate_pct(F.col("__gaps"), F.col("total_chat_turns"))
        .alias("knowledge_gap_rate_pct"),
        "total_cost_usd")


def summary_stats(turns: DataFrame, votes: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Analyzer totals (default-fill profile); p95 is the exclusive quantile, null under 20 rows."""
    facts = [
        F.count(F.lit(1)).alias("total_queries"),
        F.min_by("ts", F.struct("ts", "row_id")).alias("first_ts"),
        F.max_by("ts", F.struct("ts", "row_id")).alias("last_ts"),
        F.floor(numeric.exact_mean(F.col("latency_ms"))).alias("latency_mean"),
        F.max("latency_ms").alias("latency_max"),
        numeric.exact_mean(F.col("chunk_similarity_avg")).alias("similarity_mean"),
        F.min("chunk_similarity_avg").alias("similarity_min"),
        F.floor(numeric.exact_mean(F.col("response_chars"))).alias("response_chars_mean"),
        F.count_if(F.col("chunk_similarity_avg") < GAP).alias("knowledge_gaps"),
        F.count_if(F.col("latency_ms") > SLOW).alias("slow_queries"),
        F.count_if(F.col("response_chars") > VERBOSE).alias("verbose_queries"),
        F.count_if("tool_called").alias("tool_calls"),
        F.count_if("had_error").alias("errors"),
        F.count_if(F.col("n_chunks_retrieved") == 0).alias("zero_retrieval"),
        F.count_if("empty_response").alias("empty_responses")]
    parts = grains(turns, facts, {c: F.col(c) for c in ("latency_ms", "response_chars", "chunk_similarity_avg")})
    middles = _quantiles(parts, {
        "latency_ms": [Quantile("latency_median", 1, 2),
                       Quantile("latency_p95", 19, 20, "exclusive", min_rows=20)],
        "response_chars": [Quantile("response_chars_median", 1, 2)],
        "chunk_similarity_avg": [Quantile("similarity_median", 1, 2)]})
    middles = middles.withColumns({c: F.floor(c) for c in (
        "latency_median", "latency_p95", "response_chars_median")})
    voted = votes.agg(
        F.count(F.lit(1)).alias("total_votes"),
        F.count_if(F.col("liked")).alias("likes"),
        F.count_if(~F.col("liked")).alias("dislikes"))
    odd = artifacts.agg(
        F.count(F.lit(1)).alias("artifacts_total"),
        F.count_if("is_owner_traffic").alias("artifacts_owner_marked"))
    return _beside(parts[""], middles, voted, odd).withColumn(
        "satisfaction_rate", numeric.rate_pct(F.col("likes"), F.col("likes") + F.col("dislikes")))


def engagement_summary(turns: DataFrame, votes: DataFrame) -> DataFrame:
    """Totals of the file report; turns must already be analysable."""
    facts = [
        F.count(F.lit(1)).alias("total_chat_turns"),
        F.count_if("empty_response").alias("empty_responses"),
        F.count_if("had_error").alias("had_errors"),
        numeric.exact_mean(F.col("latency_ms")).alias("avg_latency_ms"),
        numeric.exact_mean(F.col("chunk_similarity_avg")).alias("avg_chunk_similarity"),
        numeric.exact_mean(F.col("response_chars")).alias("avg_response_chars"),
        F.coalesce(numeric.exact_sum(F.col("cost_usd")), F.lit(0.0)).alias("total_cost_usd"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")]
    parts = grains(turns, facts, {"session": F.col("session_id")})
    voted = votes.agg(F.count(F.lit(1)).alias("total_vote_events"))
    parts["size"] = _sizes(parts["session"])
    wide = _beside(parts[""], _session_sizes_stats(parts["session"]), _quantiles(
        parts, {"size": [Quantile("median_turns_per_session", 1, 2)]}), voted)
    per_session = F.col("__turns") / F.when(F.col("total_sessions") > 0, F.col("total_sessions"))
    return wide.select(
        "total_chat_turns", "total_sessions",
        F.coalesce(per_session, F.lit(0.0)).alias("avg_turns_per_session"),
        F.coalesce("median_turns_per_session", F.lit(0.0)).alias("median_turns_per_session"),
        "one_turn_sessions",
        numeric.rate_pct(F.col("one_turn_sessions"), F.col("total_sessions"))
        .alias("pct_one_turn_sessions"),
        "total_vote_events", "empty_responses", "had_errors", "avg_latency_ms",
        "avg_chunk_similarity", "avg_response_chars", "total_cost_usd", "first_ts", "last_ts")


def owner_view_compare(turns: DataFrame, votes: DataFrame) -> DataFrame:
    """Seven metrics with no owner filter, the row filter and the session filter.

    Each row is marked with the views it survives and is aggregated once: first per
    (view, session), then per view, so a hot session combines before the shuffle.
    """
    touched = filters.owner_sessions(turns, votes).withColumn("__touched", F.lit(True))

    def views(df: DataFrame) -> DataFrame:
        row_ok = filters.not_owner()
        session_ok = row_ok & F.col("__touched").isNull()
        listed = F.filter(F.array(F.lit("none"), F.when(row_ok, "row"),
                                  F.when(session_ok, "session")), lambda v: v.isNotNull())
        return (df.join(touched, "session_id", "left")
                .withColumn("view", F.explode(listed)))

    chat = (views(turns.withColumn("__chat", F.lit(1)))
            .select("view", "session_id", "latency_ms", "chunk_similarity_avg", "cost_usd",
                    F.lit(True).alias("chat")))
    voted = views(votes).select("view", "session_id", F.lit(False).alias("chat"))
    both = chat.unionByName(voted, allowMissingColumns=True)
    dec = lambda c: F.col(c).cast("decimal(20,6)")
    per_session = both.groupBy("view", "session_id").agg(
        F.count_if("chat").alias("turns"), F.count_if(~F.col("chat")).alias("votes"),
        F.sum(dec("latency_ms")).alias("lat"), F.count("latency_ms").alias("n_lat"),
        F.sum(dec("chunk_similarity_avg")).alias("sim"),
        F.count("chunk_similarity_avg").alias("n_sim"),
        F.sum(dec("cost_usd")).alias("cost"))
    named = F.when((F.trim("session_id") != "") & (F.col("turns") > 0), F.col("turns"))
    ratio = lambda n, d: F.sum(n).cast("double") / F.when(F.sum(d) > 0, F.sum(d))
    return per_session.groupBy("view").agg(
        F.sum("turns").alias("chat_turns"),
        F.count(named).alias("sessions"),
        F.sum("votes").alias("votes"),
        F.coalesce(F.sum(named) / F.when(F.count(named) > 0, F.count(named)), F.lit(0.0))
        .alias("avg_turns_per_session"),
        ratio("lat", "n_lat").alias("avg_latency_ms"),
        ratio("sim", "n_sim").alias("avg_chunk_similarity"),
        F.coalesce(F.sum("cost").cast("double"), F.lit(0.0)).alias("total_cost_usd"))


def reliability_counts(turns: DataFrame, malformed: DataFrame) -> DataFrame:
    """Error, empty, zero-retrieval and tool rows, empty-turn artifacts, bad lines."""
    facts = turns.agg(
        F.count_if("had_error").alias("had_error_rows"),
        F.count_if("empty_response").alias("empty_response_rows"),
        F.count_if(F.coalesce("n_chunks_retrieved", F.lit(0)) == 0).alias("zero_retrieval_rows"),
        F.count_if("tool_called").alias("tool_called_rows"))
    odd = malformed.agg(
        F.count_if(F.col("reason") == "missing_ts_or_empty_message")
        .alias("empty_turn_artifacts"),
        F.count_if(F.col("reason") == "json_decode_error").alias("malformed_json_rows"))
    return _beside(facts, odd)


def retrieval_health(turns: DataFrame) -> DataFrame:
    """Retrieval means; a missing similarity counts as 0 only for the last counter."""
    facts = [
        numeric.exact_mean(F.col("n_chunks_retrieved")).alias("avg_chunks_retrieved"),
        numeric.exact_mean(F.col("chunk_similarity_avg")).alias("avg_similarity"),
        F.max("chunk_similarity_max").alias("max_similarity"),
        F.count_if(F.coalesce("n_chunks_retrieved", F.lit(0)) == 0).alias("zero_retrieval_rows"),
        F.count_if(F.coalesce("chunk_similarity_avg", F.lit(0.0)) < 0.10)
        .alias("low_similarity_rows")]
    parts = grains(turns, facts, {"similarity": F.col("chunk_similarity_avg")})
    return _beside(parts[""], _quantiles(parts, {"similarity": [Quantile("median_similarity", 1, 2)]}))


def _grade(rate: Column, high: float, some: float) -> Column:
    return F.when(rate > high, "high").when(rate > some, "moderate").otherwise("ok")


def health_rates(turns: DataFrame) -> DataFrame:
    """Rates over real sessions with their severity; thresholds 20/10, 10/5, 5/0, 60/40."""
    real = turns.where(F.trim(F.coalesce("session_id", F.lit(""))) != "")
    facts = [
        F.count(F.lit(1)).alias("turns_total"),
        F.count_if(F.col("chunk_similarity_avg") < GAP).alias("gaps"),
        F.count_if(F.col("latency_ms") > SLOW).alias("slow"),
        F.count_if("had_error").alias("errors")]
    parts = grains(real, facts, {"session": F.col("session_id")})
    parts["size"] = _sizes(parts["session"])
    wide = _beside(parts[""], _session_sizes_stats(parts["session"]), _quantiles(
        parts, {"size": [Quantile("median_turns", 1, 2)]}))
    n, s = F.col("turns_total"), F.col("total_sessions")
    rated = wide.select(
        numeric.rate_pct(F.col("gaps"), n).alias("gap_rate"),
        numeric.rate_pct(F.col("slow"), n).alias("slow_rate"),
        numeric.rate_pct(F.col("errors"), n).alias("error_rate"),
        numeric.rate_pct(F.col("one_turn_sessions"), s).alias("bounce_rate"), "median_turns")
    return rated.withColumns({
        "gap_severity": _grade(F.col("gap_rate"), 20, 10),
        "slow_severity": _grade(F.col("slow_rate"), 10, 5),
        "error_severity": _grade(F.col("error_rate"), 5, 0),
        "bounce_severity": _grade(F.col("bounce_rate"), 60, 40),
        "good_engagement": F.col("median_turns") >= 3})


def artifact_summary(artifacts: DataFrame) -> DataFrame:
    return artifacts.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_owner_traffic").alias("owner_marked"),
        F.count_if(F.coalesce("ts", F.lit("")) == "").alias("missing_ts"),
        F.count_if(F.coalesce("session_id", F.lit("")) != "").alias("with_session"))


def usage_totals(calls: DataFrame) -> DataFrame:
    """Tokens, cost and calls per session; the cost of the latest instant beside it.

    The latest-query cost needs the maximum ts first; both aggregates key on the
    session and combine before the shuffle.
    """
    keyed = calls.withColumn("session_id", sessions.session_key())
    dec = F.col("cost_usd").cast("decimal(20,6)")
    per_instant = keyed.groupBy("session_id", "ts").agg(
        F.sum(F.coalesce("prompt_tokens", F.lit(0)).cast("bigint")).alias("p"),
        F.sum(F.coalesce("completion_tokens", F.lit(0)).cast("bigint")).alias("c"),
        F.sum(dec).alias("cost"), F.count(F.lit(1)).alias("n"))
    return per_instant.groupBy("session_id").agg(
        F.sum("p").alias("total_prompt_tokens"),
        F.sum("c").alias("total_completion_tokens"),
        (F.sum("p") + F.sum("c")).alias("total_tokens"),
        F.coalesce(F.sum("cost").cast("double"), F.lit(0.0)).alias("total_cost_usd"),
        F.sum("n").alias("total_calls"),
        F.coalesce(F.max_by("cost", "ts").cast("double"), F.lit(0.0)).alias("last_query_cost"))


def embedding_cost(tokens: Column) -> Column:
    return F.coalesce(tokens, F.lit(0)) * F.lit(numeric.EMBEDDING_USD_PER_TOKEN)
