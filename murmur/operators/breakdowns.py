"""Grouped views of the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions import numeric

UNKNOWN = "unknown"


def _means() -> list[Column]:
    return [numeric.exact_mean(F.col("chunk_similarity_avg")).alias("avg_similarity"),
            numeric.exact_mean(F.col("latency_ms")).alias("avg_latency_ms")]


def _cost() -> Column:
    return F.coalesce(numeric.exact_sum(F.col("cost_usd")), F.lit(0.0)).alias("total_cost_usd")


def with_share(counts: DataFrame, count: str = "count", name: str = "share_pct") -> DataFrame:
    """Percent of the total over an already grouped (small) table."""
    total = F.sum(count).over(Window.partitionBy(F.lit(0)))
    return counts.withColumn(name, 100.0 * F.col(count) / total)


def workflow_breakdown(turns: DataFrame) -> DataFrame:
    grouped = turns.groupBy(F.coalesce("workflow", F.lit(UNKNOWN)).alias("workflow")).agg(
        F.count(F.lit(1)).alias("count"), *_means(),
        numeric.exact_mean(F.col("response_chars")).alias("avg_response_chars"), _cost())
    return with_share(grouped)


def model_usage(turns: DataFrame) -> DataFrame:
    grouped = turns.groupBy(F.coalesce("model", F.lit(UNKNOWN)).alias("model")).agg(
        F.count(F.lit(1)).alias("count"), *_means(),
        F.count_if("had_error").alias("had_error_rows"),
        F.count_if("empty_response").alias("empty_response_rows"))
    return with_share(grouped)


def _known(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(UNKNOWN)) != UNKNOWN


def model_votes(votes: DataFrame) -> DataFrame:
    """Likes and dislikes per model; a missing or blank model is 'unknown'."""
    model = F.coalesce(F.nullif(F.col("model"), F.lit("")), F.lit(UNKNOWN))
    return votes.groupBy(model.alias("model")).agg(
        F.count_if("liked").alias("likes"), F.count_if(~F.col("liked")).alias("dislikes"))


def model_comparison(turns: DataFrame, votes: DataFrame) -> DataFrame:
    """Quality, cost, latency and satisfaction per known model."""
    grouped = turns.where(_known("model")).groupBy("model").agg(
        F.count(F.lit(1)).alias("queries"), *_means(), _cost())
    rated = F.coalesce(F.col("likes"), F.lit(0)) + F.coalesce(F.col("dislikes"), F.lit(0))
    return (grouped.join(model_votes(votes), "model", "left")
            .withColumn("cost_per_query", F.col("total_cost_usd") / F.col("queries"))
            .withColumn("satisfaction_pct",
                        F.when(rated > 0, 100.0 * F.col("likes") / rated))
            .withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("likes", "dislikes")}))


def provider_comparison(turns: DataFrame) -> DataFrame:
    """Two-step distinct count: (provider, model) first, so one hot provider spreads."""
    dec = lambda c: F.col(c).cast("decimal(20,6)")
    per_model = turns.where(_known("provider")).groupBy("provider", "model").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(dec("chunk_similarity_avg")).alias("sim"),
        F.count("chunk_similarity_avg").alias("n_sim"),
        F.sum(dec("latency_ms")).alias("lat"), F.count("latency_ms").alias("n_lat"),
        F.sum(dec("cost_usd")).alias("cost"))
    ratio = lambda a, b: F.sum(a).cast("double") / F.when(F.sum(b) > 0, F.sum(b))
    return per_model.groupBy("provider").agg(
        F.count(F.lit(1)).alias("models"), F.sum("n").alias("queries"),
        ratio("sim", "n_sim").alias("avg_similarity"),
        F.coalesce(F.sum("cost").cast("double"), F.lit(0.0)).alias("total_cost_usd"),
        ratio("lat", "n_lat").alias("avg_latency_ms"))


def cost_analysis(turns: DataFrame) -> DataFrame:
    """Per model over turns that cost something."""
    return (turns.where(_known("model") & (F.col("cost_usd") > 0)).groupBy("model")
            .agg(F.count(F.lit(1)).alias("queries"),
                 numeric.exact_mean(F.col("chunk_similarity_avg")).alias("avg_similarity"),
                 _cost())
            .withColumn("cost_per_query", F.col("total_cost_usd") / F.col("queries")))


def cost_projection(turns: DataFrame, monthly_queries: int) -> DataFrame:
    per_query = numeric.exact_mean(F.col("cost_usd"))
    return turns.groupBy("model").agg(
        per_query.alias("cost_per_query"),
        (per_query * F.lit(monthly_queries)).alias("projected_monthly_usd"))


def config_by_temperature(turns: DataFrame) -> DataFrame:
    bucket = F.bround(F.col("temperature") * 10) / 10
    return turns.where(F.col("temperature") > 0).groupBy(bucket.alias("temperature")).agg(
        F.count(F.lit(1)).alias("queries"), *_means())


def config_by_topk(turns: DataFrame) -> DataFrame:
    return turns.where(F.col("n_chunks_config") > 0).groupBy(
        F.col("n_chunks_config").alias("top_k")).agg(
        F.count(F.lit(1)).alias("queries"), *_means())


def tool_usage(turns: DataFrame) -> DataFrame:
    """Calls per tool and their share of all turns, from one pass over the log."""
    per_tool = turns.groupBy(F.when(F.col("tool_called"), F.col("tool_name")).alias("tool_name"),
                             F.coalesce("tool_called", F.lit(False)).alias("called")).agg(
        F.count(F.lit(1)).alias("calls"),
        numeric.exact_mean(F.col("chunk_similarity_avg")).alias("avg_similarity"))
    return (with_share(per_tool, "calls", "pct_of_queries")
            .where("called").drop("called"))


def vote_summary(votes: DataFrame) -> DataFrame:
    return votes.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("liked").alias("likes"),
        F.count_if(~F.col("liked")).alias("dislikes"),
        F.count_if(F.col("liked").isNull()).alias("other")).withColumn(
        "satisfaction_pct",
        numeric.rate_pct(F.col("likes"), F.col("likes") + F.col("dislikes")))


def vote_analysis(votes: DataFrame) -> DataFrame:
    """Overall (model null) and per-model satisfaction in one rollup pass."""
    model = F.coalesce(F.nullif(F.col("model"), F.lit("")), F.lit(UNKNOWN))
    out = votes.withColumn("model", model).rollup("model").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("liked").alias("likes"),
        F.count_if(~F.col("liked")).alias("dislikes"),
        F.count_if(F.col("liked").isNull()).alias("other"))
    return out.withColumn("satisfaction_pct", numeric.rate_pct(
        F.col("likes"), F.col("likes") + F.col("dislikes")))


def category_counters(turns: DataFrame,
                      dims: tuple[str, ...] = ("workflow", "provider", "model",
                                               "audience_tier")) -> DataFrame:
    """Counts per value for several dimensions, all in one grouped pass."""
    entries = F.array(*[F.struct(
        F.lit(d).alias("dimension"),
        F.coalesce(F.nullif(F.col(d), F.lit("")), F.lit(UNKNOWN)).alias("value")) for d in dims])
    return (turns.select(F.explode(entries).alias("e"))
            .groupBy("e.dimension", "e.value").agg(F.count(F.lit(1)).alias("count")))


def daily_turns(turns: DataFrame) -> DataFrame:
    return turns.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("turns"))


def daily_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy(F.to_date("session_start").alias("day")).agg(
        F.count(F.lit(1)).alias("sessions"))


def session_depth_hist(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("turns").agg(F.count(F.lit(1)).alias("sessions"))


def daily_rollup(turns: DataFrame, votes: DataFrame, zone: str = "America/Chicago") -> DataFrame:
    """Sessions by start day, turns and votes by their own day: one union, one grouping."""
    local = lambda c: F.to_date(F.from_utc_timestamp(c, zone))
    per_session = turns.groupBy("session_id").agg(
        F.min("ts").alias("ts"), F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    one = F.lit(1).cast("bigint")

    def part(df: DataFrame, **cols: Column) -> DataFrame:
        names = ("s", "s_turns", "one_turn", "t", "v")
        return df.select(local("ts").alias("day"), *[cols.get(n, zero).alias(n) for n in names])

    tagged = (part(per_session, s=one, s_turns=F.col("n"),
                   one_turn=(F.col("n") == 1).cast("bigint"))
              .unionByName(part(turns, t=one))
              .unionByName(part(votes.where(F.col("ts").isNotNull()), v=one)))
    out = tagged.groupBy("day").agg(
        F.sum("s").alias("sessions"), F.sum("t").alias("turns"),
        F.sum("one_turn").alias("one_turn_sessions"),
        F.sum("s_turns").alias("__st"), F.sum("v").alias("votes"))
    return out.select(
        "day", "sessions", "turns", "one_turn_sessions",
        F.coalesce(F.col("__st") / F.when(F.col("sessions") > 0, F.col("sessions")), F.lit(0.0))
        .alias("avg_turns_per_session"), "votes")
