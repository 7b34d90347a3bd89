"""Scoring and comparing evaluation runs.

``results`` follows ``schemas.EVAL_RESULT``; a row with ``error`` set failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions import numeric, text
from murmur.scale import Quantile, exact_quantiles

# Limits, compared fields and review columns.
SHORT_ANSWER_WORDS = 30
ARROW_MIN_DELTA = 0.005
SIM_DROP = 0.05
SUCCESS_DROP_PCT = 10.0
COMPARED_STATS = [
    "response_length_words", "chunk_similarity_avg", "chunk_similarity_max", "markdown_used",
    "followup_present", "links_used", "total_tokens", "cost_usd",
]
REVIEW_FILLED = [
    "run_id", "question_id", "legacy_category", "question_type", "intent", "audience_mode",
    "difficulty", "priority", "question", "must_cover", "nice_to_have", "should_not_do",
    "preferred_structure", "preferred_followup_behavior", "acceptable_projects_or_examples",
    "grounding_expectation", "response", "response_length_words", "markdown_used", "links_used",
    "followup_present", "specific_projects_mentioned", "chunk_similarity_avg",
    "chunk_similarity_max",
]
REVIEW_BLANK = [
    "accuracy_score", "specificity_score", "voice_fidelity_score", "narrative_arc_score",
    "followup_magnetism_score", "presentation_scanability_score", "relevance_score",
    "retrieval_alignment_score", "overall_score", "strengths_tags", "weakness_tags",
    "failure_mode_tags", "issue_source", "suggested_fix", "fix_priority", "retest_needed",
    "evaluator_notes",
]
VOICE_REGISTERS = ["explaining", "storytelling", "reflective", "wry", "direct", "technical-peer"]
# end of fixed values

OK = "error IS NULL"


def result_features(results: DataFrame, project_names: list[str]) -> DataFrame:
    """Answer features; failed rows stay, with empty features."""
    ok = F.col("error").isNull()
    sims = F.filter(F.transform("retrieved_chunks", lambda c: c["similarity"]),
                    lambda s: s.isNotNull())
    any_sim = F.size(sims) > 0
    mean = F.aggregate(sims, F.lit(0.0), lambda a, s: a + s) / F.size(sims)
    body = F.coalesce("response", F.lit(""))
    return results.withColumns({
        "context_found": F.when(ok, F.size("retrieved_chunks") > 0),
        "chunk_similarity_avg": F.when(ok & any_sim, F.bround(mean, 3)),
        "chunk_similarity_max": F.when(ok & any_sim, F.bround(F.array_max(sims), 3)),
        "response_length_words": F.when(ok, text.word_count(body).cast("bigint")),
        "markdown_used": F.when(ok, text.markdown_level(body)),
        "links_used": F.when(ok, text.has_link(body)),
        "followup_present": F.when(ok, text.has_followup(body)),
        "specific_projects_mentioned": F.when(ok, text.matching_terms(body, project_names))})


def _category() -> Column:
    return F.coalesce(F.nullif(F.col("legacy_category"), F.lit("")),
                      F.nullif(F.col("category"), F.lit("")), F.lit("unknown"))


def _question_type() -> Column:
    return F.coalesce(F.nullif(F.col("question_type"), F.lit("")), F.lit("unknown"))


def _words() -> Column:
    by_space = F.size(F.filter(F.split(text.squash(F.coalesce("response", F.lit(""))), " "),
                               lambda w: w != ""))
    return F.coalesce(F.col("response_length_words"), by_space.cast("bigint"))


def overall(results: DataFrame) -> DataFrame:
    ok = F.col("error").isNull()
    return results.agg(
        F.count(F.lit(1)).alias("total_questions"),
        F.count_if(ok).alias("successful"), F.count_if(~ok).alias("errors"),
        numeric.exact_mean(F.when(ok, _words())).alias("avg_response_words"),
        numeric.exact_mean(F.when(ok, F.col("chunk_similarity_avg"))).alias("avg_similarity"))


def by_group(results: DataFrame) -> DataFrame:
    """Totals per category, per question type and overall from one grouping-sets pass.

    ``level`` tells the three apart.
    """
    ok = F.col("error").isNull()
    base = results.select(_category().alias("category"), _question_type().alias("question_type"),
                          ok.alias("ok"))
    out = base.groupingSets([["category"], ["question_type"], []], "category", "question_type").agg(
        F.grouping("category").alias("gc"), F.grouping("question_type").alias("gt"),
        F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("successful"),
        F.count_if(~F.col("ok")).alias("errors"))
    level = (F.when(F.col("gc") == 0, "category").when(F.col("gt") == 0, "question_type")
             .otherwise("all"))
    return out.select(level.alias("level"), F.coalesce("category", "question_type").alias("value"),
                      "total", "successful", "errors",
                      numeric.rate_pct(F.col("successful"), F.col("total")).alias("success_pct"))


def by_category(results: DataFrame) -> DataFrame:
    return by_group(results).where(F.col("level") == "category").drop("level")


def by_question_type(results: DataFrame) -> DataFrame:
    return by_group(results).where(F.col("level") == "question_type").drop("level")


def retrieval_hist(results: DataFrame) -> DataFrame:
    n = F.greatest(F.size(F.coalesce("retrieved_chunks", F.array().cast(
        results.schema["retrieved_chunks"].dataType))), F.lit(0))
    good = results.where(OK)
    return good.agg(F.count_if(n == 0).alias("no_context"), F.count_if(n == 1).alias("one_chunk"),
                    F.count_if(n == 2).alias("two_chunks"),
                    F.count_if(n >= 3).alias("three_or_more_chunks"))


def feature_counts(results: DataFrame) -> DataFrame:
    md = F.coalesce("markdown_used", F.lit("none"))
    return results.where(OK).agg(
        F.count_if("followup_present").alias("with_followup"),
        F.count_if("links_used").alias("with_links"),
        F.count_if(~md.isin("strong", "light")).alias("markdown_none"),
        F.count_if(md == "light").alias("markdown_light"),
        F.count_if(md == "strong").alias("markdown_strong"))


def project_counts(results: DataFrame, n: int | None = 8) -> DataFrame:
    counted = (results.where(OK).select(F.explode("specific_projects_mentioned").alias("project"))
               .groupBy("project").agg(F.count(F.lit(1)).alias("mentions")))
    return counted.orderBy(F.col("mentions").desc(), "project").limit(n) if n else counted


def issue_counts(results: DataFrame) -> DataFrame:
    return (results.where(F.expr(OK) & (F.coalesce("issue_source", F.lit("")) != ""))
            .groupBy("issue_source").agg(F.count(F.lit(1)).alias("count")))


def flagged_for_review(results: DataFrame) -> DataFrame:
    """One row per reason: failed, no context, very short answer. Reasons from one scan."""
    ok = F.col("error").isNull()
    none = F.size(F.coalesce("retrieved_chunks", F.array().cast(
        results.schema["retrieved_chunks"].dataType))) <= 0
    start = F.substring(F.coalesce("response", F.lit("")), 1, 120)
    reasons = F.filter(F.array(
        F.when(~ok, F.struct(F.concat(F.lit("Error: "), F.col("error")).alias("reason"),
                             F.lit("").alias("response"))),
        F.when(ok & none, F.struct(F.lit("No context retrieved").alias("reason"),
                                   start.alias("response"))),
        F.when(ok & (_words() < SHORT_ANSWER_WORDS), F.struct(
            F.concat(F.lit("Very short response ("), _words(), F.lit(" words)")).alias("reason"),
            start.alias("response")))), lambda r: r.isNotNull())
    return results.select("question_id", _category().alias("category"),
                          F.explode(reasons).alias("r")).select("question_id", "category", "r.*")


def review_export(results: DataFrame) -> DataFrame:
    """Review sheet: answered rows, filled columns as text, reviewer columns blank."""
    cols = set(results.columns)
    fallback = {"legacy_category": ["legacy_category", "category"],
                "must_cover": ["must_cover", "expected_info"],
                "nice_to_have": ["nice_to_have", "notes"]}

    def cell(name: str) -> Column:
        if name == "specific_projects_mentioned":
            return F.array_join(F.coalesce(name, F.array().cast("array<string>")), " | ")
        sources = [c for c in fallback.get(name, [name]) if c in cols]
        return F.coalesce(*[F.col(c).cast("string") for c in sources], F.lit(""))

    return results.where(OK).select(*[cell(c).alias(c) for c in REVIEW_FILLED],
                                    *[F.lit("").alias(c) for c in REVIEW_BLANK])


# --- rank, latency and coverage metrics ---------------------------------------

def rank_metrics(ranks: DataFrame, rank: str = "rank") -> DataFrame:
    """Top-1 and top-3 percent and mean reciprocal rank; rank 0 means not found."""
    r = F.col(rank)
    n = F.count(F.lit(1))
    return ranks.agg(
        n.alias("queries"), numeric.rate_pct(F.count_if(r == 1), n).alias("top1_pct"),
        numeric.rate_pct(F.count_if((r >= 1) & (r <= 3)), n).alias("top3_pct"),
        (F.coalesce(numeric.exact_sum(F.when(r > 0, 1.0 / r), 9), F.lit(0.0)) / n).alias("mrr"))


def answer_ranks(hits: DataFrame, queries: DataFrame, relevant: Column) -> DataFrame:
    """Rank of the first relevant hit per query, 0 when there is none."""
    first = hits.where(relevant).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return queries.select("query_id").join(first, "query_id", "left").select(
        "query_id", F.coalesce("rank", F.lit(0)).alias("rank"))


def latency_percentiles(latencies: DataFrame, value: str = "latency_ms",
                        keys: tuple[str, ...] = ("backend",)) -> DataFrame:
    """p50, p95, p99 (linear), the middle element and the mean."""
    exact = exact_quantiles(latencies, value, [
        Quantile("p50", 50, 100), Quantile("p95", 95, 100), Quantile("p99", 99, 100),
        Quantile("middle", 1, 2, "upper")], keys)
    means = latencies.groupBy(*keys).agg(numeric.exact_mean(F.col(value)).alias("mean"))
    return exact.drop("n").join(means, list(keys))


def coverage_hits(texts: DataFrame, expected: DataFrame) -> DataFrame:
    """(query, backend, term, found): is the expected term in the text, ignoring case?"""
    low = texts.select("query_id", "backend", F.lower("text").alias("__low"))
    return low.join(expected.select("query_id", "term").distinct(), "query_id").select(
        "query_id", "backend", "term", F.contains("__low", F.lower("term")).alias("found"))


def coverage(texts: DataFrame, expected: DataFrame) -> DataFrame:
    """Share of expected terms found per query and backend; 1 when none are expected."""
    hits = coverage_hits(texts, expected).groupBy("query_id", "backend").agg(
        F.count_if("found").alias("n_found"), F.count(F.lit(1)).alias("n_expected"))
    return texts.select("query_id", "backend").join(hits, ["query_id", "backend"], "left").select(
        "query_id", "backend", F.coalesce("n_found", F.lit(0)).alias("n_found"),
        F.coalesce("n_expected", F.lit(0)).alias("n_expected"),
        F.coalesce(F.col("n_found") / F.col("n_expected"), F.lit(1.0)).alias("coverage"))


def coverage_by_backend(per_query: DataFrame, left: str, right: str) -> DataFrame:
    """Mean coverage of two backends and their difference."""
    mean = lambda b: numeric.exact_mean(F.when(F.col("backend") == b, F.col("coverage")), 9)
    return per_query.agg(mean(left).alias(f"{left}_coverage"),
                         mean(right).alias(f"{right}_coverage")).withColumn(
        "delta", F.col(f"{right}_coverage") - F.col(f"{left}_coverage"))


def found_difference(hits: DataFrame, left: str, right: str) -> DataFrame:
    """Expected terms only one of two backends found."""
    by_term = hits.groupBy("query_id", "term").agg(
        F.coalesce(F.bool_or(F.when(F.col("backend") == left, F.col("found"))), F.lit(False)).alias("l"),
        F.coalesce(F.bool_or(F.when(F.col("backend") == right, F.col("found"))), F.lit(False)).alias("r"))
    return by_term.where(F.col("l") != F.col("r")).select(
        "query_id", "term", F.when(F.col("l"), left).otherwise(right).alias("only_in"))


def relationship_status(per_query: DataFrame) -> DataFrame:
    """success: two or more found, or the single expected one; partial: one; else failure."""
    found, wanted = F.col("n_found"), F.col("n_expected")
    status = (F.when((found >= 2) | ((wanted == 1) & (found == 1)), "success")
              .when(found == 1, "partial").otherwise("failure"))
    return per_query.withColumn("status", status)


def relationship_rate(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("backend").agg(
        F.count(F.lit(1)).alias("queries"),
        F.count_if(F.col("status") == "success").alias("successes")).withColumn(
        "success_pct", numeric.rate_pct(F.col("successes"), F.col("queries")))


def coherence_mean(scores: DataFrame, score: str = "score") -> DataFrame:
    return scores.agg(F.count(score).alias("scored"),
                      numeric.exact_mean(F.col(score)).alias("avg_coherence"))


def regression(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Per category: similarity drop, more short answers, success drop against a baseline."""
    def facts(df: DataFrame, prefix: str) -> DataFrame:
        ok = F.col("error").isNull()
        return df.groupBy(_category().alias("category")).agg(
            numeric.exact_mean(F.when(ok, F.col("chunk_similarity_avg"))).alias(f"{prefix}_sim"),
            F.count_if(ok & (_words() < SHORT_ANSWER_WORDS)).alias(f"{prefix}_short"),
            numeric.rate_pct(F.count_if(ok), F.count(F.lit(1))).alias(f"{prefix}_success"))
    both = facts(baseline, "base").join(facts(current, "new"), "category", "full_outer")
    return both.withColumns({
        "similarity_dropped": F.col("base_sim") - F.col("new_sim") > SIM_DROP,
        "more_short_answers": F.coalesce("new_short", F.lit(0)) > F.coalesce("base_short", F.lit(0)),
        "success_dropped": F.col("base_success") - F.col("new_success") > SUCCESS_DROP_PCT})


def verdict_means(verdicts: DataFrame) -> DataFrame:
    """Mean judge scores; failed verdicts are skipped, a missing score counts as 0."""
    score = lambda c: numeric.exact_mean(F.coalesce(F.col(c), F.lit(0))).alias(c)
    return verdicts.where(OK).agg(F.count(F.lit(1)).alias("scored"), score("voice_fidelity"),
                                  score("reasoning_fidelity"), score("overall"))


def tic_frequency(verdicts: DataFrame) -> DataFrame:
    return (verdicts.where(OK).select(F.explode("tics").alias("tic"))
            .groupBy("tic").agg(F.count(F.lit(1)).alias("answers")))


def register_coverage(samples: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Which voice registers the corpus covers; unlisted ones are marked extra."""
    wanted = wanted or VOICE_REGISTERS
    have = samples.groupBy("register").agg(F.count(F.lit(1)).alias("samples"))
    listed = have.sparkSession.createDataFrame([(w,) for w in wanted], "register string").withColumn(
        "wanted", F.lit(True))
    return have.join(listed, "register", "full_outer").select(
        "register", F.coalesce("wanted", F.lit(False)).alias("wanted"),
        F.coalesce("samples", F.lit(0)).alias("samples"))


# --- run against run ---------------------------------------------------------

def question_key() -> Column:
    return F.coalesce(F.nullif(F.col("question_id"), F.lit("")),
                      F.substring(F.coalesce("question", F.lit("")), 1, 80))


def keyed_results(results: DataFrame, pos: str = "pos") -> DataFrame:
    """One row per question key; of a repeated key the last row counts."""
    columns = [c for c in results.columns]
    return (results.groupBy(question_key().alias("key"))
            .agg(F.max_by(F.struct(*columns), pos).alias("r")).select("key", "r.*"))


def run_compare(run_a: DataFrame, run_b: DataFrame) -> DataFrame:
    """Per question: both similarities, their difference and its direction."""
    pick = lambda df, s: keyed_results(df.select(
        "question_id", "question", "question_type", "chunk_similarity_avg", "pos")).select(
        "key", F.nullif(F.col("question_type"), F.lit("")).alias(f"type_{s}"),
        F.col("chunk_similarity_avg").alias(f"sim_{s}"), F.lit(True).alias(f"in_{s}"))
    delta = F.col("sim_b") - F.col("sim_a")
    arrow = F.when(F.abs(delta) >= ARROW_MIN_DELTA, F.when(delta > 0, "▴").otherwise("▾"))
    out = pick(run_a, "a").join(pick(run_b, "b"), "key", "full_outer")
    return out.select("key", F.coalesce("type_a", "type_b", F.lit("")).alias("question_type"),
                      "sim_a", "sim_b", delta.alias("delta"), arrow.alias("arrow"),
                      F.coalesce("in_a", F.lit(False)).alias("in_a"),
                      F.coalesce("in_b", F.lit(False)).alias("in_b"))


def _long(df: DataFrame, keys: list[str], fields: list[str], value: str) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(value))
                        for f in fields])
    return df.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*")


def run_meta_diff(meta_a: DataFrame, meta_b: DataFrame, fields: list[str]) -> DataFrame:
    """Metadata fields of two runs side by side as text, and whether they differ."""
    both = _long(meta_a, [], fields, "value_a").join(_long(meta_b, [], fields, "value_b"), "field")
    text_of = lambda c: F.coalesce(c, F.lit(""))
    return both.withColumn("differs", text_of("value_a") != text_of("value_b"))


def run_stat_diff(run_a: DataFrame, run_b: DataFrame) -> DataFrame:
    """Per question of run A and shown stat: does run B differ?"""
    def stats(df: DataFrame, value: str) -> DataFrame:
        keyed = keyed_results(df.select("question_id", "question", "pos", "retrieved_chunks",
                                        *COMPARED_STATS))
        sized = keyed.withColumn("chunks", F.greatest(
            F.coalesce(F.size("retrieved_chunks"), F.lit(0)), F.lit(0)))
        return _long(sized, ["key"], [*COMPARED_STATS, "chunks"], value)
    shown = stats(run_a, "value_a").where(F.col("value_a").isNotNull())
    both = shown.join(stats(run_b, "value_b"), ["key", "field"], "left")
    return both.withColumn("differs", F.col("value_b").isNotNull()
                           & (F.col("value_a") != F.coalesce("value_b", F.lit(""))))


def run_chunk_only(run_a: DataFrame, run_b: DataFrame) -> DataFrame:
    """Chunks by (source, index) that only one of the two runs retrieved."""
    chunks = lambda df: keyed_results(df.select(
        "question_id", "question", "pos", "retrieved_chunks")).select(
        "key", F.explode("retrieved_chunks").alias("c")).select(
        "key", F.coalesce("c.source", F.lit("")).alias("source"),
        F.coalesce("c.chunk_index", F.lit(-1)).alias("chunk_index")).distinct()
    a, b = chunks(run_a), chunks(run_b)
    on = ["key", "source", "chunk_index"]
    return (a.join(b, on, "left_anti").withColumn("only_in", F.lit("a"))
            .unionByName(b.join(a, on, "left_anti").withColumn("only_in", F.lit("b"))))
