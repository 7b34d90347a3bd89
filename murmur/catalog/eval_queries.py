"""Registered evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur import schemas
from murmur.catalog.registry import query
from murmur.catalog.sqlparts import (DOCS, L2_ORDER, LOG, SECTIONS, big, eval_cte, mean, quantile,
                                     rate, topk_cte, with_)
from murmur.catalog.text_queries import FOLLOWUP_SQL, LINK_SQL, MARKDOWN_SQL, W
from murmur.operators import evals, vectors
from murmur.session import scratch_dir
from murmur.sources import files, sinks, tables

A, B = with_(DOCS, eval_cte("a")), with_(DOCS, eval_cte("b"))
AB = with_(DOCS, eval_cte("a"), eval_cte("b"))
NAMES = ["thble", "Nicht", "que"]
NAMES_SQL = "list_filter(['thble', 'Nicht', 'que'], lambda p: contains(lower(response), lower(p)))"
WORDS_SQL = f"CAST(len(regexp_extract_all(response, '{W}+')) AS BIGINT)"


def _res(spark, sf, run="a"):
    return tables.eval_results(spark, sf, run)


def _features(spark, sf, run="a"):
    return evals.result_features(_res(spark, sf, run), NAMES)


@query("eval_result_features", A + f"""
SELECT pos, error, CASE WHEN error IS NULL THEN len(chunks) > 0 END AS context_found,
  CASE WHEN error IS NULL AND len(chunks) > 0 THEN round_even(list_reduce(list_transform(chunks, lambda c: c.similarity), lambda x, y: x + y) / len(chunks), 3) END AS chunk_similarity_avg,
  CASE WHEN error IS NULL AND len(chunks) > 0 THEN list_max(list_transform(chunks, lambda c: c.similarity)) END AS chunk_similarity_max,
  CASE WHEN error IS NULL THEN {WORDS_SQL} END AS response_length_words, CASE WHEN error IS NULL THEN {MARKDOWN_SQL.format(x='response')} END AS markdown_used,
  CASE WHEN error IS NULL THEN {LINK_SQL.format(x='response')} END AS links_used, CASE WHEN error IS NULL THEN {FOLLOWUP_SQL.format(x='response')} END AS followup_present,
  CASE WHEN error IS NULL THEN {NAMES_SQL} END AS specific_projects_mentioned FROM res_a""")
def eval_result_features(spark, sf):
    return _features(spark, sf).select(
        "pos", "error", "context_found", "chunk_similarity_avg", "chunk_similarity_max",
        "response_length_words", "markdown_used", "links_used", "followup_present",
        "specific_projects_mentioned")


SPACE_WORDS = r"CAST(len(list_filter(string_split(trim(regexp_replace(response, '\s+', ' ', 'g')), ' '), lambda w: w <> '')) AS BIGINT)"


@query("eval_overall", A + f"""
SELECT {big('count(*)')} AS total_questions, {big('count_if(error IS NULL)')} AS successful, {big('count_if(error IS NOT NULL)')} AS errors,
  CAST(sum(CASE WHEN error IS NULL THEN {SPACE_WORDS} END) AS DOUBLE) / count_if(error IS NULL) AS avg_response_words,
  CAST(sum(CASE WHEN error IS NULL THEN CAST(sim AS DECIMAL(20,6)) END) AS DOUBLE) / count_if(error IS NULL) AS avg_similarity FROM res_a""")
def eval_overall(spark, sf):
    return evals.overall(_res(spark, sf))


GROUP_COLS = f"""{big('count(*)')} AS total, {big('count_if(error IS NULL)')} AS successful, {big('count_if(error IS NOT NULL)')} AS errors,
  {rate('count_if(error IS NULL)', 'count(*)')} AS success_pct"""


@query("eval_by_category", A + f"SELECT legacy_category AS value, {GROUP_COLS} FROM res_a GROUP BY 1")
def eval_by_category(spark, sf):
    return evals.by_category(_res(spark, sf))


@query("eval_by_question_type", A + f"SELECT question_type AS value, {GROUP_COLS} FROM res_a GROUP BY 1")
def eval_by_question_type(spark, sf):
    return evals.by_question_type(_res(spark, sf))


@query("eval_by_group", A + f"""
SELECT CASE WHEN grouping(legacy_category) = 0 THEN 'category' WHEN grouping(question_type) = 0 THEN 'question_type' ELSE 'all' END AS level,
  coalesce(legacy_category, question_type) AS value, {GROUP_COLS} FROM res_a GROUP BY GROUPING SETS ((legacy_category), (question_type), ())""")
def eval_by_group(spark, sf):
    return evals.by_group(_res(spark, sf))


@query("eval_retrieval_hist", A + f"""
SELECT {big('count_if(len(chunks) = 0)')} AS no_context, {big('count_if(len(chunks) = 1)')} AS one_chunk,
  {big('count_if(len(chunks) = 2)')} AS two_chunks, {big('count_if(len(chunks) >= 3)')} AS three_or_more_chunks FROM res_a WHERE error IS NULL""")
def eval_retrieval_hist(spark, sf):
    return evals.retrieval_hist(_res(spark, sf))


@query("eval_feature_counts", B + f"""
SELECT {big('count_if(' + FOLLOWUP_SQL.format(x='response') + ')')} AS with_followup, {big('count_if(' + LINK_SQL.format(x='response') + ')')} AS with_links,
  {big("count_if(md = 'none')")} AS markdown_none, {big("count_if(md = 'light')")} AS markdown_light, {big("count_if(md = 'strong')")} AS markdown_strong
FROM (SELECT *, {MARKDOWN_SQL.format(x='response')} AS md FROM res_b WHERE error IS NULL)""")
def eval_feature_counts(spark, sf):
    return evals.feature_counts(_features(spark, sf, "b"))


@query("eval_project_counts", A + f"""
SELECT project, {big('count(*)')} AS mentions FROM (SELECT unnest({NAMES_SQL}) AS project FROM res_a WHERE error IS NULL) GROUP BY 1
ORDER BY mentions DESC, project LIMIT 8""")
def eval_project_counts(spark, sf):
    return evals.project_counts(_features(spark, sf))


@query("eval_issue_counts", A + f"""
SELECT issue_source, {big('count(*)')} AS count FROM res_a WHERE error IS NULL AND issue_source IS NOT NULL GROUP BY 1""")
def eval_issue_counts(spark, sf):
    return evals.issue_counts(_res(spark, sf))


@query("flagged_for_review", B + f"""
SELECT question_id, legacy_category AS category, concat('Error: ', error) AS reason, '' AS response FROM res_b WHERE error IS NOT NULL
UNION ALL SELECT question_id, legacy_category, 'No context retrieved', substr(response, 1, 120) FROM res_b WHERE error IS NULL AND len(chunks) = 0
UNION ALL SELECT question_id, legacy_category, concat('Very short response (', w, ' words)'), substr(response, 1, 120)
FROM (SELECT *, {SPACE_WORDS} AS w FROM res_b WHERE error IS NULL) WHERE w < 30""")
def flagged_for_review(spark, sf):
    return evals.flagged_for_review(_res(spark, sf, "b"))


@query("review_export", A + f"""
SELECT question_id, legacy_category, question, response, CAST({WORDS_SQL} AS VARCHAR) AS response_length_words,
  array_to_string({NAMES_SQL}, ' | ') AS specific_projects_mentioned, 'facts' AS must_cover FROM res_a WHERE error IS NULL""")
def review_export(spark, sf):
    sheet = evals.review_export(_features(spark, sf))
    path = scratch_dir(spark, "review")
    sinks.write_csv(sheet, path)
    back = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
            .csv(path).fillna(""))
    return back.select("question_id", "legacy_category", "question", "response",
                       "response_length_words", "specific_projects_mentioned", "must_cover")


# --- metrics ---------------------------------------------------------------

@query("eval_rank_metrics", with_(DOCS, SECTIONS, topk_cte("top", L2_ORDER, 20, "tr <= qr"), """
fr AS (SELECT q.query_id, coalesce(min(rank) FILTER (WHERE label = q.label2), 0) AS rank FROM (SELECT query_id, qlabel AS label2 FROM q) q
  LEFT JOIN top USING (query_id) GROUP BY 1)""") + f"""
SELECT {big('count(*)')} AS queries, {rate('count_if(rank = 1)', 'count(*)')} AS top1_pct, {rate('count_if(rank BETWEEN 1 AND 3)', 'count(*)')} AS top3_pct,
  CAST(sum(CASE WHEN rank > 0 THEN CAST(1.0::DOUBLE / rank AS DECIMAL(20,9)) END) AS DOUBLE) / count(*) AS mrr FROM fr""")
def eval_rank_metrics(spark, sf):
    sections, queries = tables.sections(spark, sf), tables.query_vectors(spark, sf)
    hits = (vectors.vector_topk(sections, queries.withColumn("k", F.lit(20)))
            .join(sections.select("section_id", "label"), "section_id")
            .join(queries.select("query_id", F.col("label").alias("wanted")), "query_id"))
    return evals.rank_metrics(evals.answer_ranks(hits, queries, F.col("label") == F.col("wanted")))


@query("eval_latency_percentiles", with_(LOG, *[f"b{i} AS (SELECT * FROM chats WHERE workflow = '{w}')" for i, w in
                                                enumerate(["standard", "walkthrough", "diagram_only"])])
       + " UNION ALL ".join(f"""SELECT '{w}' AS backend, {quantile(f'b{i}', 'latency_ms', 50, 100)} AS p50, {quantile(f'b{i}', 'latency_ms', 95, 100)} AS p95,
  {quantile(f'b{i}', 'latency_ms', 99, 100)} AS p99, {quantile(f'b{i}', 'latency_ms', 1, 2, 'upper')} AS middle, {mean('latency_ms')} AS mean FROM b{i}"""
                            for i, w in enumerate(["standard", "walkthrough", "diagram_only"])))
def eval_latency_percentiles(spark, sf):
    return evals.latency_percentiles(tables.chat_log(spark, sf).select(
        F.col("workflow").alias("backend"), "latency_ms"))


COVER = """
texts AS (SELECT d.doc_id AS query_id, 'vector' AS backend, d.text FROM docs d JOIN benchmark b ON b.item_id = d.doc_id
  UNION ALL SELECT d.doc_id, 'hybrid', concat(d.text, ' ', b.text) FROM docs d JOIN benchmark b ON b.item_id = d.doc_id WHERE d.lang = 'en'
  UNION ALL SELECT d.doc_id, 'hybrid', d.text FROM docs d JOIN benchmark b ON b.item_id = d.doc_id WHERE d.lang <> 'en'),
expected AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(text, '[\\p{L}]{6,}')) AS term FROM benchmark),
hits AS (SELECT t.query_id, backend, term, contains(lower(text), lower(term)) AS found FROM texts t JOIN expected e USING (query_id)),
cov AS (SELECT t.query_id, t.backend, CAST(coalesce(n_found, 0) AS BIGINT) AS n_found, CAST(coalesce(n_expected, 0) AS BIGINT) AS n_expected,
  coalesce(n_found / n_expected, 1.0) AS coverage FROM texts t LEFT JOIN (SELECT query_id, backend, count_if(found) AS n_found, count(*) AS n_expected
  FROM hits GROUP BY 1, 2) h USING (query_id, backend))
"""
COVER_SQL = with_(DOCS, COVER)


def _answers(spark, sf):
    """Texts two backends returned for each benchmark item, and the terms expected in them."""
    b = tables.table(spark, sf, "benchmark")
    d = tables.documents(spark, sf)
    own = d.join(b.select(F.col("item_id").alias("doc_id"), F.col("text").alias("__b")), "doc_id")
    wider = F.when(F.col("lang") == "en", F.concat_ws(" ", "text", "__b")).otherwise(F.col("text"))
    texts = own.select(F.col("doc_id").alias("query_id"), F.lit("vector").alias("backend"), "text"
                       ).unionByName(own.select(F.col("doc_id").alias("query_id"),
                                                F.lit("hybrid").alias("backend"), wider.alias("text")))
    terms = b.select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(
        F.regexp_extract_all("text", F.lit(r"([\p{L}]{6,})"), 1))).alias("term"))
    return texts, terms


@query("eval_coverage", COVER_SQL + "SELECT * FROM cov")
def eval_coverage(spark, sf):
    return evals.coverage(*_answers(spark, sf))


@query("eval_coverage_by_backend", COVER_SQL + """
SELECT v AS vector_coverage, h AS hybrid_coverage, h - v AS delta FROM (SELECT
  CAST(sum(CASE WHEN backend = 'vector' THEN CAST(coverage AS DECIMAL(20,9)) END) AS DOUBLE) / count_if(backend = 'vector') AS v,
  CAST(sum(CASE WHEN backend = 'hybrid' THEN CAST(coverage AS DECIMAL(20,9)) END) AS DOUBLE) / count_if(backend = 'hybrid') AS h FROM cov)""")
def eval_coverage_by_backend(spark, sf):
    return evals.coverage_by_backend(evals.coverage(*_answers(spark, sf)), "vector", "hybrid")


@query("found_difference", COVER_SQL + """
SELECT v.query_id, v.term, CASE WHEN v.found THEN 'vector' ELSE 'hybrid' END AS only_in FROM hits v JOIN hits h
  ON v.query_id = h.query_id AND v.term = h.term AND v.backend = 'vector' AND h.backend = 'hybrid' WHERE v.found <> h.found""")
def found_difference(spark, sf):
    return evals.found_difference(evals.coverage_hits(*_answers(spark, sf)), "vector", "hybrid")


STATUS = "CASE WHEN n_found >= 2 OR (n_expected = 1 AND n_found = 1) THEN 'success' WHEN n_found = 1 THEN 'partial' ELSE 'failure' END"


@query("eval_relationship_status", COVER_SQL + f"SELECT query_id, backend, {STATUS} AS status FROM cov")
def eval_relationship_status(spark, sf):
    return evals.relationship_status(evals.coverage(*_answers(spark, sf))).select(
        "query_id", "backend", "status")


@query("eval_relationship_rate", COVER_SQL + f"""
SELECT backend, {big('count(*)')} AS queries, {big("count_if(s = 'success')")} AS successes, {rate("count_if(s = 'success')", 'count(*)')} AS success_pct
FROM (SELECT backend, {STATUS} AS s FROM cov) GROUP BY 1""")
def eval_relationship_rate(spark, sf):
    return evals.relationship_rate(evals.relationship_status(evals.coverage(*_answers(spark, sf))))


@query("eval_coherence_mean", f"""SELECT {big('count(*)')} AS scored, {mean('1 + 2 * quality + toxic')} AS avg_coherence FROM labels""")
def eval_coherence_mean(spark, sf):
    return evals.coherence_mean(tables.table(spark, sf, "labels").select(
        (1 + 2 * F.col("quality") + F.col("toxic")).alias("score")))


def _facts(run: str, p: str) -> str:
    return f"""f{run} AS (SELECT legacy_category AS category, CAST(sum(CASE WHEN error IS NULL THEN CAST(sim AS DECIMAL(20,6)) END) AS DOUBLE) / count_if(error IS NULL) AS {p}_sim,
  {big(f'count_if(error IS NULL AND {SPACE_WORDS} < 30)')} AS {p}_short, {rate('count_if(error IS NULL)', 'count(*)')} AS {p}_success FROM res_{run} GROUP BY 1)"""


@query("eval_regression", with_(DOCS, eval_cte("a"), eval_cte("b"), _facts("a", "base"), _facts("b", "new")) + """
SELECT *, base_sim - new_sim > 0.05 AS similarity_dropped, coalesce(new_short, 0) > coalesce(base_short, 0) AS more_short_answers,
  base_success - new_success > 10 AS success_dropped FROM fa FULL JOIN fb USING (category)""")
def eval_regression(spark, sf):
    return evals.regression(_res(spark, sf), _res(spark, sf, "b"))


@query("verdict_summary", f"""
SELECT {big('count(*)')} AS scored, {mean('1 + 2 * quality')} AS voice_fidelity, {mean('CASE WHEN toxic = 0 THEN 4 ELSE 0 END')} AS reasoning_fidelity,
  {mean('3 + quality - toxic')} AS overall FROM labels WHERE doc_id % 6 <> 0""")
def verdict_summary(spark, sf):
    return evals.verdict_means(tables.verdicts(spark, sf))


@query("tic_frequency", f"""
SELECT tic, {big('count(*)')} AS answers FROM (SELECT 'hedging' AS tic FROM labels WHERE doc_id % 6 <> 0 AND doc_id % 5 = 0
  UNION ALL SELECT 'em dash' FROM labels WHERE doc_id % 6 <> 0 AND doc_id % 5 < 2) GROUP BY 1""")
def tic_frequency(spark, sf):
    return evals.tic_frequency(tables.verdicts(spark, sf))


# --- comparing runs ----------------------------------------------------------

@query("run_compare", AB + """
SELECT key, coalesce(a.question_type, b.question_type, '') AS question_type, a.sim AS sim_a, b.sim AS sim_b, b.sim - a.sim AS delta,
  CASE WHEN abs(b.sim - a.sim) >= 0.005 THEN CASE WHEN b.sim > a.sim THEN '▴' ELSE '▾' END END AS arrow, a.pos IS NOT NULL AS in_a, b.pos IS NOT NULL AS in_b
FROM k_a a FULL JOIN k_b b USING (key)""")
def run_compare(spark, sf):
    return evals.run_compare(_res(spark, sf), _res(spark, sf, "b"))


META = ["model", "provider", "temperature", "top_k", "question_count", "label", "run_timestamp"]


def _meta(spark, sf, run):
    res = _res(spark, sf, run)
    size = F.max(F.size("retrieved_chunks"))
    return res.agg(F.lit(f"openai/m{'2' if run == 'b' else '1'}").alias("model"),
                   F.lit("openai").alias("provider"), F.lit("0.7").alias("temperature"),
                   size.alias("top_k"), F.count(F.lit(1)).alias("question_count"),
                   F.max("run_id").alias("label"), F.lit("2024-01-01T00:00:00").alias("run_timestamp"))


def _meta_sql(run: str, m: str) -> str:
    return (f"(SELECT ['openai/{m}', 'openai', '0.7', CAST(max(len(chunks)) AS VARCHAR), CAST(count(*) AS VARCHAR), max(run_id), "
            f"'2024-01-01T00:00:00'] AS v FROM res_{run})")


@query("run_meta_diff", AB + f"""
SELECT field, value_a, value_b, value_a <> value_b AS differs FROM (SELECT unnest({META}) AS field, unnest(a.v) AS value_a, unnest(b.v) AS value_b
  FROM {_meta_sql('a', 'm1')} a CROSS JOIN {_meta_sql('b', 'm2')} b)""")
def run_meta_diff(spark, sf):
    return evals.run_meta_diff(_meta(spark, sf, "a"), _meta(spark, sf, "b"), META)


STATS_SQL = f"""
s_{{r}} AS (SELECT key, unnest(['response_length_words', 'chunk_similarity_avg', 'markdown_used', 'followup_present', 'links_used', 'total_tokens', 'cost_usd', 'chunks']) AS field,
  unnest([CAST({{w}} AS VARCHAR), CAST(sim AS VARCHAR), {{md}}, CAST({{fu}} AS VARCHAR), CAST({{li}} AS VARCHAR), CAST(total_tokens AS VARCHAR), CAST(cost_usd AS VARCHAR), CAST(len(chunks) AS VARCHAR)]) AS v FROM k_{{r}})"""


def _stats_sql(run: str) -> str:
    ok = lambda x: f"CASE WHEN error IS NULL THEN {x} END"
    return STATS_SQL.format(r=run, w=ok(WORDS_SQL), md=ok(MARKDOWN_SQL.format(x="response")),
                            fu=ok(FOLLOWUP_SQL.format(x="response")), li=ok(LINK_SQL.format(x="response")))


@query("run_stat_diff", with_(DOCS, eval_cte("a"), eval_cte("b"), _stats_sql("a"), _stats_sql("b")) + """
SELECT a.key, a.field, b.v IS NOT NULL AND a.v <> coalesce(b.v, '') AS differs FROM s_a a LEFT JOIN s_b b ON a.key = b.key AND a.field = b.field
WHERE a.v IS NOT NULL""")
def run_stat_diff(spark, sf):
    def with_features(run):
        base = _res(spark, sf, run)
        own = evals.result_features(base, NAMES)
        return own.drop("chunk_similarity_avg").join(
            base.select("pos", "chunk_similarity_avg"), "pos").drop("chunk_similarity_max").withColumn(
            "chunk_similarity_max", F.lit(None).cast("double"))
    return evals.run_stat_diff(with_features("a"), with_features("b")).select(
        "key", "field", "differs")


@query("run_chunk_only", with_(DOCS, eval_cte("a"), eval_cte("b"), *[
    f"c{r} AS (SELECT DISTINCT key, c.source AS source, c.chunk_index AS chunk_index FROM (SELECT key, unnest(chunks) AS c FROM k_{r}))" for r in "ab"]) + """
(SELECT *, 'a' AS only_in FROM (SELECT * FROM ca EXCEPT SELECT * FROM cb)) UNION ALL (SELECT *, 'b' FROM (SELECT * FROM cb EXCEPT SELECT * FROM ca))""")
def run_chunk_only(spark, sf):
    return evals.run_chunk_only(_res(spark, sf), _res(spark, sf, "b"))


# --- loaders and sinks -------------------------------------------------------

@query("questions_load", """
SELECT concat('Q', item_id) AS question_id, trim(text) AS question, CASE WHEN item_id % 3 = 0 THEN 'bio' ELSE 'work' END AS legacy_category,
  'facts, "quoted"' AS must_cover, 'extra' AS nice_to_have FROM benchmark""")
def questions_load(spark, sf):
    bank = tables.table(spark, sf, "benchmark").select(
        F.concat(F.lit("Q"), "item_id").alias("question_id"), F.col("text").alias("question"),
        F.when(F.col("item_id") % 3 == 0, "bio").otherwise("work").alias("category"),
        F.lit('facts, "quoted"').alias("expected_info"), F.lit("extra").alias("notes"))
    path = scratch_dir(spark, "questions")
    sinks.write_csv(bank, path)
    return files.questions_load(spark, path).select(
        "question_id", "question", "legacy_category", "must_cover", "nice_to_have")


@query("eval_load_runs", with_(DOCS, eval_cte("a")) + f"""
SELECT CASE WHEN pos // 50 % 4 = 3 THEN '? · t=? · k=?' ELSE concat('2024-01-01 00:00:00 · batch ', pos // 50, ' · t=0.7 · k=?') END AS label,
  CASE WHEN pos // 50 % 4 = 3 THEN '1.0' ELSE '2.0' END AS schema_version, {big('count(*)')} AS results, {big('count(error)')} AS errors
FROM res_a GROUP BY pos // 50""")
def eval_load_runs(spark, sf):
    res = _res(spark, sf).withColumn("batch", F.floor(F.col("pos") / 50))
    body = F.to_json(F.array_sort(F.collect_list(F.struct(
        "pos", *[c for c in res.columns if c not in ("pos", "batch")]))))
    envelope = F.concat(
        F.lit('{"schema_version": "2.0",\n "run_metadata": {"label": "batch '), F.col("batch"),
        F.lit('", "temperature": "0.7", "run_timestamp": "2024-01-01T00:00:00"},\n "results": '),
        F.col("body"), F.lit("}"))
    runs = res.groupBy("batch").agg(body.alias("body")).select(
        "batch", F.when(F.col("batch") % 4 == 3, F.col("body")).otherwise(envelope).alias("value"))
    path = scratch_dir(spark, "runs")
    runs.repartition("batch").write.partitionBy("batch").text(path)
    loaded = (spark.read.format("text").option("wholetext", True)
              .option("recursiveFileLookup", True).load(path)
              .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))
    found = files.runs_from(loaded)
    return files.run_results(found).groupBy("path").agg(
        F.count(F.lit(1)).alias("results"), F.count("error").alias("errors")).join(
        found.select("path", "label", "schema_version"), "path").drop("path")


@query("docs_load_text", with_(DOCS) + """
SELECT sha256(string_agg(text || chr(10), '' ORDER BY doc_id)) AS content_hash, string_agg(text || chr(10), '' ORDER BY doc_id) AS text
FROM docs GROUP BY source, doc_id // 500""")
def docs_load_text(spark, sf):
    docs = tables.documents(spark, sf).withColumn(
        "file", F.concat_ws("-", "source", F.floor(F.col("doc_id") / 500)))
    path = scratch_dir(spark, "docs")
    (docs.repartition("file").sortWithinPartitions("file", "doc_id").select("file", "text")
     .write.partitionBy("file").text(path))
    return files.docs_load_text(spark, path).select("content_hash", "text")


@query("voice_samples_load", with_(DOCS) + r"""
SELECT CASE WHEN lang = 'de' THEN 'unspecified' ELSE concat('reg-', lang) END AS register,
  CASE WHEN lang = 'de' THEN concat(doc_id, '.md') ELSE source END AS source, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text
FROM docs WHERE lang <> 'es' AND trim(text) <> ''""")
def voice_samples_load(spark, sf):
    d = tables.documents(spark, sf)
    header = F.concat(F.lit("---\nregister: reg-"), "lang", F.lit("\nsource: "), "source",
                      F.lit("\n---\n"))
    content = F.when(F.col("lang") == "de", F.col("text")).otherwise(F.concat(header, F.col("text")))
    name = F.when(F.col("lang") == "es", F.concat(F.lit("v/_template-"), "doc_id", F.lit(".md"))
                  ).otherwise(F.concat(F.lit("v/"), "doc_id", F.lit(".md")))
    return files.voice_samples_from(d.select(name.alias("path"), content.alias("content")))


@query("register_coverage", with_(DOCS) + f"""
SELECT coalesce(w.register, h.register) AS register, w.register IS NOT NULL AS wanted, {big('coalesce(n, 0)')} AS samples
FROM (VALUES ('en'), ('fr'), ('wry')) w(register) FULL JOIN (SELECT lang AS register, count(*) AS n FROM docs GROUP BY 1) h ON w.register = h.register""")
def register_coverage(spark, sf):
    samples = tables.documents(spark, sf).select(F.col("lang").alias("register"))
    return evals.register_coverage(samples, ["en", "fr", "wry"])


@query("answers_load", """
SELECT a.conv_id, a.turn, q.text AS question, a.text AS answer FROM conversations a JOIN conversations q ON q.conv_id = a.conv_id AND q.turn = a.turn - 1
WHERE a.role = 'assistant' AND q.text <> '' AND a.text <> ''""")
def answers_load(spark, sf):
    h = tables.history(spark, sf)
    asked = h.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    lines = h.where(F.col("role") == "assistant").join(asked, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.to_json(F.struct("question", F.col("text").alias("answer"))).alias("value"))
    return files.answers_from(lines, carry=("conv_id", "turn")).select(
        "conv_id", "turn", "question", "answer")


@query("projects_load", """
SELECT concat('p', item_id) AS project_id, text AS title, '' AS design_insight, 0 AS n_tags FROM benchmark""")
def projects_load(spark, sf):
    raw = tables.table(spark, sf, "benchmark").select(
        F.concat(F.lit("p"), "item_id").alias("project_id"), F.col("text").alias("title"))
    return files.projects_from(raw).select("project_id", "title", "design_insight",
                                           F.size("tags").alias("n_tags"))


@query("sink_sessions_daily", with_(LOG) + f"""
SELECT CAST(timezone('America/Chicago', timezone('UTC', min(ts))) AS DATE) AS start_local_date, session_id, {big('count(*)')} AS turns
FROM chats WHERE trim(session_id) <> '' GROUP BY session_id""")
def sink_sessions_daily(spark, sf):
    from murmur.operators import sessions
    turns = sessions.analysable_turns(tables.chat_log(spark, sf).withColumn("message", F.lit("")))
    path = scratch_dir(spark, "sessions")
    sinks.write_sessions(sessions.session_summary_ext(turns), path)
    return spark.read.parquet(path).select("start_local_date", "session_id", "turns")


@query("sink_summary_json", with_(LOG) + f"""
SELECT {big('(SELECT count(*) FROM chats)')} AS turns, {big('(SELECT count(*) FROM votes)')} AS votes, {big('(SELECT count_if(liked) FROM votes)')} AS likes""")
def sink_summary_json(spark, sf):
    from murmur.operators import breakdowns
    turns = tables.chat_log(spark, sf).agg(F.count(F.lit(1)).alias("turns"))
    summary = sinks.summary_row(log=turns, votes=breakdowns.vote_summary(tables.vote_log(spark, sf)))
    path = scratch_dir(spark, "summary")
    sinks.write_summary(summary, path)
    return spark.read.json(path).select("log.turns", F.col("votes.total").alias("votes"),
                                        "votes.likes")
