"""Column layouts of the log and knowledge tables."""

from __future__ import annotations

from pyspark.sql import types as T

# The analysed chat fields and their kinds.
CHAT_FIELDS = {
    "ts": "ts",
    "session_id": "text",
    "turn_index": "number",
    "message": "text",
    "assistant_response_preview": "string",
    "project": "string",
    "walkthrough": "bool",
    "audience_tier": "string",
    "is_owner_traffic": "bool",
    "tool_called": "bool",
    "tool_name": "string",
    "had_error": "bool",
    "empty_response": "bool",
    "model": "string",
    "temperature": "number",
    "n_chunks_retrieved": "number",
    "n_chunks_config": "number",
    "response_chars": "number",
    "latency_ms": "number",
    "workflow": "string",
    "chunk_similarity_avg": "number",
    "chunk_similarity_max": "number",
    "provider": "string",
    "cost_usd": "number",
    "prompt_tokens": "number",
    "completion_tokens": "number",
}
VOTE_FIELDS = {
    "ts": "ts",
    "event": "string",
    "session_id": "string",
    "liked": "bool",
    "message_index": "number",
    "user_message": "string",
    "response_snippet": "string",
    "model": "string",
    "temperature": "number",
    "cost_usd": "number",
    "is_owner_traffic": "bool",
}
# Values absent fields take in the default-fill profile.
CHAT_DEFAULTS = {
    "audience_tier": "public",
    "is_owner_traffic": False,
    "tool_called": False,
    "had_error": False,
    "empty_response": False,
    "model": "unknown",
    "temperature": 0.0,
    "n_chunks_retrieved": 0.0,
    "n_chunks_config": 0.0,
    "response_chars": 0.0,
    "latency_ms": 0.0,
    "workflow": "unknown",
    "chunk_similarity_avg": 0.0,
    "chunk_similarity_max": 0.0,
    "provider": "unknown",
    "cost_usd": 0.0,
}
# Columns of the raw log view.
LOG_VIEW_COLUMNS = ["ts", "message", "audience_tier", "project", "walkthrough", "tool_called",
                    "tool_name", "had_error"]
# end of fixed values

QUESTION_COLUMNS = [
    "question_id", "question", "legacy_category", "question_type", "intent", "audience_mode",
    "difficulty", "priority", "must_cover", "nice_to_have", "should_not_do",
    "preferred_structure", "preferred_followup_behavior", "acceptable_projects_or_examples",
    "grounding_expectation", "source_of_question", "notes",
]

RETRIEVED_CHUNK = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("section", T.StringType()),
    T.StructField("chunk_index", T.IntegerType()),
    T.StructField("distance", T.DoubleType()),
    T.StructField("similarity", T.DoubleType()),
])

EVAL_RESULT = T.StructType([
    *[T.StructField(c, T.StringType()) for c in
      ["run_id", "question_id", "question", "legacy_category", "category", "question_type",
       "intent", "audience_mode", "difficulty", "priority", "must_cover", "nice_to_have",
       "should_not_do", "preferred_structure", "preferred_followup_behavior",
       "acceptable_projects_or_examples", "grounding_expectation", "expected_info", "notes",
       "response", "error", "issue_source", "markdown_used"]],
    T.StructField("retrieved_chunks", T.ArrayType(RETRIEVED_CHUNK)),
    T.StructField("specific_projects_mentioned", T.ArrayType(T.StringType())),
    T.StructField("response_length_words", T.LongType()),
    T.StructField("total_tokens", T.LongType()),
    T.StructField("links_used", T.BooleanType()),
    T.StructField("followup_present", T.BooleanType()),
    T.StructField("chunk_similarity_avg", T.DoubleType()),
    T.StructField("chunk_similarity_max", T.DoubleType()),
    T.StructField("cost_usd", T.DoubleType()),
])

RUN_METADATA_FIELDS = ["model", "provider", "temperature", "top_k", "question_count", "label",
                       "run_timestamp"]
