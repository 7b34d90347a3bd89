"""The column helpers under SQL names, as JVM-side SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from murmur.functions import text


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def register(spark: SparkSession) -> None:
    """redact_pii, normalize_prompt, sim_from_l2 and markdown_level for spark.sql."""
    marks = text.PROMPT_MARKS.replace("'", "\\'").replace('"', '\\"')
    squash = "trim(regexp_replace({x}, r'(?U)\\s+', ' '))"
    bodies = {
        "redact_pii(t STRING) RETURNS STRING":
            f"coalesce(regexp_replace(regexp_replace(t, {_quoted(text.EMAIL_PATTERN)}, '[EMAIL]'), "
            f"{_quoted(text.PHONE_PATTERN)}, '[PHONE]'), '')",
        "normalize_prompt(t STRING) RETURNS STRING":
            squash.format(x="translate(" + squash.format(x="lower(coalesce(t, ''))")
                          + f", '{marks}', '')"),
        "sim_from_l2(d DOUBLE) RETURNS DOUBLE":
            "if(d is null, null, greatest(0D, least(1D, 1D - d * d / 2D)))",
        "markdown_level(t STRING) RETURNS STRING":
            f"CASE int(rlike(coalesce(t, ''), {_quoted(text.BULLET_PATTERN)})) "
            "+ int(contains(coalesce(t, ''), '**') or contains(coalesce(t, ''), '__')) "
            "+ int(contains(coalesce(t, ''), '#')) "
            f"+ int(rlike(coalesce(t, ''), {_quoted(text.LINK_PATTERN)})) "
            "WHEN 0 THEN 'none' WHEN 1 THEN 'light' ELSE 'strong' END",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
