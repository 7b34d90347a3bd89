"""Readers for documents, question banks, evaluation runs, samples and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur import schemas
from murmur.functions import loose, text


def docs_load_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files with the hash of their exact bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        "path", F.sha2("content", 256).alias("content_hash"), F.col("length").alias("bytes"),
        F.decode("content", "UTF-8").alias("text"))


def _first_of(frame: DataFrame, *names: str) -> Column:
    present = [F.nullif(F.col(n), F.lit("")) for n in names if n in frame.columns]
    return F.coalesce(*present, F.lit(""))


# Older column names a question bank may still use.
QUESTION_ALIASES = {
    "legacy_category": ("legacy_category", "category"),
    "must_cover": ("must_cover", "expected_info"),
    "nice_to_have": ("nice_to_have", "notes"),
}


def questions_from(raw: DataFrame, category: str | None = None,
                   limit: int | None = None) -> DataFrame:
    """Question bank columns with alias fall-backs; rows without a question go."""
    named = raw.select(*[F.col(f"`{c}`").alias(c.strip().lstrip("﻿")) for c in raw.columns])
    out = named.select(*[
        _first_of(named, *QUESTION_ALIASES.get(c, (c,))).alias(c)
        for c in schemas.QUESTION_COLUMNS])
    out = out.withColumn("question", loose.strip(F.col("question"))).where(F.col("question") != "")
    if category:
        out = out.where(F.col("legacy_category") == category)
    return out.orderBy("question_id").limit(limit) if limit else out


def questions_load(spark: SparkSession, path: str, category: str | None = None,
                   limit: int | None = None) -> DataFrame:
    raw = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
           .csv(path))
    return questions_from(raw, category, limit)


_META = T.StructType([T.StructField(f, T.StringType()) for f in schemas.RUN_METADATA_FIELDS])
_RESULTS = T.ArrayType(schemas.EVAL_RESULT)
_ENVELOPE = T.StructType([T.StructField("schema_version", T.StringType()),
                          T.StructField("run_metadata", _META),
                          T.StructField("results", _RESULTS)])


def runs_from(files: DataFrame) -> DataFrame:
    """(path, content[, modified]) → one row per run; a bare list is an old-style run."""
    bare = F.ltrim("content").startswith("[")
    body = F.when(bare, F.struct(
        F.lit("1.0").alias("schema_version"), F.lit(None).cast(_META).alias("run_metadata"),
        F.from_json("content", _RESULTS).alias("results"))).otherwise(
        F.from_json("content", _ENVELOPE))
    meta = F.col("run.run_metadata")
    label = F.concat_ws(
        " · ",
        F.replace(F.substring(meta["run_timestamp"], 1, 19), F.lit("T"), F.lit(" ")),
        F.coalesce(F.nullif(meta["label"], F.lit("")), meta["model"], F.lit("?")),
        F.concat(F.lit("t="), F.coalesce(meta["temperature"], F.lit("?"))),
        F.concat(F.lit("k="), F.coalesce(meta["top_k"], F.lit("?"))))
    carried = [c for c in files.columns if c != "content"]
    return files.withColumn("run", body).select(
        *carried, label.alias("label"), "run.schema_version", "run.run_metadata", "run.results")


def eval_load_runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs of the ``eval_results_*`` files below ``path``."""
    return runs_from(_whole_files(spark, path, "eval_results_*"))


def run_results(runs: DataFrame, key: str = "path") -> DataFrame:
    """Results of every run with their position in it."""
    return runs.select(key, F.posexplode("results").alias("pos", "r")).select(key, "pos", "r.*")


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.agg(F.max_by(F.struct("path", "label"), F.struct("modified", "path"))
                    .alias("r")).select("r.*")


FRONT_MATTER = r"(?s)^---\s*\n(.*?)\n---\s*\n(.*)$"


def voice_samples_from(files: DataFrame) -> DataFrame:
    """(path, content) → register, source, text; the template and empty bodies go."""
    name = F.substring_index("path", "/", -1)
    has = F.col("content").rlike(FRONT_MATTER)
    header = F.when(has, F.regexp_extract("content", FRONT_MATTER, 1)).otherwise("")
    body = F.when(has, F.regexp_extract("content", FRONT_MATTER, 2)).otherwise(F.col("content"))
    meta = text.front_matter_map(F.concat(F.lit("---\n"), header, F.lit("\n---\n")))
    out = files.where(~F.upper(name).contains("TEMPLATE")).select(
        F.coalesce(meta["register"], F.lit("unspecified")).alias("register"),
        F.coalesce(meta["source"], name).alias("source"), loose.strip(body).alias("text"))
    return out.where(F.col("text") != "")


def _whole_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return (spark.read.format("text").option("wholetext", True).option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", True).load(path)
            .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"),
                    F.col("_metadata.file_modification_time").alias("modified")))


def voice_samples_load(spark: SparkSession, path: str) -> DataFrame:
    """Samples of all Markdown files below ``path``."""
    return voice_samples_from(_whole_files(spark, path, "*.md"))


def answers_load(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Answers of a JSON-lines file or folder; ``limit`` keeps the first ones in file order."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line"))
    answers = answers_from(lines, carry=("line",))
    if limit is not None:
        answers = answers.orderBy("line").limit(limit)
    return answers


def answers_from(lines: DataFrame, value: str = "value", carry: tuple[str, ...] = ()
                 ) -> DataFrame:
    """JSON lines with both a question and an answer."""
    parsed = lines.withColumn("a", F.from_json(
        value, "question string, answer string, backend string, model string"))
    return parsed.where((F.coalesce("a.question", F.lit("")) != "")
                        & (F.coalesce("a.answer", F.lit("")) != "")).select(*carry, "a.*")


def projects_from(raw: DataFrame) -> DataFrame:
    """Catalogue rows with every optional field present."""
    arrays = F.array().cast("array<string>")
    defaults = {"design_insight": F.lit(""), "walkthrough_context": F.lit(""),
                "diagram_filename": F.lit(""), "tags": arrays, "mention_keywords": arrays}
    return raw.withColumns({c: F.coalesce(F.col(c), d) if c in raw.columns else d
                            for c, d in defaults.items()})
