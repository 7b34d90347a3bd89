"""Log, section and graph tables derived from the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from murmur.session import materialize, prepare, scratch_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat and vote rows from ``events``; no join, no shuffle, prunable columns."""
    return log_from(table(spark, sf_dir, "events"))


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table read as a file stream, be it one file or a folder of them."""
    schema = table(spark, sf_dir, name).schema
    # A pattern: file streams take a single file only if a pattern matches it.
    return spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/{name}.parque[t]")


FILE_ROWS = 200_000  # of a replayed batch: so many rows are written and read by one task


def replay(rows: DataFrame, ts: str, late_seconds: int, batches: int = 4) -> DataFrame:
    """Rows as a stream of ``batches`` batches, each of the same number of files.

    Every row arrives up to ``late_seconds`` after its event time (by a hash of it), so rows come
    out of order within and across batches; a watermark of that lateness loses none.
    """
    spark = rows.sparkSession
    late = F.pmod(F.xxhash64(*rows.columns), F.lit(late_seconds * 1_000_000))
    timed = rows.withColumn("__arrived", F.unix_micros(ts) + late)
    first, last = timed.agg(F.min("__arrived"), F.max("__arrived")).first()
    path, files = scratch_dir(spark, "replay"), 1
    if first is not None:
        width = (last - first) // batches + 1
        batch = F.floor((F.col("__arrived") - first) / width)
        arrived = scratch_dir(spark, "arrivals")
        timed.where("__arrived IS NOT NULL").withColumn("__batch", batch).write.partitionBy("__batch").parquet(arrived)
        kept = spark.read.schema(StructType([*timed.schema.fields, StructField("__batch", LongType())])).parquet(arrived)
        sizes = [r["count"] for r in kept.groupBy("__batch").count().collect()]
        files = max(1, -(-max(sizes) // FILE_ROWS))
        for i in range(batches):
            part = kept.where(F.col("__batch") == i)
            part = part.coalesce(1) if files == 1 else part.repartition(files, "__arrived")
            part.drop("__arrived", "__batch").write.parquet(f"{path}/{i}")
            # A batch of few rows may leave files out; the next batch's must not come with it.
            for missing in range(files - len(spark.read.schema(rows.schema).parquet(f"{path}/{i}").inputFiles())):
                spark.createDataFrame([], rows.schema).write.parquet(f"{path}/{i}/empty{missing}")
    else:
        rows.write.parquet(f"{path}/0")
    return (spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files)
            .option("recursiveFileLookup", True).parquet(path))


def log_from(e: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    ts = F.col("ts").cast("timestamp")
    blank = F.col("event_id") % 50 == 0
    sim = F.when(F.col("event_id") % 41 == 0, None)
    model = F.array(*[F.lit(m) for m in
                      ["openai/m1", "openai/m2", "anthropic/m3", "gemini/m4"]])
    provider = F.array(*[F.lit(p) for p in ["openai", "openai", "anthropic", "gemini"]])
    tier = F.array(*[F.lit(t) for t in ["public", "personal", "inner_circle"]])
    pick = lambda arr, col, n: F.element_at(arr, (F.col(col) % n + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("row_id"),
        ts.alias("ts"),
        F.when(F.col("event_type") == "signup", "vote").alias("event"),
        F.when(blank, "").otherwise(
            F.concat(F.lit("u"), F.col("user_id"), F.lit("-"), F.to_date("ts"))
        ).alias("session_id"),
        (F.hour("ts") * 60 + F.minute("ts") + 1).cast("bigint").alias("turn_index"),
        pick(model, "user_id", 4).alias("model"),
        pick(provider, "user_id", 4).alias("provider"),
        pick(tier, "user_id", 3).alias("audience_tier"),
        F.when(F.col("event_type") == "click", "walkthrough")
        .when(F.col("event_type") == "purchase", "diagram_only")
        .otherwise("standard").alias("workflow"),
        ((F.col("user_id") % 25 == 0) & (F.col("event_id") % 10 == 0)).alias("is_owner_traffic"),
        (F.col("event_type") == "error").alias("had_error"),
        (F.col("event_id") % 97 == 0).alias("empty_response"),
        F.floor(F.col("value") * 100).alias("latency_ms"),
        F.floor(F.col("value") * 10).alias("response_chars"),
        sim.otherwise(k / 100.0).alias("chunk_similarity_avg"),
        sim.otherwise((k + 7) / 107.0).alias("chunk_similarity_max"),
        (k / 1000.0).alias("cost_usd"),
        (k % 11).cast("bigint").alias("n_chunks_retrieved"),
        (5 + 5 * (F.col("user_id") % 3)).cast("bigint").alias("n_chunks_config"),
        ((F.col("user_id") % 11) / 10.0).alias("temperature"),
        (F.col("event_id") % 13 == 0).alias("tool_called"),
        F.when(F.col("event_id") % 13 == 0, F.when(k % 2 == 0, "send_notification")
               .otherwise("roll_dice")).alias("tool_name"),
        (k % 3 == 1).alias("__one"), (k % 3 == 2).alias("__two"),
        (k * 9).cast("bigint").alias("prompt_tokens"),
        F.when(k % 7 != 0, k * 4).cast("bigint").alias("completion_tokens"),
    ).select("*", F.when(~F.col("__two"), F.col("__one")).alias("liked")).drop("__one", "__two")


def with_message(log: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attach whole benchmark texts as messages, spread over all of them."""
    bank = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("message"))
    size = bank.agg(F.count(F.lit(1))).scalar()
    return (log.withColumn("item_id", F.col("row_id") * 7 % size)
            .join(bank, "item_id", "left").drop("item_id"))


def chat_log(spark: SparkSession, sf_dir: str, message: bool = False) -> DataFrame:
    log = query_log(spark, sf_dir).where(F.col("event").isNull())
    return with_message(log, spark, sf_dir) if message else log


def vote_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_log(spark, sf_dir).where(F.col("event") == "vote")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus with a source type per document; two sources are restricted."""
    d = table(spark, sf_dir, "documents")
    kind = (F.when(F.col("source") == "src18", "notes-personal")
            .when(F.col("source") == "src19", "notes-inner").otherwise("notes-public"))
    return d.select("doc_id", "text", "lang", "source", "n_chars", kind.alias("source_type"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as stand-alone messages."""
    return history(spark, sf_dir).where(F.col("role") == "user").select(
        F.concat(F.col("conv_id"), F.lit("-"), F.col("turn")).alias("message_id"),
        F.col("text").alias("message"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project catalogue built from the benchmark texts."""
    b = table(spark, sf_dir, "benchmark").withColumn("w", F.split("text", " "))
    w = lambda i: F.coalesce(F.get("w", F.lit(i)), F.lit(""))
    pair = lambda i: F.concat_ws(" ", w(i), w(i + 1))
    return b.select(
        F.concat(F.lit("p"), F.col("item_id")).alias("project_id"),
        F.col("item_id").alias("order"),
        pair(0).alias("title"), F.col("text").alias("summary"),
        F.when(F.length("text") % 2 == 0, pair(7)).otherwise("").alias("design_insight"),
        F.when(F.length("text") % 5 == 0, "").otherwise(F.col("text"))
        .alias("walkthrough_context"),
        F.concat(w(0), F.lit(".png")).alias("diagram_filename"),
        F.array(F.lower(w(4)), F.lower(w(6))).alias("tags"),
        F.array(pair(2), w(5)).alias("mention_keywords"),
        F.create_map(F.lit("demo"), F.concat(F.lit("https://example.org/"), w(3)),
                     F.lit("docs"), F.lit("")).alias("links"),
        F.when(F.length("text") % 3 == 0, F.array(F.struct(
            pair(8).alias("title"), F.concat(F.lit("https://example.org/b/"), w(8)).alias("url")))
        ).alias("blog_posts"))


def paragraph_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus with every line as its own paragraph."""
    return documents(spark, sf_dir).withColumn(
        "text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


def markdown_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus with second and third level headers put before some lines."""
    lines = F.transform(F.split("text", "\n", -1), lambda s, i: F.when(
        i % 5 == 2, F.concat(F.lit("## L"), i, F.lit("\n"), s)).when(
        i % 5 == 4, F.concat(F.lit("### L"), i, F.lit("\n"), s)).otherwise(s))
    return documents(spark, sf_dir).withColumn("text", F.array_join(lines, "\n"))


def tiers(spark: SparkSession) -> DataFrame:
    """Source types with a restricted tier."""
    return spark.sql("SELECT * FROM VALUES ('notes-personal', 'personal'), "
                     "('notes-inner', 'inner_circle') AS t(source_type, tier)")


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per document line, for audits."""
    d = documents(spark, sf_dir).select(
        "doc_id", "lang", F.concat_ws(":", "source_type", "source").alias("source"),
        F.posexplode(F.split("text", "\n", -1)).alias("chunk_index", "text"))
    section = F.when(F.col("lang") != "en", F.concat(F.lit("part "), F.floor(
        F.col("chunk_index") / 10)))
    return d.select(F.concat_ws("-", "doc_id", "chunk_index").alias("id"), "doc_id", "source",
                    section.alias("section"), "chunk_index", "text",
                    F.length("text").alias("char_count"))


def project_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as projects, parts as the entities they use, in spelling variants."""
    pairs = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    p = table(spark, sf_dir, "part")
    kind = F.element_at(F.array(F.lit("skills"), F.lit("methods"), F.lit("technologies")),
                        (F.col("p_size") % 3 + 1).cast("int"))
    name = (F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name"))
            .when(F.col("p_partkey") % 3 == 1, F.initcap("p_name")).otherwise(F.col("p_name")))
    parts = p.select("p_partkey", kind.alias("kind"),
                     F.concat(name, F.when(F.col("p_partkey") % 5 == 0, " ").otherwise(""))
                     .alias("name"),
                     F.col("p_type").alias("category"), F.col("p_brand").alias("detail"))
    return pairs.join(parts, pairs.l_partkey == parts.p_partkey).select(
        F.col("l_suppkey").cast("string").alias("project_id"), "kind", "name", "category",
        "detail", (F.col("l_suppkey") * 10_000_000 + F.col("l_partkey")).alias("seq"))


def project_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and the parts they share; methods carry a stage, so paths can be parallel."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    methods = F.col("p_size") % 2 == 0
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_suppkey").cast("string").alias("project"),
        F.when(methods, "methods").otherwise("technologies").alias("kind"),
        F.concat(F.lit("part "), F.col("l_partkey")).alias("entity"),
        F.when(methods, F.col("l_returnflag")).alias("detail")).distinct()


def section_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sections: long words as concepts, part names as skills, titles as projects."""
    d = documents(spark, sf_dir)
    sid = F.concat(F.lit("kb_"), F.col("source"), F.lit(":"), F.col("doc_id"))
    long_words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\p{L}{14,})"), 1))
    concepts = d.select(sid.alias("section_id"), F.lit("concepts").alias("kind"),
                        F.posexplode(long_words).alias("p", "name"),
                        F.lit(None).cast("string").alias("context"), "doc_id")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), "p_name")
    skills = d.join(p, "doc_id").select(
        sid.alias("section_id"), F.lit("skills").alias("kind"), F.lit(0).alias("p"),
        F.col("p_name").alias("name"), F.lit(None).cast("string").alias("context"), "doc_id")
    c = catalogue(spark, sf_dir).select(F.col("order").alias("doc_id"), "title", "mention_keywords")
    named = d.join(c, "doc_id").select(
        sid.alias("section_id"), F.lit("projects").alias("kind"), F.lit(0).alias("p"),
        F.when(F.col("lang") == "en", F.concat(F.lit(" "), F.lower("title")))
        .when(F.col("lang") == "fr", F.get("mention_keywords", F.lit(0)))
        .otherwise("no such project").alias("name"), F.col("text").alias("context"), "doc_id")
    rows = concepts.unionByName(skills).unionByName(named)
    return rows.select("section_id", "kind", "name", "context",
                       (F.col("doc_id") * 100_000 + F.col("p")).alias("seq"))


def section_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that exist in the graph: all but the German documents."""
    return documents(spark, sf_dir).where(F.col("lang") != "de").select(
        F.concat(F.lit("kb_"), F.col("source"), F.lit(":"), F.col("doc_id")).alias("section_id"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded sections: eight per parent, tiers by id, whole document texts."""
    v = table(spark, sf_dir, "embeddings")
    d = documents(spark, sf_dir).select("doc_id", F.col("text").alias("full_text"), "source",
                                        F.col("source_type").alias("__kind"))
    digit = F.col("vec_id") % 10
    return v.join(d, v.vec_id == d.doc_id, "left").select(
        F.col("vec_id").alias("section_id"), F.floor(F.col("vec_id") / 8).alias("parent"),
        (F.col("vec_id") % 8).alias("order"),
        F.concat(F.lit("part "), F.col("vec_id") % 8).alias("name"),
        F.when(digit <= 6, "public").when(digit <= 8, "personal").otherwise("inner_circle")
        .alias("sensitivity"),
        F.coalesce("full_text", F.lit("")).alias("full_text"),
        F.length(F.coalesce("full_text", F.lit(""))).alias("char_count"),
        F.concat_ws(":", "__kind", "source").alias("source"), "embedding", "label")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items as queries, with the vector of the same number."""
    b = table(spark, sf_dir, "benchmark")
    v = table(spark, sf_dir, "embeddings")
    tier = F.element_at(F.array(F.lit("public"), F.lit("personal"), F.lit("inner_circle")),
                        (F.col("item_id") % 3 + 1).cast("int"))
    return b.join(v, b.item_id == v.vec_id).select(
        F.col("item_id").alias("query_id"), "embedding", tier.alias("tier"), F.lit(5).alias("k"),
        "label", "text")


def section_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HAS_SECTION, NEXT_SECTION, DESCRIBED_IN and MENTIONS edges of the sections."""
    v = table(spark, sf_dir, "embeddings").select("vec_id")
    sid = F.col("vec_id").cast("string")
    empty = F.create_map().cast("map<string,string>")
    edge = lambda df, sk, s, rel, dk, d: df.select(
        F.lit(sk).alias("src_kind"), s.cast("string").alias("src"), F.lit(rel).alias("rel"),
        F.lit(dk).alias("dst_kind"), d.cast("string").alias("dst"), empty.alias("props"))
    mentions = v.select("vec_id", F.explode(F.sequence(F.lit(1), (F.col("vec_id") % 8).cast("int")))
                        .alias("i")).where((F.col("vec_id") % 8) > 0)
    return (edge(v, "Document", F.floor(F.col("vec_id") / 8), "HAS_SECTION", "Section", sid)
            .unionByName(edge(v.where(F.col("vec_id") % 8 < 7), "Section", sid, "NEXT_SECTION",
                              "Section", F.col("vec_id") + 1))
            .unionByName(edge(v.where(F.col("vec_id") % 3 == 0), "Project",
                              F.col("vec_id") % 12, "DESCRIBED_IN", "Section", sid))
            .unionByName(edge(mentions, "Section", sid, "MENTIONS", "Concept",
                              F.col("vec_id") * F.col("i") % 50)))


def section_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents of the sections; some are missing."""
    parent = F.floor(F.col("vec_id") / 8)
    return (table(spark, sf_dir, "embeddings").select(parent.alias("doc_id")).distinct()
            .where(F.col("doc_id") % 7 != 3)
            .withColumn("title", F.concat(F.lit("Doc "), F.col("doc_id"))))


def section_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 12).alias("project_id"))
            .distinct().withColumn("title", F.concat(F.lit("Project "), F.col("project_id"))))


def eval_results(spark: SparkSession, sf_dir: str, run: str = "a") -> DataFrame:
    """Evaluation results over all documents; run b shifts scores, loses one source."""
    from murmur.schemas import EVAL_RESULT, RETRIEVED_CHUNK

    d = documents(spark, sf_dir)
    i = F.col("doc_id")
    b = run == "b"
    if b:
        d = d.where(F.col("source") != "src11")
    step = 1 if b else 0
    chunks = F.transform(
        F.slice(F.sequence(F.lit(1), F.lit(4)), F.lit(1), (i % 5).cast("int")),
        lambda j: F.struct(
            F.lit("").alias("text"), F.col("source").alias("source"),
            F.col("lang").alias("section"),
            ((i * j + j * step) % 17).cast("int").alias("chunk_index"),
            F.lit(None).cast("double").alias("distance"),
            ((i * j) % 100 / 100.0).alias("similarity")))
    columns = {
        "run_id": F.lit(f"run-{run}"),
        "question_id": F.when(i % 17 == 0, "").otherwise(F.concat(F.lit("q"), i)),
        "question": F.col("text"), "legacy_category": F.col("source"),
        "question_type": F.col("lang"), "expected_info": F.lit("facts"),
        "response": F.when(F.lit(b) & (F.col("lang") == "es"), "Sí. [x](http://e.org) happy to")
        .otherwise(F.col("text")),
        "error": F.when(i % (13 if b else 19) == 0, "timeout"),
        "issue_source": F.when(i % 7 == 0, "retrieval").when(i % 7 == 1, "prompt"),
        "retrieved_chunks": chunks.cast(f"array<{RETRIEVED_CHUNK.simpleString()}>"),
        "total_tokens": i % 1000, "cost_usd": (i % 50) / 1000.0,
        "chunk_similarity_avg": (i + (7 if b else 0)) % 100 / 100.0,
    }
    return d.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
                      for f in EVAL_RESULT.fields], i.alias("pos"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge verdicts from the document labels; a sixth of them failed."""
    lab = table(spark, sf_dir, "labels")
    tics = F.filter(F.array(F.when(F.col("doc_id") % 5 == 0, "hedging"),
                            F.when(F.col("doc_id") % 5 < 2, "em dash")), lambda t: t.isNotNull())
    return lab.select(
        "doc_id", F.when(F.col("doc_id") % 6 == 0, "parse error").alias("error"),
        (1 + 2 * F.col("quality")).alias("voice_fidelity"),
        F.when(F.col("toxic") == 0, 4).alias("reasoning_fidelity"),
        (3 + F.col("quality") - F.col("toxic")).alias("overall"), tics.alias("tics"))
