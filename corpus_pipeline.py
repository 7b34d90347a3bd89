"""Corpus preparation in five stages; each reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm import mixing, packing, quality, simhash, suffix_dedup
from murmur.llm.queries import BYTE_BPE, vocabulary
from murmur.session import materialize
from murmur.sources.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on these documents, does not reject."""
    return quality.keep_good(docs.select(*COLUMNS), quality.fit(docs))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; rows without an id stay.

    A row is known by its id and its text, so that another text under the same id stays.
    """
    copies = (simhash.similar_groups(docs).where(F.col("component_id") < F.col("doc_id"))
              .select("doc_id", "text_key").distinct())
    return (docs.select(*COLUMNS, suffix_dedup.text_key()).join(copies, ["doc_id", "text_key"], "left_anti")
            .select(*COLUMNS))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that repeat earlier ones; a text that loses everything goes.

    Texts under one id are cut each on its own, in the order of their hashes.
    """
    numbers = suffix_dedup.numbered(docs)
    if numbers is None:
        rows = docs.select(*COLUMNS, F.col("doc_id").alias("number"))
    else:
        rows = docs.select(*COLUMNS, suffix_dedup.text_key()).join(
            numbers, ["doc_id", "text_key"], "left").select(*COLUMNS, "number")
    cut = (suffix_dedup.remove_repeats(rows.select(F.col("number").alias("doc_id"), "text"),
                                       characters=True).where(F.col("n_removed") > 0)
           .select(F.col("doc_id").alias("__d"), F.decode("kept", "UTF-8").alias("kept")).distinct())
    text = F.coalesce("kept", "text")
    return (rows.join(cut, F.col("number") == F.col("__d"), "left")
            .select("doc_id", text.alias("text"), "lang", "source",
                    F.coalesce(F.length("kept").cast("long"), F.col("n_chars")).alias("n_chars"))
            .where(F.col("text").isNull() | (F.col("text") != "") | (F.col("n_chars") > 0)))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    out = mixing.mix(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token sequences."""
    return packing.pack(docs, vocabulary(BYTE_BPE), end_id=1)


STAGES = [("quality", good_documents), ("near_copies", without_near_copies),
          ("repeats", without_repeats), ("mixing", mixed), ("packing", packed)]
# hashes, trained weights and tokens have no SQL; tests compare small tables with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
