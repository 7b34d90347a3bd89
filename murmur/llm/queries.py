"""Registered queries of the corpus operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm import (
    byte_bpe,
    divergence,
    licences,
    mixing,
    neighbours,
    packing,
    quality,
    simhash,
    sketches,
    suffix_dedup,
    token_counts,
    token_files,
    whitening,
)
from murmur.llm.oracles import DIVERGENCE, REPEATS
from murmur.session import scratch_dir
from murmur.sources.tables import table

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
MULTI_BPE = "byte_bpe_multi_50k.tiktoken"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op10_suffix_dedup": REPEATS, "op13_divergence": DIVERGENCE}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; the package lies on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"),
                        "component_id")


@query
def op2_token_files(spark, sf_dir):
    files = token_files.write_tokens(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE),
                                     scratch_dir(spark, "tokens"), end_id=2)
    return token_files.read_tokens(files).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op3_token_counts(spark, sf_dir):
    counted = token_counts.count_prefixes(table(spark, sf_dir, "documents"), vocabulary(PIECE_BPE))
    return counted.select("doc_id", "n_bytes", "n_tokens",
                          (F.col("n_tokens") > 4096).alias("over_limit"))


@query
def op4_mixing(spark, sf_dir):
    return mixing.plan(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


@query
def op5_licences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return licences.scan(docs, licences.fit(spark, docs))


@query
def op6_fingerprints(spark, sf_dir):
    return sketches.compare_edited(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        sketches.as_text(F.col("sketch")).alias("fingerprint"),
        sketches.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited", "near_next")


@query
def op7_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs)).withColumn("keep", F.col("score") >= 0.5)


@query
def op8_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


@query
def op9_packing(spark, sf_dir):
    packed = packing.pack(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE), end_id=1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


@query
def op10_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_whitening(spark, sf_dir):
    white = whitening.whiten(table(spark, sf_dir, "embeddings"), components=4)
    return white.select("vec_id", "component", "n", F.col("deviation").cast("long").alias("deviation"),
                        "whitened", "explained", "identity_error")


@query
def op12_byte_bpe(spark, sf_dir):
    import public_tokenizers

    ranks = vocabulary(MULTI_BPE)
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    ids = F.col("ids")
    return byte_bpe.decode(encoded, ranks).select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", ids.cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op13_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))
