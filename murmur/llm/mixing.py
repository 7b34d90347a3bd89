"""Mixing sources to target weights by a splitting tree over blocks.

Documents of a source are dealt by hash into blocks. A source takes whole passes over its
blocks in permuted order until its target is reached; the block that holds the target is taken
up to it, cutting one document. The numbers of blocks that the sources contribute are split
among output shards by a binary tree: a node draws the left half's share of its blocks from the
multivariate hypergeometric distribution, so every shard gets an exact number of blocks, every
source's quota is met exactly, and each shard is a fair sample of the mix. A shard then draws
its share of each source's permuted blocks, which are disjoint, and shuffles inside itself.
Every node is seeded by its place, so reruns agree and a lost task draws the same again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.session import materialize

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
BLOCK_WORDS = 20_000
MOST_BLOCKS = 1 << 16  # of one source; beyond it blocks grow
SHARD_BLOCKS = 64
SEED = 11


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            repeats: int = REPEATS) -> DataFrame:
    """Add ``rank, weight, target`` to rows of ``source, source_size``.

    Sources stand by code point, null last, and take ``weights`` in turn. They share ``share``
    of all sizes by weight; a target stops at ``repeats`` times the source's size, and the
    excess is shared again until none is above. In the order of size per weight the sources that
    stop come first, so the level of the others is found in one pass over the sources.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("rank", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]),
                               ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    cap = (F.col("source_size") * repeats).cast("double")
    by_level = everything.orderBy(cap / F.col("weight"), "rank")
    before = F.coalesce(F.sum(cap).over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    level = (share * F.sum("source_size").over(everything) - before) / weight
    open_ = ranked.withColumn("level", F.when(cap / F.col("weight") >= level, level))
    shared = F.max("level").over(everything)
    return (open_.withColumn("target", F.least(cap, F.coalesce(shared * F.col("weight"), cap)))
            .drop("level"))


def split_tree(lo: int, hi: int, counts: np.ndarray, total: int, shards: int, width: int,
               seed: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Exact block counts of nodes of at most ``width`` shards below (lo, hi)."""
    if hi - lo <= width:
        yield lo, hi, counts
        return
    mid = (lo + hi) // 2
    edge = lambda shard: shard * total // shards
    draw = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(
        counts, edge(mid) - edge(lo), method="marginals")
    yield from split_tree(lo, mid, draw, total, shards, width, seed)
    yield from split_tree(mid, hi, counts - draw, total, shards, width, seed)


def _split(width: int, seed: int):
    def run(node: pd.DataFrame) -> pd.DataFrame:
        node = node.sort_values("rank")
        head = node.iloc[0]
        out = [pd.DataFrame({"lo": lo, "hi": hi, "rank": node["rank"], "quota": counts,
                             "total": head.total, "shards": head.shards})[counts > 0]
               for lo, hi, counts in split_tree(int(head.lo), int(head.hi), node.quota.to_numpy(),
                                                int(head.total), int(head.shards),
                                                width or int(np.sqrt(head.shards)) + 1, seed)]
        return pd.concat(out)
    return run


def shard_quotas(quotas: DataFrame, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """``rank, shard, quota, first``: blocks of each source in each shard, and those before.

    The upper half of the tree is one task with a row for each source, the lower half as many
    tasks as it has leaves, so neither holds all sources and shards at once.
    """
    node = "lo long, hi long, rank int, quota long, total long, shards long"
    total = F.sum("quota").over(Window.partitionBy(F.lit(0)))
    root = quotas.where(F.col("quota") > 0).select(
        F.lit(0).cast("long").alias("lo"), F.ceil(total / shard_blocks).alias("hi"), "rank",
        F.col("quota").cast("long").alias("quota"), total.alias("total"),
        F.ceil(total / shard_blocks).alias("shards"))
    leaves = (root.groupBy("lo").applyInPandas(_split(0, seed), node)
              .groupBy("lo").applyInPandas(_split(1, seed), node))
    before = (Window.partitionBy("rank").orderBy("lo")
              .rowsBetween(Window.unboundedPreceding, -1))
    return leaves.select("rank", F.col("lo").alias("shard"), "quota",
                         F.coalesce(F.sum("quota").over(before), F.lit(0)).alias("first"))


def plan(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """What the mix takes of each document.

    Returns a row for each row of ``docs``: ``doc_id, source, size, text_key`` (hash of the text),
    ``source_size, target, taken`` (words, repeats counted) and ``copies``, an array of ``copy, shard, words``, empty if the
    mix takes nothing. A null text has size 0 and a null source is a source. Sizes come from
    whole texts; a document is taken at most twice, so ``taken`` is at most twice its size.
    """
    sizes = materialize(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size"),
        F.xxhash64("text").alias("text_key")), "sizes")
    sources = materialize(
        targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
        .withColumn("blocks", F.greatest(F.lit(1), F.least(
            F.lit(MOST_BLOCKS), F.ceil(F.col("source_size") / block_words)))), "sources")
    key = F.xxhash64(F.lit(seed), "doc_id", "size")
    placed = (sizes.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
              .select("doc_id", "d.source", "size", "text_key", "source_size", "target", "rank",
                      F.pmod(key, "blocks").alias("block"), key.alias("key")))
    passes = F.array(*[F.lit(c) for c in range(REPEATS)])
    units = (placed.groupBy("rank", "block").agg(F.sum("size").alias("words"),
                                                 F.max("target").alias("target"))
             .where(F.col("words") > 0).withColumn("copy", F.explode(passes)))
    order = Window.partitionBy("rank").orderBy(
        "copy", F.xxhash64(F.lit(seed + 1), "rank", "copy", "block"), "block")
    units = (units.withColumn("nth", F.row_number().over(order) - 1)
             .withColumn("before", F.coalesce(F.sum("words").over(
                 order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             .withColumn("take", F.least("words", F.round("target").cast("long") - F.col("before")))
             .where(F.col("take") > 0).select("rank", "block", "copy", "nth", "take"))
    units = materialize(units, "blocks")
    quotas = units.groupBy("rank").agg(F.count(F.lit(1)).alias("quota"))
    drawn = (shard_quotas(quotas, seed=seed)
             .withColumn("nth", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("quota") - 1)))
             .select("rank", "shard", F.col("nth").cast("int").alias("nth")))
    blocks = (units.join(drawn, ["rank", "nth"]).groupBy("rank", "block").agg(
        F.array_sort(F.collect_list(F.struct("copy", "shard", "take"))).alias("drawn")))
    inside = Window.partitionBy("rank", "block").orderBy("key", "doc_id", "size", "text_key")
    start = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = placed.withColumn("start", start).join(blocks, ["rank", "block"], "left")
    words = lambda u: F.greatest(F.lit(0), F.least(F.col("size"), u["take"] - F.col("start")))
    copies = F.filter(
        F.transform(F.coalesce("drawn", F.array()), lambda u: F.struct(
            u["copy"].alias("copy"), u["shard"].alias("shard"), words(u).alias("words"))),
        lambda u: u["words"] > 0)
    return joined.withColumn("copies", copies).select(
        "doc_id", "source", "size", "text_key", "source_size", "target",
        F.aggregate("copies", F.lit(0).cast("long"), lambda n, u: n + u["words"]).alias("taken"),
        "copies")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mixed documents: ``docs`` rows as often as taken, with ``shard`` and ``place``.

    The one document of a source at which its target ends keeps its first words. Rows lie
    together by shard, in shuffled order inside it. Rows of equal ``doc_id`` are told apart by
    their source, size and text; where all of these agree, one stands for the other. Documents
    without words are not taken.
    """
    known = ["__d", "__s", "__n", "__t"]

    def keyed(df: DataFrame, *values: Column) -> DataFrame:
        df = df.withColumns(dict(zip(known, values)))
        return df.withColumn("__nth", F.row_number().over(Window.partitionBy(*known).orderBy(F.lit(0))))

    rows = keyed(docs, F.col("doc_id").cast("long"), F.col("source"), n_words(F.col("text")), F.xxhash64("text"))
    taken = keyed(plan(docs, block_words, seed), *map(F.col, ("doc_id", "source", "size", "text_key"))).select(
        *known, "__nth", F.col("copies").alias("__copies")).where(F.size("__copies") > 0)
    same = [rows[c].eqNullSafe(taken[c]) for c in known] + [rows["__nth"] == taken["__nth"]]
    out = (rows.join(taken, reduce(lambda x, y: x & y, same))
           .select(*[rows[c] for c in docs.columns], rows["__n"], "__copies")
           .withColumn("__c", F.explode("__copies")))
    with_gap = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORDS), F.lit(0))
    text = F.when(F.col("__c.words") < F.col("__n"),
                  F.array_join(F.slice(with_gap, F.lit(1), F.col("__c.words").cast("int")), "")
                  ).otherwise(F.col("text"))
    place = F.xxhash64(F.lit(seed + 2), "__c.shard", "__c.copy", "doc_id")
    return (out.select(*[text.alias(c) if c == "text" else c for c in docs.columns],
                       F.col("__c.shard").alias("shard"), place.alias("place"))
            .repartition("shard").sortWithinPartitions("shard", "place"))
