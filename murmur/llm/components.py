"""Connected components of links between numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.session import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for each linked node; the component is its smallest node.

    Stars are turned to ever smaller centres: each node first passes the smallest node it knows
    to its larger neighbours, then to the smaller ones. Rounds are written to the shared
    folder; their number grows with the logarithm of the longest chain.
    """
    stars = materialize(
        links.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("centre"))
        .where(F.col("node") != F.col("centre")).distinct(), "links")
    while True:
        large = _round(stars, larger=True)
        turned = materialize(_round(large, larger=False), "links")
        mark = [d.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "centre"))).first()
                for d in (stars, turned)]
        stars = turned
        if mark[0] == mark[1]:
            break
    return stars.select("node", F.col("centre").alias("component"))


def _round(stars: DataFrame, larger: bool) -> DataFrame:
    """Links of each node's neighbours on one side, and of the node, to the smallest of them."""
    near = stars.select(F.col("node").alias("u"), F.col("centre").alias("v"))
    if larger:
        near = near.union(stars.select(F.col("centre").alias("u"), F.col("node").alias("v")))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("centre"))
    joined = near.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w"))
    if larger:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("node"), "centre")
    else:
        out = joined.select(F.col("v").alias("node"), "centre").union(
            least.select(F.col("u").alias("node"), "centre"))
    return out.where(F.col("node") != F.col("centre")).distinct()
