"""Similarity conversions, rates and order-independent means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds and weights the reports agree on.
GAP_SIMILARITY = 0.55
STRONG_SIMILARITY = 0.75
SLOW_MS = 5000
VERBOSE_CHARS = 2000
TINY_CHARS = 150
EMBEDDING_USD_PER_TOKEN = 2e-8
# end of fixed values


def clamp01(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def sim_from_l2(distance: Column) -> Column:
    """Cosine similarity of unit vectors from their L2 distance."""
    return clamp01(1.0 - distance * distance / 2.0)


def sim_from_cosine_distance(distance: Column) -> Column:
    return clamp01(1.0 - distance.cast("double"))


def l2_from_score(score: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), 2.0 * (1.0 - score)))


def sim_band(sim: Column) -> Column:
    return (F.when(sim.isNull(), "none")
            .when(sim >= STRONG_SIMILARITY, "strong")
            .when(sim >= GAP_SIMILARITY, "moderate")
            .otherwise("weak"))


def exact_sum(x: Column, scale: int = 6) -> Column:
    """Sum that does not depend on the order partitions arrive in."""
    return F.sum(x.cast(f"decimal(20,{scale})")).cast("double")


def exact_mean(x: Column, scale: int = 6) -> Column:
    """Mean of the non-null values, order-independent; null when there are none."""
    return exact_sum(x, scale) / F.when(F.count(x) > 0, F.count(x))


def numeric_mean(x: Column, digits: int) -> Column:
    """Mean over the values that are numbers, half-even rounded."""
    return F.bround(exact_mean(x.try_cast("double")), digits)


def rate_pct(n: Column, d: Column) -> Column:
    """100*n/d, 0 when d is 0; unrounded."""
    return F.when(d == 0, F.lit(0.0)).otherwise(F.lit(100.0) * n / F.when(d != 0, d))


def rate_pct_1dp(n: Column, d: Column) -> Column:
    return F.bround(rate_pct(n, d), 1)


def cosine(a: str, b: str) -> Column:
    """Dot product of two equally long arrays, summed in index order as doubles."""
    return F.expr(
        f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), "
        f"cast(0.0 as double), (s, v) -> s + v)")
