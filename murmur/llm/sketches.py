"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

The sketch of a text is the sorted array of the ``k`` smallest different hashes of its
shingles. Sketches of parts merge to the sketch of the whole, and two of them estimate how far
the shingle sets resemble or contain one another and how many different shingles there are.

Shingles are windows of up to ``SHINGLE`` words that end at each word, so the first words of a
text count as shorter windows and short texts have a sketch as well.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.arrow import shuffle_partitions

K = 128
SHINGLE = 5
SPACE = r"[\x20\x09-\x0D]+"
GROUP = 512  # sketches that one task merges for a key


def _let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def shingles(text: Column, shingle: int = SHINGLE) -> Column:
    """A hash for each window of words; the order and repeats of the text are kept."""
    words = F.array_remove(F.split(F.lower(text), SPACE), "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    # get() is null before the first word, and a null leaves the hash as it is
    return _let(hashes, lambda all_: F.transform(all_, lambda h, i: F.xxhash64(
        *[F.get(all_, i - back) for back in range(shingle - 1, 0, -1)], h)))


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """The ``k`` smallest different shingle hashes, ascending; empty for a text without words."""
    return bottom(F.array_distinct(shingles(F.coalesce(text, F.lit("")), shingle)), k)


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(hashes), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of two parts together."""
    return bottom(F.array_union(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all, 0 to 1; two empty sketches are alike."""
    return _let(merge(a, b, k), lambda both: F.when(F.size(both) == 0, 1.0).otherwise(
        F.size(F.array_intersect(F.array_intersect(a, b), both)) / F.size(both)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of different shingles; exact while the sketch is not full."""
    share = (F.element_at(a, -1) / 2.0 ** 64) + 0.5
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first text's shingles that the second has, 0 to 1."""
    common = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(
        F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """A sketch as a string: 16 hex digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def from_text(text: Column) -> Column:
    """The sketch that ``as_text`` wrote."""
    digits = F.filter(F.split(text, "(?<=\\G.{16})"), lambda x: x != "")
    return F.transform(digits, lambda x: F.conv(x, 16, -10).cast("long"))


def merge_parts(parts: DataFrame, keys: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """``keys`` and one sketch for all rows of each key; a null key is a key.

    Rows of a key merge in groups of about ``GROUP``, the results again, so that no task ever
    holds all sketches of a large key.
    """
    n = parts.count()
    rounds = max(1, math.ceil(math.log(max(n, 2), GROUP)))
    out = parts.select(*keys, F.coalesce(column, F.array().cast("array<bigint>")).alias(column))
    for left in range(rounds - 1, -1, -1):
        whole = bottom(F.array_distinct(F.flatten(F.collect_list(column))), k).alias(column)
        salt = F.pmod(F.xxhash64(column), F.lit(GROUP ** left))
        out = out.withColumn("__s", salt).groupBy(*keys, "__s").agg(whole).drop("__s")
    return out


def _ordered(docs: DataFrame, per_task: int = 4) -> DataFrame:
    """Rows dealt by ranges of ``doc_id``, each range with the first row of the next one.

    The heads of the ranges are quantiles of the ids, a fixed number for each shuffle
    partition; a range's ordinal is found by binary search among them.
    """
    n = shuffle_partitions(docs.sparkSession)
    probabilities = [i / (n * per_task) for i in range(1, n * per_task)]
    least, cuts = docs.agg(F.min("doc_id"), F.percentile_approx(
        "doc_id", probabilities, max(10_000, 4 * n * per_task))).first()
    heads = sorted({least, *(cuts or ())} - {None})
    halves = [1 << i for i in range(len(heads).bit_length() - 1, -1, -1)]
    starts = F.array(*[F.lit(h) for h in heads]).cast("array<bigint>")
    ordinal = F.aggregate(
        F.array(*[F.lit(h) for h in halves]), F.lit(0),
        lambda at, step: F.when(F.get(starts, at + step - 1) <= F.col("doc_id"),
                                at + step).otherwise(at))
    # rows without an id have no place in the order and are dealt by their text
    ordinal = F.when(F.col("doc_id").isNull(),
                     F.lit(-1) - F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")).otherwise(ordinal)
    rows = docs.withColumn("__r", ordinal)
    head = F.get(starts, F.col("__r") - 1) == F.col("doc_id")
    before = F.when(F.col("__r") == 1, F.lit(len(heads))).otherwise(F.col("__r") - 1)
    places = F.when(head, F.array(F.struct(F.col("__r").alias("range"), F.lit(0).alias("guest")),
                                  F.struct(before.alias("range"), F.lit(1).alias("guest")))
                    ).otherwise(F.array(F.struct(F.col("__r").alias("range"), F.lit(0).alias("guest"))))
    return (rows.select("doc_id", "text", F.inline(places))
            .repartition(n, "range"))


def compare_edited(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprint every whole text and its edited text, and compare them and the next one.

    In the edited text the last half of the code points (rounded down) is replaced by the first
    as many of the next document in ascending ``doc_id``; after the last comes the first.
    Returns ``doc_id, n_chars, edited, sketch, edited_sketch, near_edited, near_next``. A null
    text counts as empty. Rows of equal ``doc_id`` follow each other by text; rows whose
    ``doc_id`` is null have an empty next document. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("range").orderBy("guest", "doc_id", "text")
    follows = lambda c, empty: F.when(
        F.col("doc_id").isNull(), empty).otherwise(F.coalesce(F.lead(c).over(order), empty))
    none = F.array().cast("array<bigint>")
    placed = (_ordered(rows).withColumn("sketch", sketch(F.col("text"), k, shingle))
              .withColumn("next", follows("text", F.lit("")))
              .withColumn("next_sketch", follows("sketch", none)).where(F.col("guest") == 0))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half),
                      F.substring("next", F.lit(1), half))
    return (placed.select("doc_id", F.length("text").cast("long").alias("n_chars"),
                          edited.alias("edited"), "sketch", "next_sketch")
            .withColumn("edited_sketch", sketch(F.col("edited"), k, shingle))
            .withColumn("near_edited", resemblance(F.col("sketch"), F.col("edited_sketch"), k))
            .withColumn("near_next", resemblance(F.col("sketch"), F.col("next_sketch"), k))
            .drop("next_sketch"))
