"""How far the sources of a language differ in their words, exactly, in whole numbers.

Every kept word has a smoothed share in every (language, source) group, and a share depends on the
group and the word's count alone. So the distance of two groups follows from their joint table:
how many words have count c in one and d in the other. A block of words gives a matrix with a row
for each word and an indicator column for each (group, count level), level zero included; its
transpose times itself holds the joint tables of all group pairs, and each table is priced with
the difference of the two shares. Words are dealt into blocks by hash, groups too where a language
has more than ``GROUPS`` sources; a block pair is a task of bounded size.

Null text, language and source count as empty strings; repeated rows count each; other columns
are not read. A language that keeps no word gives its sources distance 0 and no word rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.arrow import pieces
from murmur.session import materialize

# Fixed values of the audit.
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
MIN_DOCS = 30
UNIT = 1_000_000_000
PRIOR = 5
TOP_TERMS = 50
# end of fixed values

TERMS, GROUPS = 512, 32  # of a block; sums of a block stay exact in single precision
HELD_BYTES = 48 << 20  # counts that one task holds back
LONG_TEXT = 1 << 20
COUNTS = "lang string, source string, term string, n long, docs long"


class _Held:
    """Word and document counts by group, handed on once they fill their space."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def add(self, group: tuple[str, str], text: str) -> None:
        counts, docs = self.groups.setdefault(group, (Counter(), Counter()))
        text = text.encode().lower().decode()  # bytes: A-Z alone
        if len(text) <= LONG_TEXT:
            found = TERM.findall(text)
            counts.update(found)
            docs.update(set(found))
            return
        seen: set[str] = set()
        matches = (m[0] for m in TERM.finditer(text))
        while part := list(islice(matches, 1 << 16)):
            counts.update(part)
            seen.update(part)
        docs.update(seen)

    def size(self) -> int:
        return sum(200 * len(c) + 4 * sum(map(len, c)) for c, _ in self.groups.values())

    def rows(self) -> pa.RecordBatch:
        """Counts so far, and a row without a word for every group."""
        out: list[tuple] = []
        for (lang, source), (counts, docs) in self.groups.items():
            out.append((lang, source, None, 0, 0))
            out += [(lang, source, t, n, docs[t]) for t, n in counts.items()]
        self.groups = {}
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        columns = zip(*out) if out else [[]] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "source", "term", "n", "docs"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, text = _Held(), 0
    for batch in pieces(batches, "text"):
        for t, lang, source in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "source"))):
            held.add((lang, source), t)
            text += len(t)
        if text > HELD_BYTES // 8:  # counts grow more slowly than their texts
            text = 0
            if held.size() > HELD_BYTES:
                yield held.rows()
    yield held.rows()


def count_terms(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``; a row with a null term for every group."""
    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return rows.mapInArrow(_count, COUNTS).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str):
    """Smoothed share in parts of ``UNIT``, a whole number from 1."""
    return F.expr(f"1 + (CAST({UNIT} AS DECIMAL(10,0)) * CAST({count} + {PRIOR} AS DECIMAL(20,0))) "
                  f"div CAST({total} AS DECIMAL(20,0))")


class _Block:
    """Indicator columns of some groups over the words of a block."""

    def __init__(self, counts: np.ndarray, totals: list[int]):
        levels, self.start = [], [0]
        self.price: list[np.ndarray] = []
        rows = np.arange(len(counts))
        for column, total in zip(counts.T, totals):
            values, codes = np.unique(column, return_inverse=True)
            self.price.append(np.array(
                [1 + UNIT * (int(v) + PRIOR) // total for v in values], np.int64))
            one = np.zeros((len(counts), len(values)), np.float32)
            one[rows, codes] = 1
            levels.append(one)
            self.start.append(self.start[-1] + len(values))
        self.columns = levels
        self.matrix = np.concatenate(levels, axis=1)
        self.prices = np.concatenate(self.price)
        self.nothing = np.array([1 + UNIT * PRIOR // t for t in totals], np.int64)  # share of count zero

    def distances(self, i: int, other: _Block, absent: int) -> np.ndarray:
        """Of group i to each group of the other block, over these words and ``absent`` more that
        occur in no group of either."""
        joint = (self.columns[i].T @ other.matrix).astype(np.int64)
        joint *= np.abs(self.price[i][:, None] - other.prices)
        return (np.add.reduceat(joint.sum(0), other.start[:-1])
                + absent * np.abs(self.nothing[i] - other.nothing))


def _price(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    lang, _, a, b = key
    groups = rows.drop_duplicates("source").sort_values("source")
    names = groups["source"].to_numpy()
    words = rows[rows["term"].notna()]
    out = []
    size = int(rows["block_words"].max())
    if size:
        at, terms = pd.factorize(words["term"])
        counts = np.zeros((len(terms), len(names)), np.int64)
        counts[at, np.searchsorted(names, words["source"].to_numpy())] = words["n"]
        totals, block = groups["total"].tolist(), groups["block"].to_numpy()
        left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
        first = _Block(counts[:, left], [totals[i] for i in left])
        second = first if a == b else _Block(counts[:, right], [totals[i] for i in right])
        for i in range(len(left)):
            values = first.distances(i, second, size - len(terms))
            for j in range(i + 1 if a == b else 0, len(right)):
                out.append((lang, names[left[i]], names[right[j]], int(values[j])))
    return pd.DataFrame(out, columns=["lang", "one", "two", "value"])


def group_table(counts: DataFrame, cells: DataFrame, kept: DataFrame) -> DataFrame:
    """A row for each group: smoothed totals of it and its language, words kept, blocks."""
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("words"), F.sum("lang_n").alias("lang_sum"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("sum"))
    groups = counts.where(F.col("term").isNull()).select("lang", "source")
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    words = zero("words")
    return (groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").join(sizes, "lang")
            .select("lang", "source", words.alias("words"), (zero("sum") + PRIOR * words).alias("total"),
                    (zero("lang_sum") + PRIOR * words).alias("lang_total"),
                    F.ceil(words / TERMS).alias("term_blocks"), F.ceil(F.col("sources") / GROUPS).alias("blocks"))
            .withColumn("block", F.pmod(F.xxhash64("source"), "blocks")))


def pair_distances(cells: DataFrame, kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, one, two, value`` of each pair of sources, once."""
    used = groups.where(F.col("words") > 0)
    facts = used.select("lang", "source", "total", "block", "blocks", "term_blocks")
    term_block = F.pmod(F.xxhash64("term"), "term_blocks").alias("term_block")
    none, zero = F.lit(None), F.lit(0).cast("long")
    entries = cells.join(facts, ["lang", "source"]).select(
        *facts.columns, term_block, zero.alias("block_words"), "term", "n")
    # every block knows its number of words and all groups, also those without any of them
    sizes = kept.join(used.select("lang", "term_blocks").distinct(), "lang").groupBy("lang", term_block).agg(
        F.count(F.lit(1)).alias("block_words"))
    marks = facts.join(sizes, "lang").select(
        *facts.columns, "term_block", "block_words", none.cast("string").alias("term"), zero.alias("n"))
    other = F.explode(F.sequence(zero, F.col("blocks") - 1))
    met = entries.unionByName(marks).withColumn("other", other).select(
        "lang", "term_block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"),
        "source", "block", "total", "block_words", "term", "n")
    priced = met.groupBy("lang", "term_block", "a", "b").applyInPandas(
        _price, "lang string, one string, two string, value long")
    empty = groups.where(F.col("words") == 0).select("lang", F.col("source").alias("one"))
    wordless = empty.join(empty.select("lang", F.col("one").alias("two")), "lang").where(
        F.col("one") < F.col("two")).withColumn("value", zero)
    return priced.unionByName(wordless).groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances to the other sources of the language
    (part ``pair``) and the words a source uses more than its language does (part ``term``)."""
    counts = materialize(count_terms(docs), "counts")
    words = counts.where(F.col("term").isNotNull())
    kept = materialize(words.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
                       .where(F.col("docs") >= MIN_DOCS).drop("docs"), "kept")
    cells = materialize(words.drop("docs").join(kept, ["lang", "term"]), "cells")
    groups = materialize(group_table(counts, cells, kept), "groups")

    pairs = pair_distances(cells, kept, groups)
    ends = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")),
                             F.struct(F.col("two").alias("source"), F.col("one").alias("item")))).alias("e")
    pairs = pairs.select("lang", ends, "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    over = share("n", "total") - share("lang_n", "lang_total")
    terms = (cells.join(groups, ["lang", "source"]).where(F.col("n") > 0)
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), over.alias("value"))
             .where(F.col("value") > 0))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [pairs.withColumn("rank", F.row_number().over(order)),
              terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP_TERMS)]
    return ranked[0].unionByName(ranked[1])
