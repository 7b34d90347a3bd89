"""Which of many terms occur in which texts, without pairing texts with terms.

Terms are cut into blocks of bounded size. A block becomes one automaton that finds all of its terms
in a single pass over a text; the texts are scanned once for each block, in place, so neither texts
nor pairs are shuffled. Nearly every list is one block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.scale import scan_blocks

BLOCK_BYTES = 8 << 20  # of terms and what belongs to them


class Automaton:
    """All occurrences of some distinct, non-empty terms in one pass over a text."""

    def __init__(self, terms: list[str]):
        import ahocorasick

        self.terms = terms
        self._trie = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            self._trie.add_word(term, i)
        if terms:
            self._trie.make_automaton()

    def found(self, text: str | None) -> list[int]:
        """Numbers of the terms that occur, each once."""
        if not text or not self.terms:
            return []
        return list({i for _, i in self._trie.iter(text)})

    def ends(self, text: str | None) -> dict[int, tuple[int, int]]:
        """First and last position where each term ends."""
        out: dict[int, tuple[int, int]] = {}
        if text and self.terms:
            for at, i in self._trie.iter(text):
                out[i] = (out[i][0] if i in out else at, at)
        return out


def scan(texts: DataFrame, listed: DataFrame, build: Callable, kernel: Callable, schema: str) -> DataFrame:
    """``kernel(built, batch)`` over all texts, for what ``build`` makes of each block of terms."""
    def batchwise(built, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield kernel(built, batch)

    return scan_blocks(texts, listed, BLOCK_BYTES, lambda rows: [r.asDict(recursive=True) for r in rows],
                       build, batchwise, schema)


def term_hits(texts: DataFrame, text_id: str, text_col: str, terms: DataFrame,
              term_col: str = "term") -> DataFrame:
    """(text_id, term) for every distinct lower-cased term that is a substring of the text."""
    listed = (terms.select(F.lower(F.col(term_col)).alias("term")).where(F.length("term") > 0).distinct()
              .withColumn("__bytes", F.octet_length("term") + 64))
    low = texts.select(F.col(text_id).alias("id"), F.lower(F.col(text_col)).alias("low"))

    def kernel(built: Automaton, batch: pd.DataFrame) -> pd.DataFrame:
        out = [(key, built.terms[i]) for key, text in zip(batch["id"], batch["low"]) for i in built.found(text)]
        return pd.DataFrame(out, columns=["id", "term"])

    kind = texts.schema[text_id].dataType.simpleString()
    return scan(low, listed, lambda rows: Automaton([r["term"] for r in rows]), kernel,
                f"id {kind}, term string").withColumnRenamed("id", text_id)
