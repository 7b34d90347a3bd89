"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

A BPE encoding is valid if and only if each pair of neighbouring tokens is the encoding of the
pair's own text. So the encoding of a prefix ends in the one vocabulary token that fits the
last token of the prefix before it, and its count is that prefix's count and one. The table
answers how many tokens any prefix has and where a budget ends, without encoding again.

No token joins two places in a text: before a space that follows another character, and around
a line feed (both follow from the vocabulary and are checked). Between them lie units; the table
of a text is that of its units with counts carried on, so a unit is worked out once a worker.
Each new unit's last count is compared with the library's own; should they ever differ, its
prefixes are counted by the library one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix
from sys import getsizeof

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.arrow import pieces

CACHE_BYTES = 96 << 20  # units and their tables; a batch of texts may add its own units
FITS = 200_000  # pairs of tokens
LONG_UNIT = 256  # characters; tables of longer units are made anew for each batch
SPACE = "▁"
TABLE = "doc_id long, n_bytes long, n_chars long, n_tokens long, steps binary"
_UNITS = re.compile("\n|[▁ ]+[^▁ \n]*|[^▁ \n]+")


class PrefixTables:
    """Prefix tables as bytes: the change of the count (-128 to 127) at each character."""

    def __init__(self, path: str):
        import sentencepiece

        self._library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces_ = [self._library.id_to_piece(i) for i in range(self._library.get_piece_size())]
        special = (self._library.is_control, self._library.is_unknown, self._library.is_unused,
                   self._library.is_byte)
        self._ids = {p: i for i, p in enumerate(pieces_) if not any(f(i) for f in special)}
        if any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) for p in self._ids):
            raise ValueError("this vocabulary joins words or lines; its texts have no units")
        # endings of tokens, so that a search backwards stops where no token goes on
        self._endings = {p[i:]: False for p in self._ids for i in range(len(p))}
        self._endings.update(dict.fromkeys(self._ids, True))
        self._fits: dict[tuple[str, str], bool] = {}
        self._cache: dict[str, bytes] = {}
        self.held = 0  # bytes of the cache

    def _count(self, texts: list[str]) -> list[int]:
        """Library's counts of texts that follow a line feed, so that no space is put before."""
        out = self._library.encode(["\n" + t for t in texts], num_threads=1)
        return [len(ids) - 2 for ids in out]

    def _fit(self, left: str, right: str) -> bool:
        """Whether the two tokens stay as they are where they meet."""
        ids = self._library.encode("\n" + left + right, num_threads=1)[2:]
        if len(self._fits) > FITS:
            self._fits.clear()
        self._fits[left, right] = known = ids == [self._ids[left], self._ids[right]]
        return known

    def table(self, unit: str, counts: list[int] | None = None,
              last: list[str] | None = None) -> list[int]:
        """Counts of the prefixes of a unit that has no line feed, by dynamic programming.

        ``counts`` and ``last`` hold what is known of its first prefixes and are continued.
        """
        counts = [0] if counts is None else counts
        last = [""] if last is None else last
        endings, fits = self._endings, self._fits
        for end in range(len(counts), len(unit) + 1):
            found = []
            for start in range(end - 1, -1, -1):
                whole = endings.get(unit[start:end])
                if whole is None:
                    break
                if whole:
                    found.append(start)
            for start in reversed(found):
                left, token = last[start], unit[start:end]
                if not left or (fits[left, token] if (left, token) in fits
                                else self._fit(left, token)):
                    counts.append(counts[start] + 1)
                    last.append(token)
                    break
            else:  # no token for the character: its bytes, which join nothing
                counts.append(counts[-1] + len(unit[end - 1].encode()))
                last.append("")
        return counts

    def _learn(self, units: list[str]) -> None:
        lines = [u for u in units if u == "\n"]
        units = [u for u in units if u != "\n"]
        before, counts, last = "", [0], [""]
        for unit, want in zip(units, self._count(units)):
            # units come sorted: a prefix shared with the one before is worked out already
            shared = len(commonprefix((before, unit)))
            last = last[:shared + 1]
            before, counts = unit, self.table(unit, counts[:shared + 1], last)
            if counts[-1] != want:
                before = ""
                counts = [0, *self._count([unit[:i] for i in range(1, len(unit) + 1)])]
            self._cache[unit] = bytes([(b - a) & 255 for a, b in zip(counts, counts[1:])])
        for line in lines:
            self._cache[line] = b"\x01"

    def steps(self, texts: list[str | None]) -> list[bytes]:
        """One byte for each character of each text; null counts as empty."""
        if self.held > CACHE_BYTES:
            self._cache.clear()
            self.held = 0
        split = [units_of(t or "") for t in texts]
        cache = self._cache
        new = set().union(*split).difference(cache)
        if new:
            self._learn(sorted(new))
            self.held += sum(getsizeof(u) + getsizeof(cache[u]) + 120 for u in new)
        out = []
        for units in split:
            raw = b"".join(map(cache.__getitem__, units))
            # the first unit starts with a space that is not in the text
            out.append(raw[:0] if not raw else
                       ((raw[0] + raw[1]) & 255).to_bytes() + raw[2:] if len(raw) > 1 else raw)
        for unit in new:
            if len(unit) > LONG_UNIT:
                self.held -= getsizeof(unit) + getsizeof(cache.pop(unit)) + 120
        return out


def units_of(text: str) -> list[str]:
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " " or SPACE in text or "\n" in text:
        return _UNITS.findall(SPACE + text.replace(" ", SPACE))
    return (SPACE + text.replace(" ", " " + SPACE)).split(" ")


@lru_cache(maxsize=2)
def prefix_tables(path: str) -> PrefixTables:
    return PrefixTables(path)


def _tables(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = prefix_tables(path)
        for batch in pieces(batches, "text", 4 << 20):
            texts = batch.column("text").to_pylist()
            steps = tables.steps(texts)
            yield pa.record_batch(
                [batch.column("doc_id"),
                 pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                 pa.array(map(len, steps), pa.int64()),
                 pa.array([int(np.frombuffer(s, np.int8).sum(dtype=np.int64)) for s in steps],
                          pa.int64()),
                 pa.array(steps, pa.binary())],
                ["doc_id", "n_bytes", "n_chars", "n_tokens", "steps"])
    return run


def count_prefixes(docs: DataFrame, model: str) -> DataFrame:
    """Prefix table of each whole text: ``doc_id, n_bytes, n_chars, n_tokens, steps``.

    ``steps`` has one signed byte for each character (code point), the change of the token count
    there; their sum up to a place is the exact count of that prefix, and ``n_tokens`` that of
    the text, without begin, end or added tokens. A null text counts as empty: no steps, 0
    tokens. Ids may be null or repeated; every row gets its own table. Nothing is cut short.
    """
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(_tables(model), TABLE))


def counts(steps: bytes) -> np.ndarray:
    """Token counts of all prefixes, the empty one included."""
    return np.append(0, np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64))


def longest_prefix(tables: DataFrame, budget: int) -> DataFrame:
    """``doc_id, fits``: characters of the longest prefix of at most ``budget`` tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = [int(np.flatnonzero(counts(s) <= budget)[-1])
                    for s in batch.column("steps").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(fits, pa.int64())],
                                  ["doc_id", "fits"])
    return tables.select("doc_id", "steps").mapInArrow(run, "doc_id long, fits long")


def prefix_counts(tables: DataFrame, every: int) -> DataFrame:
    """``doc_id, n_chars, n_tokens`` of the prefixes of each multiple of ``every`` characters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, s in enumerate(batch.column("steps").to_pylist()):
                at = counts(s)[::every]
                yield pa.record_batch(
                    [batch.column("doc_id").take(pa.array([i] * len(at), pa.int64())),
                     pa.array(np.arange(len(at)) * every), pa.array(at)],
                    ["doc_id", "n_chars", "n_tokens"])
    return tables.select("doc_id", "steps").mapInArrow(
        run, "doc_id long, n_chars long, n_tokens long")
