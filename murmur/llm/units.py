"""Whole texts to token ids through a unit cache.

Byte-level BPE splits a text by pattern before it merges. A single space or line feed between
two characters that are not white space always starts a new part there, so the text can be cut
at these places and equal parts need the library only once per worker. Texts with other
white space go to the library whole.
"""

from __future__ import annotations

import os
from functools import lru_cache
from sys import getsizeof

import numpy as np

CACHE_BYTES = 64 << 20  # parts and their ids; a batch of texts may add its own parts
END = "\f"  # marks an end id
WHOLE = "\v"  # marks a text, or the head of one, that is not a part after a space


def parts_of(text: str) -> list[str]:
    """Keys of parts that the library encodes independently.

    A key is the part without the space before it, the part itself if it starts with a line
    feed, or WHOLE and the part.
    """
    if not text:
        return []
    # printable characters hold no white space but the plain space
    if ("  " in text or "\n " in text or " \n" in text or "\n\n" in text
            or text[0] in " \n" or text[-1] in " \n"
            or not text.replace("\n", "").isprintable()):
        return [WHOLE + text]
    parts = text.replace("\n", " \n").split(" ")
    parts[0] = WHOLE + parts[0]
    return parts


class _Index(dict):
    """Numbers keys as they are first asked for."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        self[key] = number = len(self)
        return number


class ByteUnits:
    """Token ids of texts as ``encode_batch(texts, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        added = self._tokenizer.get_added_tokens_decoder()
        # a character of a byte-level token stands for one byte, an added token for its text
        self._bytes = np.zeros(self.size, np.int64)
        for token, number in vocabulary.items():
            self._bytes[number] = len(added[number].content.encode()) if number in added else len(token)
        self._clear()

    def _clear(self) -> None:
        self._index = _Index()
        self._ids = np.zeros(1 << 20, np.uint32)
        self._bounds = np.zeros(1 << 16, np.int64)
        self._known = 0
        self.held = 0  # bytes of the cache

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32)
                for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _store(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        at, end = self._known, self._known + len(sizes)
        while end + 1 > len(self._bounds):
            self._bounds = np.concatenate([self._bounds, np.zeros_like(self._bounds)])
        self._bounds[at + 1:end + 1] = self._bounds[at] + np.cumsum(sizes)
        while self._bounds[end] > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        self._ids[self._bounds[at]:self._bounds[end]] = ids
        self._known = end

    def _learn(self, keys: list[str]) -> None:
        """Encode new keys; those after a space are joined to texts, the ids then cut by bytes."""
        keys, self._index.new = keys, []
        self.held += sum(map(getsizeof, keys)) + 120 * len(keys)
        alone = [i for i, k in enumerate(keys) if k[0] == WHOLE]
        joined = [k if k[0] == "\n" else " " + k for k in keys if k[0] != WHOLE]
        texts = ["".join(joined[i:i + 256]) for i in range(0, len(joined), 256)]
        ids = np.concatenate([np.zeros(0, np.uint32), *self._encode(texts)])
        ends = np.cumsum(np.fromiter((len(k.encode()) for k in joined), np.int64, len(joined)))
        cut = np.searchsorted(np.cumsum(self._bytes[ids]), ends, side="right")
        sizes = np.zeros(len(keys), np.int64)
        after = np.ones(len(keys), bool)
        after[alone] = False
        sizes[after] = np.diff(cut, prepend=0)
        whole = self._encode([keys[i][1:] for i in alone])
        sizes[alone] = [len(w) for w in whole]
        out = np.empty(sizes.sum(), np.uint32)
        out[np.repeat(after, sizes)] = ids
        if whole:
            out[np.repeat(~after, sizes)] = np.concatenate(whole)
        self._store(out, sizes)
        self.held += out.nbytes

    def encode(self, texts: list[str | None], end_id: int | None = None
               ) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the bounds of each text's share; null counts as empty.

        ``end_id``, if given, follows each text and belongs to its share.
        """
        if self.held > CACHE_BYTES:
            self._clear()
        end: list[str] = []
        if end_id is not None:
            end = [f"{END}{end_id}"]
            if end[0] not in self._index:
                self._index[end[0]] = len(self._index)
                self._store(np.array([end_id], np.uint32), np.ones(1, np.int64))
        keys: list[str] = []
        sizes = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            parts = parts_of(text or "")
            sizes[i] = len(parts) + len(end)
            keys += parts
            keys += end
        at = np.fromiter(map(self._index.__getitem__, keys), np.int64, len(keys))
        if self._index.new:
            self._learn(self._index.new)
        lo = self._bounds[at]
        n = self._bounds[at + 1] - lo
        ends = np.cumsum(n)
        ids = self._ids[np.repeat(lo - ends + n, n) + np.arange(ends[-1] if len(n) else 0)]
        return ids, np.append(0, ends)[np.append(0, np.cumsum(sizes))]


@lru_cache(maxsize=2)
def byte_units(path: str) -> ByteUnits:
    """One encoder for each worker process."""
    return ByteUnits(path)
