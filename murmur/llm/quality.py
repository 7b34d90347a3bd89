"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each document.
Expectation-maximisation over the counts of vote patterns, which cover all documents, estimates
how often each labeller is right and the probability of every pattern. These posterior labels
train a hashed linear scorer on a bounded sample, and the scorer judges every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.arrow import pieces

SAMPLE = 4000  # documents that train the scorer
BITS = 18
SEED = 3
VOTED = "doc_id long, votes string"
SCORED = "doc_id long, score double"
NOTHING, GOOD, BAD = "-", "g", "b"

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_MARKS = bytes(set(range(33, 127)) - set(_LETTERS) - set(range(48, 58)))
_DIGITS = bytes(range(48, 58))


def measures(text: bytes) -> dict[str, float]:
    """What the labellers look at; shares are 0 where there is nothing to share."""
    words = text.split()
    lines = [x for x in map(bytes.strip, text.split(b"\n")) if x]
    n, n_words, n_lines = len(text), len(words), len(lines)
    letters = n - len(text.translate(None, _LETTERS))
    short = sum(1 for w in words if len(w) <= 3)
    return {
        "words": n_words,
        "marks": (n - len(text.translate(None, _MARKS))) / max(n, 1),
        "upper": (n - len(text.translate(None, _UPPER))) / max(letters, 1),
        "digits": (n - len(text.translate(None, _DIGITS))) / max(n, 1),
        "cells": text.count(b"|") / max(n_words, 1),
        "shouts": text.count(b"!") / max(n_words, 1),
        "repeated": 1 - len(set(lines)) / n_lines if n_lines else 0.0,
        "variety": len(set(words)) / max(n_words, 1) ** 0.5,
        "ends": sum(1 for x in lines if x[-1:] in b".!?:\"'") / max(n_lines, 1),
        "length": sum(map(len, words)) / max(n_words, 1),
        "short": short / max(n_words, 1),
        "echo": sum(map(eq, words, words[1:])) / max(n_words, 1),
    }


def _between(x: float, good: tuple[float, float], fair: tuple[float, float]) -> str:
    if good[0] <= x <= good[1]:
        return GOOD
    return NOTHING if fair[0] <= x <= fair[1] else BAD


def votes(m: dict[str, float]) -> str:
    """One letter for each labeller; on a few words only the plainest ones speak."""
    if not m["words"]:
        return BAD * 10
    few = m["words"] < 40
    return "".join([
        _between(m["marks"], (0, 0.08), (0, 0.3 if few else 0.12)),
        _between(m["upper"], (0, 0.12), (0, 0.4)),
        _between(m["cells"], (0, 0.02), (0, 0.1)),
        _between(m["shouts"], (0, 0.05), (0, 0.4)),
        _between(m["repeated"], (0, 0.1), (0, 0.35)),
        NOTHING if few else _between(m["variety"], (8, 1e9), (4, 1e9)),
        _between(m["ends"], (0.95, 1), (0.6 if not few else 0, 1)),
        NOTHING if few else _between(m["length"], (4.3, 6.4), (4.1, 7)),
        NOTHING if few else _between(m["short"], (0.15, 0.46), (0.08, 0.49)),
        _between(m["echo"], (0, 0.03), (0, 0.2)),
    ])


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        texts = batch.column("text").to_pylist()
        yield pa.record_batch(
            [batch.column("doc_id"),
             pa.array([votes(measures((t or "").encode())) for t in texts])], ["doc_id", "votes"])


def estimate(patterns: list[str], counts: np.ndarray, rounds: int = 100
             ) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation: P(good | pattern), P(vote | class) by labeller, P(good).

    Votes are taken as independent given the class, and no vote says nothing about it. It
    starts from the share of good votes.
    """
    if not patterns:
        return np.zeros(0), np.zeros((0, 2, 2)), 0.5
    one = np.array([[[v == GOOD, v == BAD] for v in p] for p in patterns], float)
    good = (one[:, :, 0].sum(axis=1) + 1) / (one.sum(axis=(1, 2)) + 2)
    for _ in range(rounds):
        weight = np.stack([1 - good, good], axis=1) * counts[:, None]
        table = np.einsum("pc,plv->lcv", weight, one) + 1
        table /= table.sum(axis=2, keepdims=True)
        prior = (weight[:, 1].sum() + 1) / (counts.sum() + 2)
        log = np.einsum("plv,lcv->pc", one, np.log(table)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return good, table, float(prior)


def features(text: bytes, bits: int = BITS) -> np.ndarray:
    """Hashed features: different words, and the measures on a coarse scale."""
    m = measures(text)
    scale = {"words": 1.0, "variety": 1.0, "length": 2.0}
    stats = [b"\0%s=%d" % (k.encode(), round(scale.get(k, 20.0) * (np.log1p(v) if k == "words" else v)))
             for k, v in m.items()]
    words = set(text.split())
    got = np.fromiter(map(zlib.crc32, [*stats, *words]), np.int64, len(stats) + len(words))
    return got & ((1 << bits) - 1)


N_STATS = len(measures(b""))


def _values(n: int) -> np.ndarray:
    """The measures weigh 1 each, the words together as much as one."""
    x = np.full(n, 1 / max(n - N_STATS, 1) ** 0.5)
    x[:N_STATS] = 1
    return x


def train(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, rounds: int = 20,
          rate: float = 0.3, seed: int = SEED) -> np.ndarray:
    """Logistic regression on soft labels by adaptive gradient steps; the last weight is the bias."""
    weights, size = np.zeros((1 << bits) + 1), np.full((1 << bits) + 1, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            at, x = rows[i], _values(len(rows[i]))
            p = 1 / (1 + np.exp(-np.clip(weights[at] @ x + weights[-1], -30, 30)))
            step = (p - labels[i]) * np.append(x, 1)
            at = np.append(at, len(weights) - 1)
            size[at] += step ** 2
            weights[at] -= rate * step / np.sqrt(size[at])
    return weights


def _score(weights: np.ndarray, bits: int):
    weights = weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            out = []
            for text in batch.column("text").to_pylist():
                text = (text or "").encode()
                if not text.split(None, 1):
                    out.append(0.0)
                    continue
                at = features(text, bits)
                z = float(weights[at] @ _values(len(at)) + weights[-1])
                out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.float64())],
                                  ["doc_id", "score"])
    return run


def _featured(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [batch.column("draw"), pa.array([votes(measures(t)) for t in texts]),
                 pa.array([features(t, bits) for t in texts], pa.list_(pa.int64()))],
                ["draw", "votes", "features"])
    return run


class QualityModel:
    """Labellers' accuracies, the posterior of each vote pattern, and the scorer."""

    def __init__(self, patterns, posterior, tables, prior, weights, bits):
        self.patterns, self.posterior, self.tables = patterns, posterior, tables
        self.prior, self.weights, self.bits = prior, weights, bits

    def accuracies(self) -> np.ndarray:
        """Share of right votes among those each labeller casts."""
        bad, good = self.tables[:, 0] * (1 - self.prior), self.tables[:, 1] * self.prior
        return (good[:, 0] + bad[:, 1]) / (good + bad).sum(axis=1)


def fit(docs: DataFrame, sample: int = SAMPLE, bits: int = BITS, seed: int = SEED) -> QualityModel:
    """Estimate labels over all documents; train on ``sample`` of them, drawn by a hash.

    The driver holds the counts of vote patterns, at most 3 to the power of the number of
    labellers, and the features of the sample.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = {r.votes: r.n for r in rows.mapInArrow(_vote, VOTED).groupBy("votes")
               .agg(F.count(F.lit(1)).alias("n")).collect()}
    patterns = sorted(counted)
    posterior, tables, prior = estimate(patterns, np.array([counted[p] for p in patterns], float))
    n = sum(counted.values())
    # by a hash threshold: about one and a half samples come in, the smallest hashes train
    draw = F.xxhash64(F.lit(seed), "doc_id", "text")
    share = min(1.0, 1.5 * sample / max(n, 1))
    bound = min(int(-(1 << 63) + share * (1 << 64)), (1 << 63) - 1)
    some = (rows.withColumn("draw", draw).where(F.col("draw") <= bound)
            .mapInArrow(_featured(bits), "draw long, votes string, features array<bigint>")
            .orderBy("draw", "votes").limit(sample).collect())
    label = dict(zip(patterns, posterior))
    weights = train([np.array(r.features) for r in some], np.array([label[r.votes] for r in some]),
                    bits, seed=seed)
    return QualityModel(patterns, posterior, tables, prior, weights, bits)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, score``: probability of good quality of every row; 0 for texts without words.

    A null text counts as empty. Rows may repeat and ids be null; each row is judged by its
    text alone, whole. Other columns are ignored.
    """
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(_score(model.weights, model.bits), SCORED))


def keep_good(docs: DataFrame, model: QualityModel, least: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns, whose score is at least ``least``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _score(model.weights, model.bits)
        for batch in pieces(batches, "text"):
            two = pa.record_batch([pa.nulls(batch.num_rows, pa.int64()), batch.column("text")],
                                  ["doc_id", "text"])
            for scored in judge(iter([two])):
                yield batch.filter(pa.compute.greater_equal(scored.column("score"), least))
    return docs.mapInArrow(run, docs.schema)
