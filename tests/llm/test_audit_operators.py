"""Whitening, byte-level BPE and source divergence against brute force, with odd rows in each."""

import collections
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest

from murmur.llm import byte_bpe, divergence, whitening
from murmur.llm.queries import MULTI_BPE, vocabulary

RANKS = vocabulary(MULTI_BPE)
DOCS = "doc_id long, text string, lang string, source string, ids string, term string, n int, row long, value int"


# --- whitening ------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, x string, part int, n int"


def white(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "x", 0, 0) for i, v in rows], VECTORS).repartition(5)
    return whitening.whiten(df, **kw).collect()


def brute(rows, k):
    kept = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max(len(x) for _, x in kept)
    kept = [(i, x + (0,) * (d - len(x))) for i, x in kept]
    fit = np.array(sorted({x for _, x in kept}), np.float64)
    n, s = len(fit), [sum(int(c) for c in col) for col in fit.T]
    y = (fit * n - np.array(s, np.float64)) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    return kept, n, s, values[::-1][:k], vectors[:, ::-1][:, :k], values.sum()


@pytest.mark.parametrize("n,d", [(900, 12), (7, 12), (400, 3)])
def test_whitening_matches_brute_force(spark, n, d):
    rng = np.random.default_rng(n)
    base = rng.normal(0, 1, (n, d)) * np.linspace(0.2, 3, d) + 1
    base[:, 1] = base[:, 0]  # equal directions and one that never changes
    base[:, 2] = 0.5
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base.astype(np.float32))]
    rows += [(5000 + i, rows[0][1]) for i in range(n // 2)]  # a third are one vector
    rows += [(9000, None), (9001, [None] + [0.0] * (d - 1)), (9002, [float("nan")] * d),
             (9003, [float("inf")] * d), (None, rows[1][1]), (3, rows[2][1])]
    kept, count, sums, values, vectors, trace = brute(rows, 4)
    got = white(spark, rows)
    k = int((values > 1e-9 * trace).sum())
    assert len(got) == len(kept) * k
    by = {(r["vec_id"], r["component"]): r for r in got}
    signs = {}
    for i, x in kept:
        deviation = sum((count * c - s) ** 2 for c, s in zip(x, sums))
        at = (np.array([count * c - s for c, s in zip(x, sums)], np.float64) / count) @ vectors
        for j in range(k):
            r = by[(i, j + 1)]
            assert r["n"] == count
            if collections.Counter(i for i, _ in kept)[i] > 1:
                continue
            assert r["deviation"] == deviation
            want = at[j] / math.sqrt(values[j])
            if abs(want) > 1e-6:
                signs.setdefault(j, math.copysign(1, want * r["whitened"]))
            assert r["whitened"] == pytest.approx(want * signs.get(j, 1), abs=1e-8)
            assert r["explained"] == pytest.approx(values[j] / trace, rel=1e-9)
            assert r["identity_error"] < 1e-9


def test_whitening_of_odd_tables(spark):
    assert white(spark, []) == []
    assert white(spark, [(1, None), (2, [])]) == []
    assert white(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []  # one distinct vector
    two = white(spark, [(1, [1.0, 2.0]), (2, [1.0, 4.0]), (3, [1.0])])
    assert {(r["vec_id"], r["component"]) for r in two} == {(i, 1) for i in (1, 2, 3)}
    huge = white(spark, [(1, [1.0, 3e30]), (2, [1.0, 4.0]), (3, [1.0, 5.0]), (4, [3e15, 2.0])])
    assert {r["vec_id"] for r in huge} == {2, 3, 4}
    assert {int(r["deviation"]) for r in huge if r["vec_id"] == 4} == {
        (2 * int(np.float32(3e15)) * 256 - 2 * 256) ** 2 + (3 * 512 - 11 * 256) ** 2}


def test_rank_one_updates_keep_the_spectrum():
    rng = np.random.default_rng(3)
    for d, n in ((1, 5), (2, 9), (20, 70)):
        x = np.floor(rng.normal(0, 30, (n, d)))
        x[:, -1] = x[:, 0]
        one, left, right = (whitening.Spectrum.empty(d) for _ in range(3))
        for r in x:
            one.update(1, r, np.zeros((0, d)))
        left.add(x[:n // 3])
        right.add(x[n // 3:])
        left.merge(right)
        scatter = (x - x.mean(0)).T @ (x - x.mean(0))
        for s in (one, left):
            size = max(np.abs(scatter).max(), 1)
            assert np.allclose(s.mean, x.mean(0)) and s.n == n
            assert np.abs(s.vectors.T @ s.vectors - np.eye(d)).max() < 1e-12
            assert np.abs((s.vectors * s.values) @ s.vectors.T - scatter).max() < 1e-12 * size


# --- byte-level BPE -------------------------------------------------------------------

POOL = list("ab 's'll 12\n\t  é中٣!.'reSTA\x1f\x85\xa0͸ ’") + [chr(c) for c in (
    0x558, 0x1C89, 0x2EBF0, 0x323B0, 0x11DE0, 0x1F600)]


def library():
    return byte_bpe._encoding(public_tokenizers.PATTERN, byte_bpe.read_ranks(RANKS))


def odd_texts():
    rng = random.Random(5)
    out = ["", " ", "\n\n", "don't 'll", "<|endoftext|>", "a" * 3000, " " * 900 + "b", "é" * 700, "!?" * 800]
    out += ["".join(rng.choice(POOL) for _ in range(rng.randint(1, 400))) for _ in range(150)]
    out += ["".join(rng.choice(["word ", "it's ", "\n", "  ", "12", "中文"]) for _ in range(900)) for _ in range(5)]
    out.append("x y" + "z" * 2000 + " end " * 200)  # a piece longer than overlaps, then words
    return out


@pytest.mark.parametrize("chunk,overlap", [(byte_bpe.CHUNK, byte_bpe.OVERLAP), (64, 16), (40, 8)])
def test_encoding_is_the_library_s(spark, chunk, overlap):
    texts = odd_texts()
    rows = [(i if i % 9 else 7, t, "en", "s", "i", "t", 0, 0, 0) for i, t in enumerate(texts)]
    rows += [(None, None, None, None, "i", None, 0, 0, 0), (None, "a b", None, None, "i", None, 0, 0, 0)]
    df = byte_bpe.encode(spark.createDataFrame(rows, DOCS).repartition(3), RANKS, public_tokenizers.PATTERN,
                         chunk, overlap)
    got = collections.Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"]))
                              for r in byte_bpe.decode(df, RANKS).collect())
    lib = library()
    assert got == collections.Counter(
        (i, tuple(lib.encode_ordinary(t or "")), (t or "").encode()) for i, t, *_ in rows)


def test_classes_are_the_library_s():
    own, lib = byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN), library()
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        text = "".join(f"a{chr(c)}a 1{chr(c)}1" for c in points[at:at + 4096])
        assert np.frombuffer(own.ids(own.cut(text)), np.uint32).tolist() == lib.encode_ordinary(text)


def test_cache_is_bounded_in_bytes():
    own = byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN, cache_bytes=200_000)
    for i in range(20_000):
        own.ids([f"word{i}", "y" * 5000])
    assert own.cache.held <= 200_000 and max(map(len, own.cache)) <= byte_bpe.CACHED_CHARS


def test_no_documents_to_encode(spark):
    empty = spark.createDataFrame([], DOCS)
    assert byte_bpe.decode(byte_bpe.encode(empty, RANKS, public_tokenizers.PATTERN), RANKS).collect() == []


# --- divergence -----------------------------------------------------------------------

def audited(rows):
    """The audit by its definition."""
    counts, docs, groups = collections.Counter(), collections.Counter(), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in
                 re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        counts.update((lang, source, w) for w in words)
        docs.update({(lang, w) for w in words})
    out = []
    for lang, source in groups:
        kept = [w for (k, w), n in docs.items() if k == lang and n >= 30]
        mates = [s for k, s in groups if k == lang]

        def shares(names):
            n = {w: sum(counts[(lang, s, w)] for s in names) for w in kept}
            total = sum(n.values()) + 5 * len(kept)
            return {w: 1 + 10**9 * (n[w] + 5) // total for w in kept}

        own, whole = shares([source]), shares(mates)
        pairs = [(-sum(abs(own[w] - p) for w, p in shares([s]).items()), s) for s in mates if s != source]
        words = [(whole[w] - own[w], w) for w in kept if counts[(lang, source, w)] and own[w] > whole[w]]
        for part, found in (("pair", pairs), ("term", words)):
            found.sort(key=lambda r: (r[0], r[1].encode()))
            out += [(lang, source, part, item, -v, rank) for rank, (v, item) in enumerate(found, 1)
                    if part == "pair" or rank <= 50]
    return sorted(out)


def corpus(sources, n):
    rng = random.Random(sources)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["Über", "日本", "ÀB", "Zz"]
    out = []
    for i in range(n):
        hot = rng.random() < 0.4
        take = [words[min(int(rng.expovariate(0.05)), len(words) - 1)] for _ in range(rng.randint(0, 60))]
        out.append((i, rng.choice([" ", "-", "1", "\x00"]).join(take).title() + " Ünïq", rng.choice(["en", "de", None]),
                    "s0" if hot else f"s{rng.randrange(sources)}", "i", "t", 0, 0, 0))
    return out + [(1, None, "xx", "a", "i", "t", 0, 0, 0), (1, "few words", "xx", "b", "i", "t", 0, 0, 0),
                  (1, "", "xx", None, "i", "t", 0, 0, 0), (2, "", "en", "silent", "i", "t", 0, 0, 0)]


@pytest.mark.parametrize("sources,terms,groups", [(6, divergence.TERMS, divergence.GROUPS), (40, 16, 8)])
def test_divergence_matches_its_definition(spark, monkeypatch, sources, terms, groups):
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "GROUPS", groups)
    rows = corpus(sources, 700)
    got = divergence.audit(spark.createDataFrame(rows, DOCS).repartition(4))
    cols = ("lang", "source", "part", "item", "value", "rank")
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == audited(rows)


def test_counts_are_handed_on_in_parts(spark, monkeypatch):
    held = divergence._Held()
    held.add(("en", "a"), "One one " + "é" * 3 + " x" * 10)
    assert held.size() > 0
    monkeypatch.setattr(divergence, "LONG_TEXT", 8)
    held.add(("en", "a"), "One two two")
    rows = held.rows().to_pylist()
    assert {(r["term"], r["n"], r["docs"]) for r in rows} == {
        (None, 0, 0), ("one", 3, 2), ("ééé", 1, 1), ("x", 10, 1), ("two", 2, 1)}
    assert held.rows().num_rows == 0


def test_no_documents_to_audit(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []
    only = spark.createDataFrame([(1, None, None, None, "i", "t", 0, 0, 0)], DOCS)
    assert divergence.audit(only).collect() == []
