"""Corpus operators against brute force on small tables, with odd rows in every one of them."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmur.llm import (
    licences,
    mixing,
    neighbours,
    packing,
    quality,
    simhash,
    sketches,
    suffix_dedup,
    token_counts,
    token_files,
)
from murmur.llm.components import components
from murmur.llm.queries import BYTE_BPE, PIECE_BPE, vocabulary
from murmur.llm.units import ByteUnits
from murmur.session import scratch_dir

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mü ñu ßs 日本 x y".split()
# extra columns have names that the operators use inside
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, "
          "key string, bucket int, found string, fingerprint string, component_id long")


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ",\n" if n > 20 else ","])
                    for _ in range(n))


def texts():
    long = prose(1, 4000)
    passage = prose(2, 60)
    rows = [None, "", " ", "\n\t ", "one", "Two words", "a  b\t c\r\nd ", "x" * 300, "ab" * 400,
            prose(3, 200), prose(3, 200), prose(3, 199) + " other", long, long + " end",
            prose(4, 50) + "\n" + passage + "\n" + prose(5, 50), passage, prose(6, 9) + passage,
            passage + passage, "日本" * 90, "é日本" * 90, "<|endoftext|> <s> x </s>",
            "▁a ▁ b", "can't 'll\n 's", "THE the THE the", "\x1ca\x85b"]
    return rows + [prose(20 + i, 5 + 3 * i) for i in range(30)]


def rows(shift=0):
    out = [(3 * i + shift, t, "en", ("s2", None, "s1", "S", "")[i % 5], len(t or ""), i, "k", i, "f",
            "0", 7) for i, t in enumerate(texts())]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collect(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---- near-duplicates -------------------------------------------------------------------

def brute_simhash(data):
    import xxhash

    prints = {}
    for doc, text in data:
        raw = (text or "").encode()
        w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in raw))
        s = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        prints[doc] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    parent = {d: d for d in prints}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                a_, b_ = sorted((find(a), find(b)))
                parent[b_] = a_
    return sorted((d, f"{p:016x}", find(d)) for d, p in prints.items())


def test_simhash_matches_brute_force(docs):
    got = simhash.near_duplicates(docs).select("doc_id", F.lower(F.hex("fingerprint")), "component_id")
    assert collect(got) == sorted(brute_simhash([r[:2] for r in rows()]), key=repr)


def test_simhash_of_nothing_and_of_rows_without_id(spark, empty):
    assert simhash.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (None, "q r s"), (5, "a b c"), (5, "a b c")],
                                "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(odd).collect()}
    assert got == {(None, 5), (None, None), (5, 5)}


def test_tiles_find_every_link(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(300)]
    prints = set(base)
    for b in base[:120]:
        x = b
        for _ in range(rng.randint(1, 6)):  # chains of close fingerprints
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << bit
            prints.add(x)
    prints = sorted(prints)
    df = spark.createDataFrame([(bytearray(p.to_bytes(8)),) for p in prints], "fingerprint binary")
    df = df.withColumn("kind", simhash.quarter_counts(F.col("fingerprint")))
    links = simhash.links(df, 3, simhash.quarter_steps(3), tile=8)
    number = {p: i for i, p in enumerate(prints)}
    edges = [(number[int.from_bytes(a)], number[int.from_bytes(b)]) for a, b in links.collect()]
    x = np.array(prints, np.uint64)
    near = np.argwhere(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3)
    want = simhash.forest(near[:, 0], near[:, 1], len(x))
    e = np.array(edges)
    assert np.array_equal(simhash.forest(e[:, 0], e[:, 1], len(x)), want)
    assert len(edges) < len(near)


def test_similar_groups_follow_the_shingle_sets(spark):
    def text(tag, first, n):
        return " ".join(f"{tag}w{i}" for i in range(first, first + n + 4))

    # n shingles each, of which c are common: (n, c) for Jaccards 0.7, 0.79, 0.8, 0.85 and small sets
    cases = [(340, 280), (358, 316), (180, 160), (370, 340), (9, 8), (6, 5), (8, 7), (50, 40)]
    data = []
    for k in range(12):
        for j, (n, c) in enumerate(cases):
            tag = f"t{k}c{j}"
            data += [(1000 * k + 10 * j, text(tag, 0, n)), (1000 * k + 10 * j + 1, text(tag, n - c, n))]
        # of four and five shingles, and a chain of different texts on one template
        data += [(1000 * k + 100, text(f"s{k}", 0, 4)), (1000 * k + 101, text(f"s{k}", 0, 5))]
        data += [(1000 * k + 200 + i, text(f"u{k}", 70 * i, 400)) for i in range(6)]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(
        spark.createDataFrame(data, "doc_id long, text string")).collect()}
    for k in range(12):
        for j, (n, c) in enumerate(cases):
            a, b = 1000 * k + 10 * j, 1000 * k + 10 * j + 1
            assert (got[a], got[b]) == (a, a if c / (2 * n - c) >= 0.8 else b), (n, c)
        assert got[1000 * k + 101] == 1000 * k + 100
        assert all(got[1000 * k + 200 + i] == 1000 * k + 200 + i for i in range(6))


def test_similar_groups_hold_across_blocks(spark, monkeypatch):
    base = [f"w{i}" for i in range(104)]
    data = [(i, " ".join(base[i:] + base[:i])) for i in range(0, 60)]
    data += [(100 + i, " ".join([*base, f"end{i}"])) for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    sets = {d: {tuple(w[i:i + 5]) for i in range(len(w) - 4)} for d, t in data for w in [t.split()]}
    want = {d: d for d in sets}
    while True:
        new = {a: min(want[b] for b in sets if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9)
               for a in sets}
        if new == want:
            break
        want = new
    monkeypatch.setattr(simhash, "BLOCK_BYTES", 8192)
    assert dict(collect(simhash.similar_groups(df).select("doc_id", "component_id"))) == want


def test_similar_groups_hold_near_copies(spark):
    a, b = prose(50, 300), prose(51, 300)
    w = a.split(" ")
    w[100] = w[200] = "changed"
    df = spark.createDataFrame([(1, a), (2, " ".join(w)), (3, b), (4, a)], "doc_id long, text string")
    assert collect(simhash.similar_groups(df).select("doc_id", "component_id")) == [
        (1, 1), (2, 1), (3, 3), (4, 1)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    random.Random(3).shuffle(edges)
    got = dict(collect(components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- tokens ----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def byte_bpe():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary(BYTE_BPE))


def ids_of(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_units_encode_like_the_library(byte_bpe):
    units = ByteUnits(vocabulary(BYTE_BPE))
    for _ in range(2):
        ids, bounds = units.encode(texts())
        for i, t in enumerate(texts()):
            assert ids[bounds[i]:bounds[i + 1]].tolist() == ids_of(byte_bpe, t, 0)[:-1].tolist()
        ids, bounds = units.encode(texts(), 2)
        for i, t in enumerate(texts()):
            assert ids[bounds[i]:bounds[i + 1]].tolist() == ids_of(byte_bpe, t, 2).tolist()


@pytest.mark.parametrize("bits", [1, 5, 8, 15, 16, 17, 31, 32])
def test_packed_ids_come_back(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 31, 32, 33, 1000):
        ids = rng.integers(0, 1 << bits, n, np.uint64).astype(np.uint32)
        data = token_files.pack(ids, bits)
        assert len(data) == -(-n // 32) * 4 * bits
        assert np.array_equal(token_files.unpack(data, bits, n), ids)
        low_first = "".join(f"{int(i):0{bits}b}"[::-1] for i in ids)
        stored = "".join(f"{b:08b}"[::-1] for b in data)
        assert stored.startswith(low_first) and "1" not in stored[len(low_first):]
    with pytest.raises(ValueError):
        token_files.pack(np.array([1 << bits], np.uint64), bits)


def test_token_files_round_trip(spark, docs, byte_bpe):
    files = token_files.write_tokens(docs, vocabulary(BYTE_BPE), scratch_dir(spark, "t"),
                                     block=64)
    assert files.count() >= 5
    got = collect(token_files.read_tokens(files).select("doc_id", "start", "n_tokens", "ids"))
    want, at = [], 0
    for doc, text, *_ in rows():
        ids = ids_of(byte_bpe, text, 2)
        want.append((doc, at, len(ids), bytearray(ids.tobytes())))
        at += len(ids)
    assert got == sorted(want, key=repr)
    one = files.orderBy("start").collect()[2]
    reader = token_files.Reader(one.path)
    assert reader.bits == 16 and one.start in {w[1] for w in want}
    whole = reader.ids(0, reader.n_tokens)
    for lo, hi in ((0, 1), (63, 65), (5, 5), (100, reader.n_tokens)):
        assert np.array_equal(reader.ids(lo, hi), whole[lo:hi])
    assert np.array_equal(token_files.read_document(spark, one.path, 0), whole[:reader.starts[1]])


def test_token_files_of_nothing_and_without_id(spark, empty):
    files = token_files.write_tokens(empty, vocabulary(BYTE_BPE), scratch_dir(spark, "t"))
    assert token_files.read_tokens(files).count() == 0
    odd = spark.createDataFrame([(1, "b"), (None, "c"), (1, "a"), (1, "a"), (None, None)],
                                "doc_id long, text string")
    files = token_files.write_tokens(odd, vocabulary(BYTE_BPE), scratch_dir(spark, "t"))
    got = [tuple(r)[:3] for r in token_files.read_tokens(files).orderBy("start").collect()]
    assert got == [(None, 0, 1), (None, 1, 2), (1, 3, 2), (1, 5, 2), (1, 7, 2)]


def test_prefix_counts_are_those_of_the_library(spark, docs):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECE_BPE))
    table = token_counts.count_prefixes(docs, vocabulary(PIECE_BPE)).cache()
    by_id = {r.doc_id: r for r in table.collect()}
    assert len(by_id) == len(rows())
    for doc, text, *_ in rows():
        text, row = text or "", by_id[doc]
        assert (row.n_bytes, row.n_chars) == (len(text.encode()), len(text))
        assert row.n_tokens == len(sp.encode(text))
        places = range(len(text) + 1) if len(text) < 300 else range(0, len(text) + 1, 97)
        counts = token_counts.counts(row.steps)
        assert [counts[i] for i in places] == [len(x) for x in sp.encode([text[:i] for i in places])]
    fits = {r.doc_id: r.fits for r in token_counts.longest_prefix(table, 20).collect()}
    for doc, row in by_id.items():
        counts = token_counts.counts(row.steps)
        assert counts[fits[doc]] <= 20 and (counts[fits[doc] + 1:] > 20).all()
    some = token_counts.prefix_counts(table, 50).where("doc_id = 36").orderBy("n_chars").collect()
    assert [r.n_tokens for r in some] == token_counts.counts(by_id[36].steps)[::50].tolist()


def test_prefix_tables_agree_with_the_dynamic_programme():
    tables = token_counts.PrefixTables(vocabulary(PIECE_BPE))
    units = {u for t in texts() if t and len(t) < 3000 for u in token_counts.units_of(t)} - {"\n"}
    assert [tables.table(u)[-1] for u in sorted(units)] == tables._count(sorted(units))


def test_token_counts_of_nothing(empty):
    assert token_counts.count_prefixes(empty, vocabulary(PIECE_BPE)).count() == 0


# ---- packing ---------------------------------------------------------------------------

@pytest.mark.parametrize("capacity,least", [(2048, 32), (64, 8)])
def test_packing_places_every_id_once(spark, docs, byte_bpe, capacity, least):
    df = packing.pack(docs, vocabulary(BYTE_BPE), end_id=1, capacity=capacity, least=least)
    got = df.collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc, text, *_ in rows():
        parts = sorted(by_doc[doc], key=lambda r: r.start)
        ids = ids_of(byte_bpe, text, 1)
        assert b"".join(p.ids for p in parts) == ids.tobytes()
        at = 0
        for p in parts:
            assert p.start == at and len(p.ids) == 4 * p.length and p.doc_tokens == len(ids)
            at += p.length
    padding = total = 0
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        total += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding <= 5 * capacity + 0.05 * total  # at most one loose sequence a partition
    whole = {r.sequence_id: r for r in packing.sequences(df, 9, capacity).collect()}
    for number, parts in by_sequence.items():
        ids = np.frombuffer(whole[number].ids, "<u4")
        n = whole[number].n_tokens
        assert len(ids) == (n if n & (n - 1) == 0 else capacity) and (ids[n:] == 9).all()
        assert ids[:n].tobytes() == b"".join(p.ids for p in sorted(parts, key=lambda r: r.offset))


def test_packing_of_nothing_and_of_bad_sizes(empty):
    assert packing.pack(empty, vocabulary(BYTE_BPE)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(empty, vocabulary(BYTE_BPE), capacity=1000)


# ---- mixing ----------------------------------------------------------------------------

def brute_targets(sizes, weights=(5, 2, 1), share=1.5, repeats=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, rest, out = dict(sizes), share * sum(sizes.values()), {}
    while left:
        level = rest / sum(weight[s] for s in left)
        over = [s for s in left if level * weight[s] > repeats * sizes[s]]
        if not over:
            out |= {s: level * weight[s] for s in left}
            break
        for s in over:
            out[s] = float(repeats * sizes[s])
            rest -= out[s]
            del left[s]
    return out


@pytest.mark.parametrize("block_words", [5, 200, 10_000])
def test_mixing_meets_its_targets(docs, block_words):
    got = mixing.plan(docs, block_words).collect()
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, *_ in rows()}
    source = {r[0]: r[3] for r in rows()}
    sizes, taken = collections.Counter(), collections.Counter()
    for d in size:
        sizes[source[d]] += size[d]
    want = brute_targets(sizes)
    assert len(got) == len(size)
    for r in got:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[s])
        assert r.target == pytest.approx(want[s], rel=1e-12)
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(c.words for c in r.copies)
        assert [c.copy for c in r.copies] == sorted({c.copy for c in r.copies})
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    again = mixing.plan(docs.repartition(3), block_words)
    assert collect(again) == sorted(map(tuple, got), key=repr)


def test_mixed_documents_hold_the_planned_words(docs):
    planned = {(r.doc_id, c.copy): c.words for r in mixing.plan(docs, 100).collect() for c in r.copies}
    got = mixing.mix(docs, 100).collect()
    original = {r[0]: r[1] for r in rows()}
    count = collections.Counter()
    for r in got:
        assert original[r.doc_id].startswith(r.text) and r.key == "k"
        count[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    want = collections.Counter()
    for (doc, _), words in planned.items():
        want[doc] += words
    assert len(got) == len(planned) and count == want


def test_rows_that_differ_only_in_their_text_are_mixed_each(spark):
    words = ["alpha", "beta", "gamma", "delta"]
    data = [(7, " ".join([w] * 30), "s") for w in words] + [(None, " ".join([w.upper()] * 20), None) for w in words] * 2
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(5)
    taken = collections.Counter()
    for x in mixing.plan(df, 40).collect():
        taken[x.text_key] += x.taken
    keys = {x.text: x.k for x in df.select("text", F.xxhash64("text").alias("k")).collect()}
    got = collections.Counter()
    for x in mixing.mix(df, 40).collect():
        key = next(k for t, k in keys.items() if t.startswith(x.text))
        got[key] += len(x.text.split())
    assert {k: n for k, n in got.items() if n} == {k: n for k, n in taken.items() if n}


def test_splitting_tree_is_exact():
    counts = np.array([500, 3, 0, 97])
    for width in (1, 3):
        nodes = list(mixing.split_tree(0, 13, counts, 600, 13, width, 1))
        assert sum(n[2] for n in nodes).tolist() == counts.tolist()
        for lo, hi, c in nodes:
            assert c.sum() == hi * 600 // 13 - lo * 600 // 13
    both = list(mixing.split_tree(0, 13, counts, 600, 13, 4, 1))
    fine = [x for lo, hi, c in both for x in mixing.split_tree(lo, hi, c, 600, 13, 1, 1)]
    direct = list(mixing.split_tree(0, 13, counts, 600, 13, 1, 1))
    assert [x[2].tolist() for x in fine] == [x[2].tolist() for x in direct]


def test_mixing_of_nothing_and_of_odd_rows(spark, empty):
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b", "s"), (None, "a b", "s"), (1, None, None), (1, "", "t")],
                                "doc_id long, text string, source string")
    got = mixing.plan(odd).collect()
    assert sum(r.taken for r in got) == 6 and len(got) == 4
    assert mixing.mix(odd).count() >= 3


# ---- sketches --------------------------------------------------------------------------

def grams(text, n=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text.lower()) if x]
    return {tuple(w[max(0, i - n + 1):i + 1]) for i in range(len(w))}


def test_sketches_of_edited_texts(docs):
    got = {r.doc_id: r for r in sketches.compare_edited(docs, k=64).collect()}
    data = [(r[0], r[1] or "") for r in rows()]
    assert len(got) == len(data)
    for i, (doc, text) in enumerate(data):
        follows = data[(i + 1) % len(data)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + follows[:half]
        r = got[doc]
        assert (r.n_chars, r.edited) == (len(text), edited)
        assert r.sketch == sorted(r.sketch) and len(r.sketch) == min(64, len(grams(text)))
        for near, other in ((r.near_edited, edited), (r.near_next, follows)):
            a, b = grams(text), grams(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert near == pytest.approx(true, abs=1e-12 if len(a | b) <= 64 else 0.25)


def test_sketches_merge_and_estimate(spark):
    a, b = prose(60, 900), prose(61, 900)
    df = spark.createDataFrame([(a, b, a + " " + b, prose(60, 300))], "a string, b string, ab string, c string")
    s = {c: sketches.sketch(F.col(c), 256) for c in df.columns}
    r = df.select(sketches.resemblance(sketches.merge(s["a"], s["b"], 256), s["ab"], 256).alias("same"),
                  sketches.distinct_shingles(s["a"], 256).alias("n"),
                  sketches.containment(s["c"], s["a"], 256).alias("inside"),
                  sketches.from_text(sketches.as_text(s["a"])).alias("back"), s["a"].alias("own")).first()
    assert r.same > 0.95 and r.n == pytest.approx(len(grams(a)), rel=0.2)
    assert r.inside > 0.8 and r.back == r.own


def test_sketches_of_parts(spark, docs, empty):
    parts = docs.select("source", sketches.sketch(F.col("text"), 32).alias("sketch"))
    got = {r.source: r.sketch for r in sketches.merge_parts(parts, ["source"], k=32).collect()}
    want = collections.defaultdict(set)
    for r in parts.collect():
        want[r.source] |= set(r.sketch)
    assert got == {s: sorted(v)[:32] for s, v in want.items()}
    assert sketches.compare_edited(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "c d"), (1, "b a"), (2, "e")],
                                "doc_id long, text string")
    got = collect(sketches.compare_edited(odd).select("doc_id", "edited"))
    assert got == sorted([(None, "a "), (None, "a "), (1, "b c"), (1, "c e"), (2, "e")], key=repr)


# ---- quality ---------------------------------------------------------------------------

def good_text(i):
    rng = random.Random(i)
    word = lambda: "".join(rng.choice("aeioulnrstdmch") for _ in range(rng.choice([2, 3, 3, 5, 6, 8])))
    return "\n".join(" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(rng.randint(5, 20)))


def bad_text(i):
    t = good_text(1000 + i)
    return (t.upper().replace(" ", "!! "), " | ".join(t.split()), t.replace(" ", "$$$ %%%"),
            "Buy now here.\n" * 30)[i % 4]


def test_quality_learns_without_labels(spark, empty):
    data = [(i, bad_text(i) if i % 6 == 0 else good_text(i)) for i in range(600)]
    data += [(1000, None), (1001, ""), (1002, " \n"), (None, good_text(5)), (1003, good_text(7) * 400)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("score", F.lit("clash"))
    model = quality.fit(df, sample=300)
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    right = [(got[i] >= 0.5) == (i % 6 != 0) for i in range(600)]
    assert np.mean(right) > 0.98 and np.mean([got[i] >= 0.5 for i in range(600) if i % 6]) > 0.99
    assert got[1000] == got[1001] == got[1002] == 0 and got[None] >= 0.5
    assert (model.accuracies() > 0.5).all()
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns and kept.count() == sum(s >= 0.5 for s in got.values())
    nothing = quality.fit(empty)
    assert quality.score(empty, nothing).count() == 0


def test_estimation_finds_the_better_labellers():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.7
    right = [0.95, 0.9, 0.7, 0.6]
    votes = ["".join(("g" if t == (rng.random() < p) else "b") if rng.random() < 0.8 else "-" for p in right)
             for t in truth]
    count = collections.Counter(votes)
    patterns = sorted(count)
    good, tables, prior = quality.estimate(patterns, np.array([count[p] for p in patterns], float))
    model = quality.QualityModel(patterns, good, tables, prior, None, 0)
    assert np.allclose(model.accuracies(), right, atol=0.05) and abs(prior - 0.7) < 0.05


def test_caches_are_bounded_in_bytes(monkeypatch):
    """Tabbed texts are whole keys, texts without spaces whole units."""
    from murmur.llm import token_counts as counts
    from murmur.llm import units

    monkeypatch.setattr(units, "CACHE_BYTES", 2 << 20)
    own = ByteUnits(vocabulary(BYTE_BPE))
    tabbed = ["\t".join(f"w{i}x{j}" for j in range(60)) for i in range(20_000)]
    most = 0
    for at in range(0, len(tabbed), 500):
        own.encode(tabbed[at:at + 500])
        most = max(most, own.held)
    assert 0 < most < 4 << 20
    assert own._bounds.nbytes + own._ids.nbytes < 16 << 20
    monkeypatch.setattr(counts, "CACHE_BYTES", 1 << 20)
    tables = counts.PrefixTables(vocabulary(PIECE_BPE))
    dense = ["日本語の文" * 80 + str(i) for i in range(60)] + [f"plain words {i}" for i in range(40_000)]
    most = 0
    for at in range(0, len(dense), 2000):
        tables.steps(dense[at:at + 2000])
        most = max(most, tables.held)
    assert most < 2 << 20 and max(map(len, tables._cache)) <= counts.LONG_UNIT


# ---- licences --------------------------------------------------------------------------

def test_licences_are_named_and_confirmed(spark, empty):
    lines = [(k, t) for k, ts in licences.TEMPLATES.items() for t in ts]
    data = [(i, good_text(i) + "\n" + t + "\n" + good_text(i + 1)) for i, (_, t) in enumerate(lines)]
    n = len(data)
    data += [(n + i, t) for i, t in enumerate(licences.ORDINARY_SENTENCES)]
    data += [(500, None), (501, ""), (502, good_text(3) + " " + lines[0][1].lower() + " " + good_text(4)),
             (None, lines[4][1]), (503, lines[0][1] + "\n" + lines[4][1]), (504, good_text(9) * 50)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("family", F.lit("clash"))
    model = licences.fit(spark, df)
    assert model.threshold >= 0.5
    got = collections.defaultdict(set)
    for r in licences.scan(df, model).collect():
        got[r.doc_id].add(r.family)
        assert r.coverage >= licences.COVERAGE and r.probability >= model.threshold
    assert np.mean([got[i] == {k} for i, (k, _) in enumerate(lines)]) > 0.9
    assert not any(got[n + i] for i in range(len(licences.ORDINARY_SENTENCES)))
    assert got[502] == {"MIT"} and got[None] == {"Apache-2.0"} and got[503] == {"MIT", "Apache-2.0"}
    assert not got[500] and not got[501] and not got[504]
    assert licences.scan(empty, model).count() == 0


def test_every_template_holds_a_cue():
    assert all(re.search(licences.CUES, t) for _, t in licences.template_texts())


SHORT = [("MIT", "MIT License"), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"), ("GPL-3.0", "GNU GPL v3"),
         ("MIT", "Code licensed under MIT"), ("CC-BY-NC-SA", "Licensed under CC BY-NC-SA 4.0"),
         ("MIT", "The plugin was released under the\nMIT License."), ("MIT", "Released under the MIT License."),
         ("BSD", "// SPDX-License-Identifier: BSD-3-Clause"), ("GPL-2.0", "License: GPL-2.0-or-later"),
         ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004")]
WRAPPED = [
    ("MIT", """MIT License

Copyright (c) 2021 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""),
    ("Apache-2.0", """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""),
    ("GPL-3.0", """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version."""),
    ("BSD", """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:

1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer."""),
    ("MPL-2.0", """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""),
]
HARMLESS = [
    "He renewed his driving license and paid for the copyright of the song.", "The museum gave permission to film.",
    "A warranty covers the pump for three years; the source code of the game was lost.",
    "The fishing license is sold by the town hall, all rights to the lake belong to the village.",
    "Free software was a topic of the fair, next to public domain maps.", "The licensee shall pay the licensor.",
    "Creative commons meetings take place in the library.", "Its licence plate was blue.",
]


def test_short_and_wrapped_licences_are_found(spark):
    cases = SHORT + WRAPPED
    data = [(i, t) for i, (_, t) in enumerate(cases)]
    data += [(100 + i, good_text(i) + "\n\n" + t + "\n\n" + good_text(i + 1)) for i, (_, t) in enumerate(cases)]
    data += [(300 + i, t) for i, t in enumerate(HARMLESS)]
    data += [(400 + i, good_text(i) + " " + t + " " + good_text(i + 2)) for i, t in enumerate(HARMLESS)]
    data += [(500 + i, good_text(i)) for i in range(200)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    model = licences.fit(spark, df)
    got = collections.defaultdict(set)
    for r in licences.scan(df, model).collect():
        got[r.doc_id].add(r.family)
    missed = [(i, k, got[i]) for i, (k, _) in enumerate(cases) if k not in got[i]]
    missed += [(100 + i, k, got[100 + i]) for i, (k, _) in enumerate(cases) if k not in got[100 + i]]
    assert not missed
    wrong = [(i, got[i] - {k}) for i, (k, _) in enumerate(cases) if got[i] - {k}]
    assert len(wrong) <= 1, wrong
    assert not [i for i in got if i >= 300 and got[i]]


# ---- neighbours ------------------------------------------------------------------------

def vectors(n, d, seed, scale=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[n // 2:] += 3 * rng.normal(size=d)
    return x * (rng.uniform(0.1, 5, (n, 1)) if scale else 1 / np.linalg.norm(x, axis=1, keepdims=True))


@pytest.mark.parametrize("scale", [False, True])
def test_neighbours_reach_the_recall(spark, scale):
    x = vectors(1500, 24, 1, scale)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 20 = 0")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, asked).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    want = collections.defaultdict(set)
    for r in neighbours.exact(df, asked).collect():
        want[r.query_id].add(r.vec_id)
    assert np.mean([len({v for _, v, _ in got[q]} & want[q]) / 20 for q in want]) > 0.9
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in {f[1] for f in found}
        assert [f[2] for f in found] == pytest.approx([float(x[q] @ x[v]) for _, v, _ in found], rel=1e-12, abs=1e-12)
        assert sorted(found, key=lambda f: (-f[2], f[1])) == found


def recall(spark, x, asked):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in neighbours.nearest(df, df.where(F.col("vec_id").isin(asked))).collect():
        got[r.query_id].add(r.vec_id)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-score, axis=1)[:, :min(20, len(x) - 1)]
    return np.mean([len(got[q] & set(b.tolist())) / len(b) for q, b in zip(asked, best)])


@pytest.mark.parametrize("lengths", ["one long", "log-normal"])
def test_neighbours_of_uneven_lengths(spark, lengths):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if lengths == "one long":
        x[77] *= 10
    else:
        x *= rng.lognormal(0, 1, (len(x), 1))
    assert recall(spark, x, list(range(0, 12_000, 300))) > 0.9


@pytest.mark.parametrize("n,rows", [(600, 64), (3000, 64), (9000, 4)])
def test_neighbours_go_through_the_tables(spark, monkeypatch, n, rows):
    """One and two hashes a table, at sizes that were searched whole once."""
    monkeypatch.setattr(neighbours, "BUCKET_ROWS", rows)
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 16 if rows == 4 else 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hashes = []
    own = neighbours._hash

    def seen(kind, bands, whole, *rest):
        hashes.extend(b[2] for b in bands)
        assert bands and not whole
        return own(kind, bands, whole, *rest)

    monkeypatch.setattr(neighbours, "_hash", seen)
    assert recall(spark, x, list(range(0, n, n // 60))) >= 0.9
    assert set(hashes) == {2 if rows == 4 else 1}


@pytest.mark.parametrize("n", [15, 12_000])
def test_neighbours_of_isolated_queries_are_whole(spark, n):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 64))
    if n > 20:  # all but the queries lie in one cone
        x[40:] = 0.1 * x[40:] + np.eye(64)[0] * 3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert recall(spark, x, list(range(min(n, 40)))) > (0.9 if n > 20 else 0.999)


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(i, [1.0, 0.0, 2.0]) for i in range(100, 160)]  # one common vector
    data += [(20, [1.0, 0.5, 2.0]), (40, None), (60, [0.0, 0.0, 0.0]), (80, [nan, 1.0, 1.0]),
             (200, [inf, 1.0, 1.0]), (220, [None, 1.0, 1.0]), (240, [1.0]), (None, [1.0, 1.0, 1.0]),
             (20, [1.0, 0.5, 2.0]), (7, [-1.0, 0.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0"), probes=6).orderBy("rank").collect():
        got[r.query_id].append(r.vec_id)
    assert set(got) == {20, 100, 120, 140}
    assert got[20] == list(range(100, 120))
    assert got[120] == [20, *range(100, 119)]  # as near as the common vector
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert neighbours.nearest(none, none).count() == 0


# ---- repeats ---------------------------------------------------------------------------

def brute_repeats(data, match):
    seen, out = set(), {}
    for doc, text in data:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - match + 1):
            w = raw[i:i + match]
            if w in seen:
                gone[i:i + match] = True
            seen.add(w)
        spans = int(np.sum(gone[1:] & ~gone[:-1]) + gone[:1].sum())
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out[doc] = (len(raw), int(gone.sum()), spans, kept)
    return out


@pytest.mark.parametrize("match,seed", [(100, None), (40, 12), (16, 16)])
def test_repeats_match_brute_force(docs, match, seed):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))
           for r in suffix_dedup.remove_repeats(docs, match, seed).collect()}
    assert got == brute_repeats([r[:2] for r in rows()], match)


def test_repeats_in_long_texts_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1 << 20)
    rng = random.Random(5)
    passage = prose(70, 40)
    data = [(i, prose(rng.randint(0, 12), 30) + " " + passage[rng.randint(0, 30):] + prose(200 + i, 20))
            for i in range(200)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))
           for r in suffix_dedup.remove_repeats(df, 50).collect()}
    assert got == brute_repeats(data, 50)


def test_parts_of_a_long_text_cover_each_string_once(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 64)
    data = np.arange(500, dtype=np.uint8)
    bounds = np.array([0, 10, 30, 300, 340, 340, 500])
    starts = []
    for part, local, first, offset in suffix_dedup.chunks(data, bounds, 20):
        for k in range(len(local) - 1):
            lo = bounds[first + k] + offset
            assert np.array_equal(part[local[k]:local[k + 1]], data[lo:lo + local[k + 1] - local[k]])
            starts += [lo + i for i in range(local[k + 1] - local[k] - 19)]
    want = [b + i for b, e in zip(bounds[:-1], bounds[1:]) for i in range(e - b - 19)]
    assert sorted(starts) == want


def test_whole_characters_stay(spark):
    text = "日本語テキスト" * 30
    df = spark.createDataFrame([(1, text), (2, "é" + text), (3, "ab" + text[1:])], "doc_id long, text string")
    for r in suffix_dedup.remove_repeats(df, characters=True).collect():
        bytes(r.kept).decode()


def test_repeats_of_nothing_and_of_odd_rows(spark, empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0
    t = prose(80, 60)
    odd = spark.createDataFrame([(None, t), (None, t), (4, t), (4, t), (5, t), (6, "short")],
                                "doc_id long, text string")
    got = collect(suffix_dedup.remove_repeats(odd).select("doc_id", "n_removed"))
    n = len(t.encode())
    assert got == sorted([(None, 0), (None, 0), (4, 0), (4, 0), (5, n), (6, 0)], key=repr)


def test_texts_that_share_an_id_are_told_apart(spark):
    p, q, r = (prose(90 + i, 90) for i in range(3))
    data = [(1, p), (5, p + q), (5, r), (6, p), (6, None), (7, r), (7, r), (None, p)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = [(x.doc_id, x.n_bytes, x.n_removed, bytes(x.kept)) for x in suffix_dedup.remove_repeats(df).collect()]
    size = lambda t: len(t.encode())
    assert (5, size(r), 0, r.encode()) in got  # it shares nothing with what came before
    assert (1, size(p), 0, p.encode()) in got and (6, size(p), size(p), b"") in got
    cut = next(x for x in got if x[0] == 5 and x[1] == size(p + q))
    assert cut[2] >= size(p) and (p + q).encode().endswith(cut[3])
    assert (6, 0, 0, b"") in got and got.count((7, size(r), size(r), b"")) == 2
    assert (None, size(p), 0, p.encode()) in got and len(got) == len(data)


def test_index_family_keeps_the_earliest():
    rng = np.random.default_rng(4)
    family, lost, added = suffix_dedup.IndexFamily(), [], []
    for _ in range(25):
        n = rng.integers(1, 200)
        e = suffix_dedup._entries(rng.integers(0, 60, n).astype(np.uint64), rng.integers(0, 3, n).astype(np.uint64),
                                  rng.integers(0, 10**6, n), np.zeros(n, np.int64), np.zeros(n, np.int64))
        added.append(e)
        lost += family.add(e)
        sizes = [len(x) for x in family.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
    every = np.concatenate(added)
    first = {}
    for e in every:
        k = (int(e["key"]), int(e["near"]))
        first[k] = min(first.get(k, 1 << 60), int(e["doc"]))
    rest = family.rest()
    assert {(int(e["key"]), int(e["near"])): int(e["doc"]) for e in rest} == first
    assert len(rest) + sum(map(len, lost)) == len(every)
