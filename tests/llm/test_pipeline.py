"""The pipeline and the registered queries of the corpus operators."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from murmur.llm.queries import BYTE_BPE, QUERIES, vocabulary
from murmur.session import materialize
from test_corpus_operators import bad_text, brute_repeats, good_text

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of each stage over a small table with known cases."""
    passage = " ".join(good_text(9000).split()[:80])
    data = [(i, good_text(i)) for i in range(200)]
    data += [(300 + i, bad_text(i)) for i in range(40)]
    data += [(400 + i, good_text(i)) for i in range(20)]  # exact copies
    data += [(500 + i, good_text(i).replace(good_text(i).split()[7], "changed", 1) + " end.") for i in range(20, 40)
             if len(good_text(i).split()) > 120]  # near copies
    data += [(600 + i, good_text(700 + i) + "\n" + passage + "\n" + good_text(800 + i)) for i in range(10)]
    rows = [(d, t, "en", f"s{d % 4}", len(t)) for d, t in data]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs.withColumn("size", F.lit("clash")), SF), name)
        out[name] = docs.collect()
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    return out, passage


def ids(rows):
    return {r.doc_id for r in rows}


def test_quality_stage_keeps_clean_documents(stages):
    out, _ = stages
    kept = ids(out["quality"])
    assert not kept & set(range(300, 340)) and len(kept) >= 0.98 * (len(out["documents"]) - 40)


def test_one_of_each_group_of_near_copies_stays(stages):
    out, _ = stages
    kept = ids(out["near_copies"])
    copies = {d for d in ids(out["quality"]) if 400 <= d < 420 and d - 400 in ids(out["quality"])}
    near = {d for d in ids(out["quality"]) if 500 <= d < 600 and d - 500 in ids(out["quality"])}
    assert copies and near and not kept & (copies | near)
    assert ids(out["quality"]) - kept == copies | near


def test_repeated_passages_go_but_for_the_first(stages):
    out, passage = stages
    before = sorted((r.doc_id, r.text) for r in out["near_copies"])
    want = {d: k[3] for d, k in brute_repeats(before, 100).items()}
    after = {r.doc_id: r for r in out["repeats"]}
    assert sum(passage in r.text for r in after.values()) == 1
    assert {d: r.text.encode() for d, r in after.items()} == {d: t for d, t in want.items() if t}
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_mixed_and_packed_hold_the_same_tokens(stages):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(vocabulary(BYTE_BPE))
    out, _ = stages
    original = {r.doc_id: r.text for r in out["repeats"]}
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    total = sum(map(n, original.values()))
    assert abs(sum(n(r.text) for r in out["mixing"]) - 1.5 * total) <= 4
    assert all(original[r.doc_id].startswith(r.text) for r in out["mixing"])
    want = collections.Counter()
    for r in out["mixing"]:
        want[r.doc_id] += len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1
    got = collections.Counter()
    for r in out["packing"]:
        got[r.doc_id] += r.length
    assert got == want


def test_stages_take_odd_rows_and_none(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    good = good_text(1)
    odd = [(1, good, None, None, None, "x"), (None, good_text(2), "en", "s", 5, None), (3, None, "en", "s", 0, "x"),
           (4, "", "en", None, 0, "x"), (5, good_text(3) * 100, "en", "s", 9, "x"), (6, good, "en", "t", 7, "x"),
           (6, good, "en", "t", 7, "x"), (None, None, None, None, None, None)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, SF), name)
            if rows and name in ("quality", "near_copies", "repeats"):
                found = [r.doc_id for r in docs.collect()]
                assert {1, 5, None} <= set(found) and not {3, 4} & set(found)
                assert (6 in found) == (name == "quality")
        assert (docs.count() > 0) == bool(rows)


def test_two_texts_under_one_id_are_told_apart(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    a, b, c = good_text(1), good_text(2), good_text(3)
    near = lambda i, t: (i, t, "en", "s", len(t))
    docs = spark.createDataFrame([near(1, a), near(5, a), near(5, b), near(9, b), near(7, c)], schema)
    kept = corpus_pipeline.without_near_copies(spark, docs, SF).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, a), (5, b), (7, c)])
    passage = " ".join(good_text(9000).split()[:60])
    rows = [(1, passage), (5, a + " " + passage), (5, b + " " + passage), (7, c), (7, c)]
    docs = spark.createDataFrame([near(*r) for r in rows] + [near(None, a)], schema)
    got = corpus_pipeline.without_repeats(spark, docs, SF).collect()
    five = sorted(r.text for r in got if r.doc_id == 5)
    assert len(got) == 6 and len(five) == 2 and not any(passage in t for t in five)
    # the full stop before the passage repeats as well
    assert [t.rstrip(" .") for t in five] == sorted(t.rstrip(" .") for t in (a, b))


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).count() > 200
    assert "pipeline" in entry.queries() and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_is_registered_and_whole(spark, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    assert len(df.columns) == len(set(df.columns)) and rows
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    number = int(re.match(r"op(\d+)_", name)[1])
    if number in (1, 2, 3, 4, 6, 7, 10):
        assert len(rows) == n == len(ids(rows))
    if number == 9:
        assert len(ids(rows)) == n
    if number == 10:
        texts = sorted(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
        want = {d: (*k[:3], hashlib.sha256(k[3]).hexdigest()) for d, k in brute_repeats(texts, 100).items()}
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want


def test_token_queries_give_the_library_ids(spark):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(vocabulary(BYTE_BPE))
    texts = sorted(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
    want, at = [], 0
    for doc, text in texts:
        raw = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.append((doc, at, len(raw), zlib.crc32(raw.tobytes())))
        at += len(raw)
    assert sorted(map(tuple, QUERIES["op2_token_files"](spark, SF).collect())) == want
