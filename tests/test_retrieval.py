"""Matching, ranking and similarity against brute force on small random data."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from murmur.operators import entities, evals, graph, inverted, matching, projects, vectors

rng = random.Random(3)


def test_terms_in_one_block_or_many(spark, monkeypatch):
    texts = ["".join(rng.choice("abc d") for _ in range(rng.randint(0, 60))) for _ in range(80)] + [None]
    terms = ["".join(rng.choice("abc d") for _ in range(rng.randint(1, 7))) for _ in range(40)] + ["A B", "", None]
    t = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    w = spark.createDataFrame([(x,) for x in terms], "term string")
    want = {(i, x.lower()) for i, s in enumerate(texts) for x in terms if x and s and x.lower() in s}
    for size in (1 << 20, 500):
        monkeypatch.setattr(matching, "BLOCK_BYTES", size)
        got = [(r["id"], r["term"]) for r in matching.term_hits(t, "id", "text", w).collect()]
        assert set(got) == want and len(got) == len(want)
    assert matching.term_hits(t, "id", "text", w.where(F.lit(False))).collect() == []


def vector_tables(spark, n=300, q=25, d=8):
    g = np.random.default_rng(5)
    x = g.normal(size=(n, d))
    tier = ["public", "personal", "inner_circle"]
    s = spark.createDataFrame([(i, x[i].tolist(), tier[i % 3]) for i in range(n)],
                              "section_id long, embedding array<double>, sensitivity string")
    qs = spark.createDataFrame([(i, x[i * 3].tolist(), tier[i % 3], 1 + i % 6) for i in range(q)],
                               "query_id long, embedding array<double>, tier string, k int")
    want = set()
    for i in range(q):
        usable = [j for j in range(n) if j % 3 <= i % 3]
        usable.sort(key=lambda j: (round(float(np.linalg.norm(x[j] - x[i * 3])), 9), j))
        want |= {(i, r + 1, j) for r, j in enumerate(usable[:1 + i % 6])}
    return s, qs, want


def hits(df):
    return {(r["query_id"], r["rank"], r["section_id"]) for r in df.collect()}


def test_exact_search_in_one_block_or_many(spark, monkeypatch):
    s, q, want = vector_tables(spark)
    assert hits(vectors.vector_topk(s, q)) == want
    assert hits(vectors.vector_topk(s, q, block_bytes=900)) == want
    monkeypatch.setattr(vectors, "TILE_BYTES", 4096)
    assert hits(vectors.vector_topk(s, q)) == want
    nulls = q.unionByName(q.limit(1).withColumn("embedding", F.lit(None).cast("array<double>")).withColumn(
        "query_id", F.lit(99).cast("long")))
    assert hits(vectors.vector_topk(s, nulls)) == want
    assert "Exchange" not in vectors._candidates(s, q, "l2", True, 1, 1 << 20)._jdf.queryExecution().toString()


@pytest.mark.parametrize("metric", ["l2", "cosine_distance"])
def test_balls_out_of_reach_are_skipped(spark, monkeypatch, metric):
    """Batches of far clusters are left out, and nothing that counts is lost."""
    g = np.random.default_rng(2)
    middles = g.normal(size=(12, 6)) * 40
    x = np.concatenate([m + g.normal(size=(50, 6)) for m in middles])
    asked = x[::31] + 0.1
    reached = []
    own = vectors._Queries.reach

    def counting(self, block, metric, worst):
        near = own(self, block, metric, worst)
        reached.append(len(near))
        return near

    monkeypatch.setattr(vectors._Queries, "reach", counting)
    queries = vectors._Queries(np.arange(len(asked)), asked, np.full(len(asked), 4), np.zeros(len(asked)))
    batches = [pd.DataFrame({"section_id": np.arange(at, at + 50), "embedding": list(x[at:at + 50]), "tier_rank": 0})
               for at in range(0, len(x), 50)]
    kind = "l2" if metric == "l2" else "cosine"
    got = vectors._search(iter(batches), queries, kind)
    exact = queries.distances(x, kind)
    for i in range(len(asked)):
        mine = got[got["query_id"] == i].sort_values(["distance", "section_id"])["section_id"].tolist()
        assert mine == sorted(range(len(x)), key=lambda j: (round(exact[i, j], 9), j))[:4]
    assert sum(reached) < 0.7 * len(asked) * len(batches)


def test_inverted_file_of_all_cells_is_exact(spark, monkeypatch):
    s, q, want = vector_tables(spark)
    monkeypatch.setattr(inverted, "SHARD_ROWS", 7)  # crowded cells in several parts
    index = inverted.train_cells(s, q, n_cells=12)
    assert hits(inverted.approx_topk(index, q, probes=12)) == want
    assert hits(inverted.bounded_topk(index, q)) == want
    named = s.withColumn("section_id", F.format_string("s%05d", "section_id"))
    monkeypatch.setattr(vectors, "TILE_BYTES", 4096)
    index = inverted.train_cells(named, q, n_cells=12)
    assert hits(inverted.approx_topk(index, q, probes=12)) == {(a, b, f"s{c:05d}") for a, b, c in want}


def clustered(spark, n, clusters, d, seed):
    g = np.random.default_rng(seed)
    middle = g.normal(size=(clusters, d)) * 3
    x = middle[np.where(g.random(n) < 0.35, 0, g.integers(0, clusters, n))] + g.normal(size=(n, d))
    s = spark.createDataFrame([(i, v.tolist(), "public") for i, v in enumerate(x)],
                              "section_id long, embedding array<double>, sensitivity string")
    picks = x[g.permutation(n)[:160]] + 0.3 * g.normal(size=(160, d))
    q = spark.createDataFrame([(i, v.tolist(), "public", 5) for i, v in enumerate(picks)],
                              "query_id long, embedding array<double>, tier string, k int")
    return s, q


@pytest.mark.parametrize("metric", ["l2", "cosine_distance"])
@pytest.mark.parametrize("clusters,d", [(1, 16), (20, 24)])
def test_inverted_file_reaches_its_recall(spark, clusters, d, metric):
    s, q = clustered(spark, 4000, clusters, d, clusters)
    tune, other = q.where(F.col("query_id") < 80), q.where(F.col("query_id") >= 80)
    index = inverted.train_cells(s, tune, metric)
    assert len(index.centres) >= 500 and 4 * index.probes <= len(index.centres)
    assert index.recall >= inverted.TARGET and index.sizes.sum() == 4000
    exact = vectors.vector_topk(s, other, metric)
    found = inverted.recall(exact, inverted.approx_topk(index, other, metric)).collect()[0]
    assert found["exact_hits"] == 400 and found["recall"] >= inverted.TARGET
    assert hits(inverted.bounded_topk(index, other, metric)) == hits(exact)


def test_inverted_file_of_odd_tables(spark):
    _, q, _ = vector_tables(spark)
    schema = "section_id long, embedding array<double>, sensitivity string"
    for rows, want in (([], 0), ([(1, None, "public")], 0), ([(1, [1.0] * 8, "public"), (2, None, "public")], 1),
                       ([(i, [1.0] * 8, "public") for i in range(30)], 6)):
        index = inverted.train_cells(spark.createDataFrame(rows, schema), q)
        got = inverted.approx_topk(index, q).collect()
        assert max([r["rank"] for r in got], default=0) == want
        assert hits(inverted.bounded_topk(index, q)) == {(r["query_id"], r["rank"], r["section_id"]) for r in got}
    none = q.where(F.lit(False))
    index = inverted.train_cells(vector_tables(spark)[0], none)
    assert inverted.approx_topk(index, none).collect() == []


def test_rank_compare_of_itself_has_no_drift(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "a", 3)],
                               "query_id int, label string, rank int")
    rows = vectors.rank_compare(df, df).collect()
    assert len(rows) == 2 and all(r["drift"] == 0 and r["state"] == "same" for r in rows)


def test_rank_states(spark):
    schema = "query_id int, label string, rank int"
    left = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (1, "l", 4)], schema)
    right = spark.createDataFrame([(1, "c", 1), (1, "b", 2), (1, "a", 3), (1, "r", 4)], schema)
    got = {r["label"]: r["state"] for r in vectors.rank_compare(left, right).collect()}
    assert got == {"a": "promoted", "b": "same", "c": "demoted", "l": "left only", "r": "right only"}


def test_length_and_entity_bonus_edges(spark):
    rows = [(1, i, 0.5, p, e, c, 9) for i, (p, e, c) in enumerate(
        [(0, 0, 2000), (0, 0, 2001), (2, 0, 10), (0, 5, 10), (0, 9, 10)])]
    cand = spark.createDataFrame(rows, "query_id int, section_id int, vector_score double, "
                                 "projects_described int, entities_mentioned int, char_count int, k int")
    got = {r["section_id"]: round(r["final_score"], 6) for r in vectors.rerank(cand).collect()}
    assert got == {0: 0.425, 1: 0.445, 2: 0.505, 3: 0.475, 4: 0.475}


def test_project_similarity_brute_force(spark):
    rows = set()
    for p in range(25):
        rows.add((f"p{p:02}", "methods", "hot", rng.choice(["x", "y"])))
        if p % 6 == 0:
            rows.add((f"p{p:02}", "methods", "hot", "z"))
        for _ in range(rng.randint(0, 4)):
            rows.add((f"p{p:02}", rng.choice(["methods", "technologies"]),
                      f"e{rng.randint(0, 8)}", rng.choice(["x", "y", None])))
    df = spark.createDataFrame(sorted(rows, key=repr),
                               "project string, kind string, entity string, detail string")
    paths = Counter((p, k, e) for p, k, e, _ in rows)
    want = {}
    names = sorted({p for p, *_ in rows})
    for a, b in itertools.combinations(names, 2):
        per = {k: sum(n * paths[(b, kk, e)] for (p, kk, e), n in paths.items() if p == a and kk == k)
               for k in ("methods", "technologies")}
        m, t = (per[k] if per[k] >= 2 else None for k in ("methods", "technologies"))
        if m or t:
            want[(a, b)] = (m, t, "methods" if m else "technologies")
    got = {(r["a"], r["b"]): (r["shared_methods"], r["shared_technologies"], r["basis"])
           for r in graph.project_similarity(df).collect()}
    assert got == want


def test_mention_scores(spark):
    cat = spark.createDataFrame([
        ("p1", 0, "Stone Bridge", "s", ["rivers"], ["water map"]),
        ("p2", 1, "Corn Ledger", "s", ["crops", "maps"], [])],
        "project_id string, order int, title string, summary string, tags array<string>, mention_keywords array<string>")
    msg = spark.createDataFrame([
        ("a", "Tell me of the WATER MAP"), ("b", "stone bridge and rivers"),
        ("c", "a bridge with crops"), ("d", "nothing")], "message_id string, message string")
    got = {(r["message_id"], r["project_id"]): r["score"]
           for r in projects.mention_scores(msg, cat).collect()}
    assert got == {("a", "p1"): 10, ("b", "p1"): 9, ("c", "p1"): 2, ("c", "p2"): 1}
    best = {r["message_id"]: r["project_id"] for r in projects.find_mentioned(msg, cat).collect()}
    assert best == {"a": "p1", "b": "p1"}


def scores_by_definition(msg, cat):
    out = {}
    for m, body in msg:
        low, words = (body or "").lower(), set(re.findall(r"\w+", (body or "").lower()))
        for p, order, title, _, tags, kws in cat:
            full = bool(title) and title.lower() in low
            named = {w for w in re.findall(r"\w+", (title or "").lower()) if len(w) >= 4}
            score = (10 * sum(k.lower() in low for k in kws or [] if k) + (8 if full else 2 * len(named & words))
                     + len(set(tags or []) & words))
            if score > 0:
                out[(m, p)] = (score, order)
    return out


@pytest.mark.parametrize("size", [1 << 20, 900])
def test_projects_of_many_messages_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(matching, "BLOCK_BYTES", size)
    g = random.Random(11)
    words = ["common", "Stone", "river", "crop", "map", "the", "walk", "of", "ledger", "corn", "x1", "tide", "of"]
    phrase = lambda lo, hi: " ".join(g.choice(words) for _ in range(g.randint(lo, hi)))
    cat = [(f"p{i}", g.randint(0, 9), phrase(0, 3) if i else None, phrase(0, 6), ["common", *phrase(0, 2).split()],
            [phrase(0, 2), phrase(1, 2)] if i % 5 else None) for i in range(40)]
    cat = [(*c[:4], list(map(str.lower, c[4])), c[5]) for c in cat]
    msg = [(f"m{i}", None if i == 3 else phrase(0, 7)) for i in range(120)]
    c = spark.createDataFrame(cat, "project_id string, order int, title string, summary string, "
                                   "tags array<string>, mention_keywords array<string>")
    m = spark.createDataFrame(msg, "message_id string, message string")
    want = scores_by_definition(msg, cat)
    got = {(r["message_id"], r["project_id"]): r["score"] for r in projects.mention_scores(m, c).collect()}
    assert got == {k: s for k, (s, _) in want.items()}
    best = {}
    for (k, p), (score, order) in want.items():
        if score >= projects.MENTION_THRESHOLD:
            best.setdefault(k, []).append((-score, order, p))
    found = {r["message_id"]: (-r["score"], r["project_id"]) for r in projects.find_mentioned(m, c).collect()}
    assert found.keys() == best.keys()
    assert all((s, p) in {(a, q) for a, o, q in best[k] if (a, o) == min(best[k])[:2]} for k, (s, p) in found.items())
    chosen = {r["message_id"]: r for r in projects.walkthrough_select(m, c, F.lit(True)).collect()}
    assert len(chosen) == len(msg)
    ids = [p for _, p in sorted((o, p) for p, o, *_ in cat)]
    for k, body in msg:
        meaning = {w for w in re.findall(r"\w+", (body or "").lower()) if len(w) > 2} - set(projects.GENERIC_WORDS)
        draw = lambda *parts: hashlib.md5("|".join(parts).encode()).hexdigest()
        common = {p: len(meaning & set(re.findall(r"\w+", " ".join([(t or ""), s, *tags]).lower())))
                  for p, _, t, s, tags, _ in cat}
        if k in best:
            assert chosen[k]["how"] == "mention" and chosen[k]["project_id"] == found[k][1]
        elif len(meaning) >= 2 and max(common.values()):
            top = min((-n, draw(k, p, "0"), p) for p, n in common.items() if n)
            assert (chosen[k]["how"], chosen[k]["project_id"]) == ("overlap", top[2])
        else:
            assert (chosen[k]["how"], chosen[k]["project_id"]) == ("draw", ids[int(draw(k, "0")[:8], 16) % len(ids)])


def test_relationship_status(spark):
    df = spark.createDataFrame([(1, 2, 3), (2, 1, 3), (3, 1, 1), (4, 0, 2)],
                               "q int, n_found int, n_expected int")
    got = {r["q"]: r["status"] for r in evals.relationship_status(df).collect()}
    assert got == {1: "success", 2: "partial", 3: "success", 4: "failure"}


def test_rank_metrics(spark):
    df = spark.createDataFrame([(1,), (2,), (4,), (0,)], "rank int")
    row = evals.rank_metrics(df).collect()[0]
    assert (row["top1_pct"], row["top3_pct"], row["mrr"]) == (25.0, 50.0, 0.4375)


def test_occurrence_rule_for_prominence(spark):
    cat = spark.createDataFrame([("p1", 1, "Alpha"), ("p0", 0, "Beta")],
                                "project_id string, order int, title string")
    pad = "x" * 320
    docs = spark.createDataFrame([(1, "about alpha"), (2, pad + " alpha"), (3, pad + " ALPHA alpha"),
                                  (4, "alpha beta")], "doc_id int, text string")
    got = {r["doc_id"]: r["project_id"] for r in projects.prominent_project(docs, cat).collect()}
    assert got == {1: "p1", 3: "p1", 4: "p0"}


def test_exact_search_of_long_vectors(spark):
    """Rounding in rough distances grows with the norms; near-equal vectors must not get lost."""
    g = np.random.default_rng(8)
    x = 1e6 * np.ones((200, 8)) + g.normal(size=(200, 8))
    s = spark.createDataFrame([(i, v.tolist(), "public") for i, v in enumerate(x)],
                              "section_id long, embedding array<double>, sensitivity string")
    q = spark.createDataFrame([(i, x[i].tolist(), "public", 5) for i in range(30)],
                              "query_id long, embedding array<double>, tier string, k int")
    want = set()
    for i in range(30):
        near = sorted(range(200), key=lambda j: (round(float(np.linalg.norm(x[j] - x[i])), 9), j))
        want |= {(i, r + 1, j) for r, j in enumerate(near[:5])}
    assert hits(vectors.vector_topk(s, q)) == want


def test_project_similarity_shuffles_no_pairs(spark):
    """The counts of a pair are made up where the rows of its first project lie."""
    df = spark.createDataFrame([(f"p{p}", "methods", f"e{e}", None) for p in range(9) for e in range(4)],
                               "project string, kind string, entity string, detail string")
    out = graph.project_similarity(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*\ba#\d+[^)]*\bb#\d+", plan)
    assert {(r["a"], r["b"], r["shared_methods"]) for r in out.collect()} == {
        (f"p{a}", f"p{b}", 4) for a, b in itertools.combinations(range(9), 2)}


@pytest.mark.parametrize("wide", [1, 3, 256])
def test_project_similarity_wide_entities(spark, monkeypatch, wide):
    monkeypatch.setattr(graph, "WIDE", wide, raising=False)
    test_project_similarity_brute_force(spark)


def test_recall_of_given_cells(spark):
    """``approx_recall`` counts what the search of given cells finds, not only whether a target is met."""
    made = np.random.default_rng(11).normal(size=(60, 4))
    sections = spark.createDataFrame(
        [(i, [float(x) for x in v], "public") for i, v in enumerate(made)] + [(99, None, "public")],
        "section_id long, embedding array<float>, sensitivity string")
    queries = spark.createDataFrame([(i, [float(x) for x in made[i] + 0.1], "public", 5) for i in range(6)],
                                    "query_id long, embedding array<float>, tier string, k int")
    order = sorted(range(60), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    centres = made.astype(np.float32).astype(float)[order[:6]]
    assert np.array_equal(inverted.pivots(sections, 6), centres)
    assert inverted.pivots(sections.where("section_id = 99"), 6).shape[0] == 0
    rows, asked = made.astype(np.float32).astype(float), (made[:6] + 0.1).astype(np.float32).astype(float)
    far = lambda a, b: np.linalg.norm(a[:, None] - b[None], axis=2)
    own, want = far(rows, centres).argmin(1), 0
    for i in range(6):
        seen = set(np.argsort(far(asked, centres)[i], kind="stable")[:2])
        best = np.argsort(far(asked, rows)[i], kind="stable")
        want += len(set(best[:5]) & set([j for j in best if own[j] in seen][:5]))
    index = inverted.cells_of(sections, inverted.pivots(sections, 6), probes=2)
    got = inverted.recall(vectors.vector_topk(sections, queries), inverted.approx_topk(index, queries)).first()
    assert (got["exact_hits"], got["found"]) == (30, want) and want < 30
    assert "count(n.rank)" in entry.oracle_sql()["approx_recall"]


def test_first_rows_are_picked_after_like_rows_are_combined(spark):
    """What reads the rows themselves is a hash aggregate: no sort of all rows of a task."""
    rows = spark.createDataFrame([("k", n, s) for s, n in enumerate(["B", "a ", "b", "A", "B", "a"] * 3)] +
                                 [("k", "c", None), (None, "d", 7)], "kind string, name string, seq long")
    out = entities.dedupe_first(rows, [F.col("kind"), entities.fold(F.col("name"))])
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(
        [("k", "B", 0), ("k", "a ", 1), (None, "d", 7), (None, None, None)], key=repr)
    plan = out._jdf.queryExecution().sparkPlan().toString().splitlines()
    assert "HashAggregate" in [x for x in plan if "Aggregate" in x][-1]
