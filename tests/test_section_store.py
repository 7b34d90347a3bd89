"""Bucketed section store: what an upsert writes and what a reader sees."""

import pytest

from murmur.sources import section_store as store

STORED = "section_id long, content_hash string, full_text string, embedding array<double>"
CURRENT = "section_id long, content_hash string, full_text string"


def rows(df):
    return {r["section_id"]: (r["content_hash"], r["full_text"], r["embedding"]) for r in df.collect()}


def test_upsert_writes_touched_buckets_only(spark, tmp_path):
    root = str(tmp_path / "store")
    old = [(i, f"h{i}", f"t{i}", [float(i)]) for i in range(200)]
    assert store.create(spark, root, spark.createDataFrame(old, STORED), buckets=32) == 1
    changes = [(3, "h3", "t3"), (4, "new", "other"), (500, "h500", None)]
    assert store.upsert(spark, root, spark.createDataFrame(changes, CURRENT)) == 2
    written = {p.name for p in (tmp_path / "store/data/store_version=2").glob("store_bucket=*")}
    assert 1 <= len(written) <= 3
    want = {i: (h, t, e) for i, h, t, e in old}
    assert rows(store.read(spark, root, 1)) == want
    assert rows(store.read(spark, root)) == {**want, 4: ("new", "other", None), 500: ("h500", None, None)}


def test_unfinished_upsert_is_not_seen(spark, tmp_path):
    root = str(tmp_path / "store")
    store.create(spark, root, spark.createDataFrame([(1, "a", "x", None)], STORED), buckets=2)
    spark.createDataFrame([(1, "b", "y", None)], STORED).write.parquet(
        f"{root}/data/store_version=2/store_bucket=0")
    assert rows(store.read(spark, root)) == {1: ("a", "x", None)}
    assert store.upsert(spark, root, spark.createDataFrame([(2, "c", "z")], CURRENT)) == 2
    assert rows(store.read(spark, root)) == {1: ("a", "x", None), 2: ("c", "z", None)}


def test_empty_tables_and_unknown_versions(spark, tmp_path):
    root = str(tmp_path / "store")
    store.create(spark, root, spark.createDataFrame([], STORED))
    assert store.read(spark, root).count() == 0
    assert store.upsert(spark, root, spark.createDataFrame([], CURRENT)) == 1
    assert store.upsert(spark, root, spark.createDataFrame([(7, "a", "")], CURRENT)) == 2
    assert rows(store.read(spark, root)) == {7: ("a", "", None)}
    with pytest.raises(ValueError):
        store.read(spark, root, 9)
