"""Readers, writers and composed plans over files of their own."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from murmur.operators import breakdowns
from murmur.plans import knowledge
from murmur.sources import files, sinks


def test_runs_are_found_and_the_latest_known(spark, tmp_path):
    result = {"question": "q?", "answer": "a", "category": "c"}
    for i, body in enumerate([[result], {"schema_version": "2.0", "run_metadata": {
            "label": "second", "run_timestamp": "2024-01-02T03:04:05", "temperature": "0.1"},
            "results": [result, result]}]):
        f = tmp_path / "runs" / str(i) / f"eval_results_{i}.json"
        f.parent.mkdir(parents=True)
        f.write_text(json.dumps(body, indent=1))
        os.utime(f, (1_700_000_000 - i, 1_700_000_000 - i))
    (tmp_path / "runs" / "notes.json").write_text("{}")
    runs = files.eval_load_runs(spark, str(tmp_path / "runs"))
    got = {(r.schema_version, len(r.results)) for r in runs.collect()}
    assert got == {("1.0", 1), ("2.0", 2)}
    assert files.run_results(runs).count() == 3
    assert files.latest_run(runs).first().path.endswith("eval_results_0.json")


def test_voice_samples_are_read_from_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\nregister: wry\nsource: talk\n---\nHello there.\n")
    (tmp_path / "b.md").write_text("Plain text\n")
    (tmp_path / "_template.md").write_text("---\nregister: x\n---\nNo.")
    (tmp_path / "c.md").write_text("---\nregister: y\n---\n  \n")
    (tmp_path / "d.txt").write_text("not a sample")
    got = {tuple(r) for r in files.voice_samples_load(spark, str(tmp_path)).collect()}
    assert got == {("wry", "talk", "Hello there."), ("unspecified", "b.md", "Plain text")}


def test_answers_with_a_limit(spark, tmp_path):
    rows = [{"question": f"q{i}", "answer": f"a{i}" if i % 3 else ""} for i in range(10)]
    (tmp_path / "answers.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")
    path = str(tmp_path / "answers.jsonl")
    assert [r.question for r in files.answers_load(spark, path).orderBy("line").collect()] == [
        f"q{i}" for i in range(10) if i % 3]
    assert [r.answer for r in files.answers_load(spark, path, 2).collect()] == ["a1", "a2"]


def test_filled_catalogue_keeps_its_values(spark):
    raw = spark.createDataFrame([("p1", "T", "insight", ["a", "b"], None), ("p2", "U", None, None, ["k"])],
                                "project_id string, title string, design_insight string, tags array<string>, "
                                "mention_keywords array<string>")
    got = {r.project_id: r for r in files.projects_from(raw).collect()}
    assert got["p1"].design_insight == "insight" and got["p1"].tags == ["a", "b"]
    assert got["p1"].mention_keywords == [] and got["p2"].tags == [] and got["p2"].mention_keywords == ["k"]
    assert got["p2"].design_insight == got["p2"].walkthrough_context == got["p2"].diagram_filename == ""


def test_daily_counts_are_written(spark, tmp_path):
    turns = spark.createDataFrame([(dt.datetime(2024, 1, 1 + i % 2, 12),) for i in range(5)], "ts timestamp")
    daily = breakdowns.daily_turns(turns)
    sinks.write_daily_counts(daily, str(tmp_path / "daily"))
    got = spark.read.option("header", True).csv(str(tmp_path / "daily"))
    assert sorted(int(r.turns) for r in got.collect()) == [2, 3]


def test_chunk_store_keeps_what_is_stored(spark):
    body = "## One\n" + "first words. " * 30 + "\n## Two\n" + "other words. " * 30
    docs = spark.createDataFrame([("kb/a.md", "kb", body)], "file string, source_type string, text string")
    tiers = spark.createDataFrame([("kb", "public")], "source_type string, tier string")
    fresh = knowledge.chunk_store(docs, tiers)
    stored = fresh.where(F.col("section").contains("One") if "section" in fresh.columns else F.lit(True))
    again = knowledge.chunk_store(docs, tiers, stored)
    assert again.count() == fresh.count() >= 2
