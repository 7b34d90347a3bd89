"""Streams over several micro-batches give the batch result."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from murmur.sources import tables
from murmur.streaming import jobs, state
from murmur.streaming.ordered import finish, run_ordered
from murmur.streaming.sinks import (
    LateRows,
    latest,
    run_and_keep,
    run_available,
    start_flush,
    write_batches,
)

START = dt.datetime(2024, 1, 1)


def files(spark, tmp_path, frames):
    """Several input files, read one per micro-batch in the order given."""
    import os

    path = tmp_path / "in"
    for i, rows in enumerate(frames):
        df = spark.createDataFrame(rows, "row_id long, session_id string, t timestamp_ntz, cost_usd double, "
                                   "had_error boolean, workflow string")
        target = str(path / f"part{i}")
        df.coalesce(1).write.parquet(target)
        for f in os.listdir(target):
            os.utime(os.path.join(target, f), (1_700_000_000 + i, 1_700_000_000 + i))
    stream = (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", True).parquet(str(path)))
    cast = lambda d: d.withColumn("ts", F.col("t").cast("timestamp"))
    return cast(stream), cast(spark.read.option("recursiveFileLookup", True).parquet(str(path)))


def rows(lo, hi):
    return [(i, f"s{i % 4}" if i % 5 else "", START + dt.timedelta(minutes=i), i / 1000.0,
             i % 3 == 0, "standard" if i % 2 else "walkthrough") for i in range(lo, hi)]


def test_session_summary_over_batches(spark, tmp_path):
    stream, batch = files(spark, tmp_path, [rows(0, 40), rows(40, 55), rows(55, 90)])
    written = run_available(jobs.session_parts(stream, "10 days", "20 minutes"), "t-sessions", "update")
    got = {tuple(r) for r in jobs.merge_sessions(latest(written, ["session_id", "w"])).select(
        "session_id", "turns", "total_cost_usd", "error_turns", "last_workflow").collect()}
    assert written.select("batch_id").distinct().count() >= 3
    want = {}
    for r in batch.orderBy("ts").collect():
        key = r["session_id"] or f"__missing_session__:{r['row_id']}"
        n, c, e, _ = want.get(key, (0, 0.0, 0, None))
        want[key] = (n + 1, round(c + r["cost_usd"], 6), e + int(r["had_error"]), r["workflow"])
    assert got == {(k, *v) for k, v in want.items()}


def test_dedupe_across_batches(spark, tmp_path):
    stream, _ = files(spark, tmp_path, [rows(0, 30), rows(20, 50)])
    out = run_available(jobs.dedupe(stream.select("row_id", "ts"), late="10 days"), "t-dedupe")
    assert sorted(r["row_id"] for r in out.collect()) == list(range(50))


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    late = [(900 + i, "z", START - dt.timedelta(days=3), 0.0, False, "standard") for i in range(3)]
    stream, _ = files(spark, tmp_path, [rows(0, 90), rows(90, 100), late])
    listener = LateRows()
    spark.streams.addListener(listener)
    try:
        out = run_available(jobs.dedupe(stream.select("row_id", "ts"), late="10 minutes"), "t-late")
        assert sorted(r["row_id"] for r in out.collect()) == list(range(100))
        for _ in range(50):
            if sum(listener.dropped.values()) == 3:
                break
            time.sleep(0.2)
        assert sum(listener.dropped.values()) == 3
    finally:
        spark.streams.removeListener(listener)


@pytest.mark.parametrize("job", [jobs.session_parts, jobs.kpi_parts])
def test_state_goes_with_the_watermark(spark, tmp_path, job):
    months = [[(100 * m + i, f"s{i}-{m}", START + dt.timedelta(days=60 * m, minutes=20 * i), 0.0, False, "standard")
               for i in range(40)] for m in range(3)]
    stream, _ = files(spark, tmp_path, months)
    stream = stream.withColumn("chunk_similarity_avg", F.lit(0.5))
    query = (write_batches(job(stream), str(tmp_path / "out")).outputMode("update")
             .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(held) >= 3 and max(held) <= 80 and held[-1] <= 40


def test_flush_writes_once(spark, tmp_path):
    stream, _ = files(spark, tmp_path, [rows(0, 20), rows(20, 30)])
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for _ in range(2):
        query = start_flush(stream.select("row_id"), out, ck, "1 second")
        query.processAllAvailable()
        query.stop()
    assert sorted(r["row_id"] for r in spark.read.parquet(out).collect()) == list(range(30))


# --- ordered rows ---------------------------------------------------------------------

def replayed(spark, rows, schema, seconds, batches):
    df = spark.createDataFrame(rows, schema)
    return tables.replay(df, "ts", seconds, batches)


EVENT = "session string, ts timestamp, pos long, kind string, text string, flag boolean"
TIERS = {"personal": ["red"], "inner_circle": ["blue"]}


def conversation(name, n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.choice(["user", "user", "assistant", "vote", "owner", "system"])
        text = rng.choice([None, "", "red", "a blue b", f"text {i}"])
        out.append((name, START + dt.timedelta(seconds=20 * i), i, kind, text, rng.choice([True, False, None])))
    return out


def by_definition(rows):
    out, names = [], ["public", "personal", "inner_circle"]
    state = {}
    for session, _, pos, kind, text, flag in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
        turns, tier, owner, said, answered = state.get(session, (0, 0, False, None, None))
        if kind == "owner":
            owner = bool(flag)
        if kind == "user":
            rank = 2 if "blue" in (text or "") else 1 if "red" in (text or "") else 0
            turns, tier, said = turns + 1, max(tier, rank), text
        if kind == "assistant":
            answered = text
        state[session] = turns, tier, owner, said, answered
        vote = kind == "vote"
        out.append((session, pos, kind, turns, names[tier], owner, said if vote else None, answered if vote else None))
    return out


def test_session_state_of_shuffled_batches(spark):
    rows = conversation("hot", 400, 1) + [r for i in range(12) for r in conversation(f"s{i}", 9, 2 + i)]
    events = state.session_events(replayed(spark, rows, EVENT, 900, 6), TIERS)
    out = jobs.run_to_end(events, state.SESSION, "t-ordered", "15 minutes")
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(by_definition(rows), key=repr)


def test_a_long_session_waits_for_the_watermark_only(spark, tmp_path):
    rows = conversation("hot", 3000, 3)
    events = state.session_events(replayed(spark, rows, EVENT, 300, 10), TIERS)
    query = (write_batches(run_ordered(events, state.SESSION, "5 minutes"), str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    query.awaitTermination()
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").load(str(tmp_path / "ck"))
    assert waiting.count() <= 16  # five minutes of a turn every twenty seconds
    written = spark.read.parquet(str(tmp_path / "out"))
    sizes = [r["count"] for r in written.groupBy("batch_id").count().collect()]
    assert len(sizes) >= 9 and max(sizes) <= 3000 / 10 + 32
    rest = finish(events, state.SESSION, str(tmp_path / "ck"))
    got = [tuple(r) for r in written.drop("batch_id").unionByName(rest).collect()]
    assert sorted(got, key=repr) == sorted(by_definition(rows), key=repr)


def test_idle_sessions_start_anew(spark):
    first = [("a", START + dt.timedelta(minutes=i), i, "user", "red", None) for i in range(3)]
    others = [("b", START + dt.timedelta(hours=h), h, "user", "x", None) for h in range(9)]
    again = [("a", START + dt.timedelta(hours=8, minutes=i), 10 + i, "user", "x", None) for i in range(2)]
    events = replayed(spark, first + others + again, EVENT, 1, 9)
    written, checkpoint = run_and_keep(state.session_state(events, TIERS, "1 minute", forget_hours=2), "t-idle")
    last = finish(state.session_events(events, TIERS), state.SESSION, checkpoint)
    got = {(r["session"], r["pos"]): (r["turn_index"], r["audience_tier"])
           for r in written.drop("batch_id").unionByName(last).collect()}
    assert got[("a", 2)] == (3, "personal") and got[("a", 11)] == (2, "public") and got[("b", 8)][0] == 9


def flushed(rows, last):
    """Buffers of a session by their definition."""
    out, held, number = [], [], 0
    for at, row in sorted(rows):
        if held and at - held[0][0] >= 300:
            number += 1
            out += [(r, number, "time") for _, r in held]
            held = []
        held.append((at, row))
        if len(held) == 10:
            number += 1
            out += [(r, number, "count") for _, r in held]
            held = []
    reason = "time" if held and last >= held[0][0] + 300 else "end"
    return out + [(r, number + 1, reason) for _, r in held]


def test_flush_at_the_tenth_turn_or_after_five_minutes(spark):
    rng = random.Random(7)
    rows, at = [], {"hot": 0, "slow": 0, "mixed": 0}
    for i in range(600):
        name = rng.choice(["hot", "hot", "hot", "slow", "mixed"])
        at[name] += {"hot": 5, "slow": 170, "mixed": rng.choice([1, 1, 1, 200])}[name]
        rows.append((name, START + dt.timedelta(seconds=at[name]), i))
    stream = replayed(spark, rows, "session string, ts timestamp, row_id long", 60, 8)
    got = jobs.run_to_end(stream, state.flush_job(), "t-flush", "1 minute").collect()
    last = max(at.values()) - 60
    for name in at:
        want = flushed([((t - START).total_seconds(), r) for n, t, r in rows if n == name], last)
        mine = [(r["row_id"], r["flush"], r["reason"]) for r in got if r["session"] == name]
        assert sorted(mine) == sorted(want)
    assert {r["reason"] for r in got} == {"count", "time", "end"}


def test_flush_on_time_needs_no_further_turn(spark, tmp_path):
    rows = [("quiet", START + dt.timedelta(seconds=i), i) for i in range(4)]
    rows += [("busy", START + dt.timedelta(seconds=100 * i), 100 + i) for i in range(20)]
    stream = replayed(spark, rows, "session string, ts timestamp, row_id long", 1, 4)
    out, _ = run_and_keep(run_ordered(stream, state.flush_job(), "1 second"), "t-quiet")
    quiet = out.where(F.col("session") == "quiet").collect()
    assert {(r["row_id"], r["flush"], r["reason"]) for r in quiet} == {(i, 1, "time") for i in range(4)}
    assert max(r["batch_id"] for r in quiet) < out.agg(F.max("batch_id")).first()[0]


def test_open_sessions_are_read_from_the_state(spark):
    rows = [(u, START + dt.timedelta(minutes=m)) for u in ("a", "b") for m in (0, 10, 25, 90, 100, 300, 310)]
    stream = replayed(spark, rows, "user string, ts timestamp", 3600, 3)
    got = jobs.whole_gap_sessions(stream).collect()
    want = {(u, START + dt.timedelta(minutes=a), START + dt.timedelta(minutes=b + 30), n)
            for u in ("a", "b") for a, b, n in ((0, 25, 3), (90, 100, 2), (300, 310, 2))}
    assert {(r["user"], r["session_start"], r["session_end"], r["turns"]) for r in got} == want and len(got) == 6


def test_a_stream_of_nothing(spark):
    stream = replayed(spark, [], "session string, ts timestamp, row_id long", 60, 4)
    assert run_and_keep(run_ordered(stream, state.flush_job(), "1 minute"), "t-none")[0].collect() == []


@pytest.mark.parametrize("folder", [False, True])
def test_stream_of_a_table_in_one_file_or_many(spark, tmp_path, folder):
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = tmp_path / "conversations.parquet"
    if folder:
        path.mkdir()
    for i in range(3 if folder else 1):
        pq.write_table(pa.table({"conv_id": [i], "text": [f"mail me@x{i}.org"]}),
                       path / f"part-{i}.parquet" if folder else path)
    pq.write_table(pa.table({"other": [1.5]}), tmp_path / "labels.parquet")
    rows = run_available(tables.stream_table(spark, str(tmp_path), "conversations"), "t-table")
    assert sorted(r["conv_id"] for r in rows.collect()) == ([0, 1, 2] if folder else [0])


def test_replayed_batches_of_several_files(spark, monkeypatch):
    """Batches of several files stay whole and in order, also one with fewer rows than files."""
    monkeypatch.setattr(tables, "FILE_ROWS", 20, raising=False)
    rows = [("a", START + dt.timedelta(seconds=i), i) for i in (*range(100), *range(200, 202), *range(300, 400))]
    stream = replayed(spark, rows, "session string, ts timestamp, row_id long", 1, 4)
    out = run_available(stream, "t-files").select("row_id", "batch_id", F.input_file_name().alias("f")).collect()
    assert sorted(r["row_id"] for r in out) == [r for _, _, r in rows]
    batches = [[r["row_id"] for r in out if r["batch_id"] == b] for b in sorted({r["batch_id"] for r in out})]
    assert [len(b) for b in batches] == [100, 2, 100] and max(batches[0]) < 101 and min(batches[2]) > 299
    assert len({r["f"] for r in out if r["batch_id"] == min(x["batch_id"] for x in out)}) > 1


def test_state_is_held_by_buckets_of_sessions(spark, monkeypatch):
    from murmur.streaming import ordered

    monkeypatch.setattr(ordered, "BUCKETS", 3, raising=False)
    rows = [r for i in range(20) for r in conversation(f"s{i}", 7, 50 + i)]
    rows += [(None, *r[1:]) for r in conversation("none", 5, 99)]
    events = state.session_events(replayed(spark, rows, EVENT, 60, 3), TIERS)
    written, checkpoint = run_and_keep(run_ordered(events, state.SESSION, "1 minute"), "t-buckets")
    held = spark.read.format("statestore").option("stateVarName", "waiting").load(checkpoint)
    assert held.select("key").distinct().count() <= 3
    out = written.drop("batch_id").unionByName(finish(events, state.SESSION, checkpoint)).collect()
    key = lambda r: (str(r[0]), *map(repr, r[1:]))
    none = [("", *r[1:]) if r[0] is None else r for r in rows]
    want = [(r[0] or None, *r[1:]) for r in by_definition(none)]
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key)
