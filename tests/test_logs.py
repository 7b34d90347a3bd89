"""Loading, filtering and session edge rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from murmur.operators import filters, kpis, sessions
from murmur.sources import logs

LINES = [
    '{"ts": "2024-01-01T05:00:00Z", "session_id": "a", "turn_index": 1, "message": "hi ", "had_error": "yes", "x": 1}',
    "   ", '{"a":', "{'a': 1}", '{"a": 1} trailing', "[1]", "null", "{}",
    '{"event": "vote", "liked": true, "session_id": "b", "is_owner_traffic": 1}',
    '{"ts": "bad", "session_id": "b", "message": null, "latency_ms": "12.5"}',
]


def parsed(spark):
    df = spark.createDataFrame(list(enumerate(LINES)), "n int, value string")
    return logs.parse_lines(df)


def test_good_and_bad_lines(spark):
    p = parsed(spark)
    bad = {r["n"]: r["reason"] for r in logs.bad_lines(p).collect()}
    assert set(bad) == {2, 3, 4, 5, 6}
    chats = {r["n"]: r for r in logs.chat_rows(p, ("n",)).collect()}
    assert set(chats) == {0, 7, 9}
    assert chats[0]["message"] == "hi" and chats[0]["had_error"] is True
    assert chats[9]["ts"] is None and chats[9]["latency_ms"] == 12.5 and chats[9]["message"] == ""
    assert chats[7]["session_id"] == "" and chats[7]["model"] is None
    vote = logs.vote_rows(p, ("n",)).collect()
    assert [r["n"] for r in vote] == [8] and vote[0]["is_owner_traffic"] is True
    meta = logs.load_meta(p).collect()[0].asDict()
    assert meta == {"malformed_rows": 5, "total_rows": 4, "chat_rows": 3, "vote_rows": 1}


def test_default_fill_turns_missing_into_gaps(spark):
    p = parsed(spark)
    strict = filters.flag_turns(logs.chat_rows(p, ("n",)))
    filled = filters.flag_turns(logs.chat_rows(p, ("n",), "default_fill"))
    assert {r["is_knowledge_gap"] for r in strict.collect()} == {None}
    assert {r["is_knowledge_gap"] for r in filled.collect()} == {True}


def test_artifacts(spark):
    got = {r["n"]: r["reason"] for r in logs.artifacts(parsed(spark), ("n",)).collect()}
    assert got == {2: "json_decode_error", 3: "json_decode_error", 4: "json_decode_error",
                   5: "json_decode_error", 6: "json_decode_error",
                   7: "missing_ts_or_empty_message", 9: "missing_ts_or_empty_message"}


def test_load_from_files(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text("\n".join(LINES))
    chats, votes, meta = logs.load_query_log(spark, str(tmp_path), "2024-01-01", "2024-01-01",
                                             "session")
    assert chats.count() == 2 and votes.count() == 0
    assert meta.collect()[0]["malformed_rows"] == 5


@pytest.mark.parametrize("day,offset", [("2024-01-15", 6), ("2024-07-15", 5)])
def test_cutoff_is_local_midnight(spark, day, offset):
    midnight = dt.datetime.fromisoformat(day) + dt.timedelta(hours=offset)
    rows = [(1, midnight), (2, midnight - dt.timedelta(seconds=1)), (3, None)]
    df = spark.createDataFrame(rows, "n int, t timestamp_ntz").select(
        "n", F.col("t").cast("timestamp").alias("ts"))
    assert {r["n"] for r in filters.cutoff_local(df, day).collect()} == {1, 3}


def test_date_range_keeps_null_and_ignores_bad_bounds(spark):
    df = spark.sql("SELECT 1 n, timestamp'2024-01-02 23:59:59.999999' ts UNION ALL "
                   "SELECT 2, timestamp'2024-01-03 00:00:00' UNION ALL SELECT 3, null")
    kept = lambda *a: {r["n"] for r in filters.date_range(df, *a).collect()}
    assert kept("2024-01-02", "2024-01-02") == {1, 3}
    assert kept("not a date", None) == {1, 2, 3}


def owner_rows(spark):
    schema = "row_id int, session_id string, is_owner_traffic boolean, event string"
    chats = spark.createDataFrame([(1, "", True, None), (2, "", None, None), (3, "v", None, None),
                                   (4, "o", True, None), (5, "o", False, None), (6, "k", False, None)],
                                  schema)
    votes = spark.createDataFrame([(7, "v", True, "vote"), (8, "k", None, "vote"), (9, "o", None, "vote")],
                                  schema)
    return chats, votes


@pytest.mark.parametrize("mode,kept", [
    ("none", {1, 2, 3, 4, 5, 6, 7, 8, 9}), ("row", {2, 3, 5, 6, 8, 9}), ("session", {2, 6, 8})])
def test_owner_filter(spark, mode, kept):
    chats, votes = filters.exclude_owner(*owner_rows(spark), mode)
    assert {r["row_id"] for r in chats.unionByName(votes).collect()} == kept


def turns(spark, rows):
    schema = ("row_id int, session_id string, ts string, turn_index int, message string, "
              "latency_ms double, chunk_similarity_avg double, cost_usd double, had_error boolean")
    return spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp"))


def test_session_edges(spark):
    rows = [
        (1, "", "2024-01-01 00:00:00", 1, "x", None, None, None, None),
        (2, None, "2024-01-01 00:00:01", 1, "y", None, None, None, None),
        (3, "s", "2024-01-01 00:00:00", 2, "second", None, 0.5, 0.1, True),
        (4, "s", "2024-01-01 00:00:00", 1, "first", None, None, 0.2, False),
        (5, "s", None, 3, "last", 5.0, None, None, None),
    ]
    got = {r["session_id"]: r for r in sessions.session_summary(turns(spark, rows)).collect()}
    assert set(got) == {"__missing_session__:1", "__missing_session__:2", "s"}
    s = got["s"]
    assert (s["first_message"], s["last_message"], s["turns"]) == ("first", "last", 3)
    assert s["avg_latency_ms"] == 5.0 and s["total_cost_usd"] == 0.3 and s["error_turns"] == 1
    assert got["__missing_session__:1"]["avg_latency_ms"] is None
    assert sessions.real_sessions(sessions.session_summary(turns(spark, rows))).count() == 1


def test_kpis_of_nothing(spark):
    empty = turns(spark, []).withColumn("empty_response", F.lit(False))
    row = kpis.overall_kpis(empty).collect()[0]
    assert row["total_chat_turns"] == 0 and row["p95_latency_ms"] == 0.0
    assert row["bounce_rate_pct"] == 0.0


def test_equal_lines_without_session_stay_apart(spark, tmp_path):
    line = '{"ts": "2024-01-01T10:00:00", "session_id": "", "message": "ping"}\n'
    (tmp_path / "log.jsonl").write_text(line * 6)
    chats, _, _ = logs.load_query_log(spark, str(tmp_path), owner_filter="none")
    assert chats.count() == 6
    assert sessions.session_summary(chats).count() == 6
