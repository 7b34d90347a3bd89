"""Column helpers on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from murmur.functions import loose, numeric, text
from murmur.operators import enrich


def values(spark, rows, column, schema="x string"):
    df = spark.createDataFrame([(r,) for r in rows], schema)
    return [r[0] for r in df.select(column).collect()]


def test_redaction(spark):
    got = values(spark, ["mail a.b@c.org now", "call 512-555-1234", "call (512) 555-1234",
                         "+1 512.555.1234", "no pii 2024", "", None, "x@y.com and 5125551234"],
                 text.redact_pii(F.col("x")))
    assert got == ["mail [EMAIL] now", "call [PHONE]", "call ([PHONE]", "+[PHONE]",
                   "no pii 2024", "", "", "[EMAIL] and [PHONE]"]


@pytest.mark.parametrize("n,expected", [(299, 299), (300, 300), (301, 300), (400, 300)])
def test_preview_length(spark, n, expected):
    got = values(spark, ["a" * n], text.response_preview(F.col("x")))[0]
    assert len(got) == expected
    assert got.endswith("…") == (n > 300)


def test_preview_whitespace(spark):
    assert values(spark, [" a\nb ", None], text.response_preview(F.col("x"))) == ["a b", ""]


def test_normalize_prompt(spark):
    got = values(spark, ["  What's  (this) — REALLY?! ", None, "a-b; c"],
                 text.normalize_prompt(F.col("x")))
    assert got == ["whats this really", "", "ab c"]


def test_loose_bool_text(spark):
    got = values(spark, ["true", "Yes", " n ", "1", "0", "2", "1.0", None],
                 loose.loose_bool_text(F.col("x")))
    assert got == [True, True, False, True, False, None, None, None]


def test_loose_bool_keeps_number_and_text_apart(spark):
    df = spark.createDataFrame([(s,) for s in [
        '{"f": true}', '{"f": 1}', '{"f": 1.0}', '{"f": "1.0"}', '{"f": "YES"}', '{"f": 2}',
        '{"f": null}', '{}']], "x string")
    got = [r[0] for r in df.select(loose.loose_bool_variant(F.parse_json("x"), "f")).collect()]
    assert got == [True, True, True, None, True, None, None, None]


def test_loose_ts(spark):
    got = values(spark, ["2024-01-01T00:00:00Z", "2024-01-01T01:00:00+01:00",
                         "2024-01-01T00:00:00.123456+00:00", "bad", None],
                 F.unix_micros(loose.loose_ts(F.col("x"))))
    base = 1704067200_000000
    assert got == [base, base, base + 123456, None, None]


@pytest.mark.parametrize("distances,avg,top", [
    ([0.0], 1.0, 1.0), ([1.0], 0.5, 0.5), ([0.0, 1.0], 0.75, 1.0), ([2.0], 0.0, 0.0),
    ([0.1, 0.2, 0.3], 0.977, 0.995), ([None], 0.0, 0.0)])
def test_sim_stats(spark, distances, avg, top):
    df = spark.createDataFrame([(1, d) for d in distances], "q int, distance double")
    row = enrich.sim_stats(df, ["q"]).collect()[0]
    assert (row["similarity_avg"], row["similarity_max"]) == (avg, top)


def test_half_even_rounding(spark):
    assert values(spark, [2.5, 3.5, 0.125], F.bround("x", 0), "x double") == [2.0, 4.0, 0.0]


def test_markdown_and_links(spark):
    rows = ["plain", "- item", "**b** and # h", "[a](http://x.y) - z", None, "see https://a.b"]
    assert values(spark, rows, text.markdown_level(F.col("x"))) == [
        "none", "light", "strong", "light", "none", "light"]
    assert values(spark, rows, text.has_link(F.col("x"))) == [
        False, False, False, True, False, True]


def test_followup(spark):
    got = values(spark, ["Happy to help", "unhappy tone", "if you're curious, ask", "If You Want it",
                         "I can talk more", None], text.has_followup(F.col("x")))
    assert got == [True, False, True, True, True, False]


def test_titles_and_slugs(spark):
    assert values(spark, ["a/b/The-Tool_one-pager.PDF", "x-summary.pdf"],
                  text.slug_from_filename(F.col("x"))) == ["the-tool", "x"]
    assert values(spark, ["Tool — One-Page Summary", "Tool (One Page)", "One tool"],
                  text.clean_title(F.col("x"))) == ["Tool", "Tool", "One tool"]
    assert values(spark, ["Hello, World! "], text.slugify(F.col("x"))) == ["hello-world"]


def test_front_matter(spark):
    raw = ["---\ntitle: \"A: b\"\ntitle: C\ntags: x\n---\n body \n", "no header"]
    meta = values(spark, raw, text.front_matter_map(F.col("x")))
    assert meta[0] == {"title": "C", "tags": "x"} and meta[1] == {}
    assert values(spark, raw, text.front_matter_body(F.col("x"))) == ["body", "no header"]


def test_path_filter(spark):
    urls = ["http://a.org/abc", "http://a.org/a/x", "http://a.org", "http://a.org/z"]
    assert values(spark, urls, text.path_filter(F.col("x"), include=["/a/"])) == [
        True, True, False, False]
    assert values(spark, urls, text.path_filter(F.col("x"), exclude=["/a"])) == [
        False, False, True, True]
    assert values(spark, urls, text.url_path(F.col("x"))) == ["abc", "a/x", "home", "z"]


def test_duration(spark):
    got = values(spark, [5.0, 65.0, 3700.0, None], text.format_duration(F.col("x")), "x double")
    assert got == ["5s", "1m 5s", "1h 1m", "—"]


PHRASES = {"personal": ["old friend"], "inner_circle": ["Family"]}


def tiers(spark, turns):
    df = spark.createDataFrame([("s", i, r, t) for i, (r, t) in enumerate(turns)],
                               "conv_id string, turn int, role string, text string")
    return [r["audience_tier"] for r in
            enrich.tier_escalation(df, PHRASES).orderBy("turn").collect()]


@pytest.mark.parametrize("turns,expected", [
    ([("user", "hi")], ["public"]),
    ([("user", "an OLD FRIEND here")], ["personal"]),
    ([("user", "hi"), ("assistant", "family"), ("user", "ok")], ["public"] * 3),
    ([("user", "old friend"), ("user", "x"), ("user", "family"), ("user", "y")],
     ["personal", "personal", "inner_circle", "inner_circle"]),
    ([("user", "family, old friend")], ["inner_circle"])])
def test_tier_is_sticky(spark, turns, expected):
    assert tiers(spark, turns) == expected


def test_sql_rate(spark):
    df = spark.createDataFrame([(1, 4), (0, 0)], "n int, d int")
    assert [r[0] for r in df.select(numeric.rate_pct_1dp(F.col("n"), F.col("d"))).collect()] == [
        25.0, 0.0]
