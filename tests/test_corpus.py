"""Sections and chunks on edge cases and random paragraphs."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from murmur.operators import corpus


def naive_chunks(lengths, size, overlap):
    """Plain restatement of the rule, one paragraph at a time."""
    out, i = [], 0
    while i < len(lengths):
        used, j = 0, i
        while j < len(lengths) and (used == 0 or used + lengths[j] <= size):
            used += lengths[j] + 1
            j += 1
        out.append((i, j - 1))
        if j == len(lengths):
            return out
        back, total = 0, 0
        while j - 1 - back > i and total + lengths[j - 1 - back] <= overlap:
            total += lengths[j - 1 - back]
            back += 1
        i = j - back
    return out


LENGTHS = st.lists(st.integers(1, 60), max_size=40)


@settings(max_examples=300, deadline=None)
@given(LENGTHS, st.integers(1, 120), st.integers(0, 60))
def test_spans_follow_the_rule(lengths, size, overlap):
    assert corpus.chunk_spans(lengths, size, overlap) == naive_chunks(lengths, size, overlap)


@settings(max_examples=200, deadline=None)
@given(LENGTHS, st.integers(1, 120), st.integers(0, 60), st.integers(0, 80))
def test_spans_cover_everything(lengths, size, overlap, minimum):
    spans = corpus.chunk_spans(lengths, size, overlap)
    assert {p for a, b in spans for p in range(a, b + 1)} == set(range(len(lengths)))
    assert all(x[0] < y[0] for x, y in zip(spans, spans[1:]))
    merged = corpus.merge_spans(spans, lengths, minimum)
    assert [s for _, parts in merged for s in parts] == spans


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_chunk_texts(spark):
    text = "Para 1\n\nPara  2\n\n\n\nPara\n3"
    got = corpus.chunk(docs(spark, text, "", "x" * 50), ["doc_id"], size=19, overlap=5)
    rows = [(r["doc_id"], r["chunk_index"], r["text"]) for r in got.orderBy("doc_id", "chunk_index").collect()]
    assert rows == [(0, 0, "Para 1\n\nPara 2"), (0, 1, "Para 3"), (2, 0, "x" * 50)]


def test_overlap_only_chunk_before_a_long_paragraph(spark):
    text = "a" * 10 + "\n\n" + "b" * 5 + "\n\n" + "c" * 40
    got = corpus.chunk(docs(spark, text), ["doc_id"], size=20, overlap=8)
    assert [r["text"] for r in got.orderBy("chunk_index").collect()] == [
        "a" * 10 + "\n\n" + "b" * 5, "b" * 5, "c" * 40]


def sections(spark, text, **kw):
    got = corpus.markdown_sections(docs(spark, text), ["doc_id"], **kw)
    key = "section_order" if kw.get("include_nested") else "section_position"
    return [(r["section_name"], r["text"], r["header_level"], r["start_line"], r["end_line"])
            for r in got.orderBy(key).collect()]


def test_sections_basic(spark):
    got = sections(spark, "# Title\n\n## Section 1\nContent 1\n\n## Section 2\nContent 2")
    assert got == [("Preamble", "# Title", 0, 0, 1),
                   ("Section 1", "## Section 1\nContent 1", 2, 2, 4),
                   ("Section 2", "## Section 2\nContent 2", 2, 5, 6)]


def test_sections_nested_names_accumulate(spark):
    text = "## A\na\n### B\nb\n### C\nc\n## D\nd"
    assert [s[0] for s in sections(spark, text)] == ["A", "A > B", "A > B > C", "D"]
    assert [s[0] for s in sections(spark, text, include_nested=True)] == ["A", "D"]


def test_sections_without_headers(spark):
    assert sections(spark, "just text") == [("Preamble", "just text", 0, 0, 0)]
    assert sections(spark, "") == [("Full Document", "", 0, 0, 0)]
    assert sections(spark, "### deep first\nx")[0][0] == "Preamble"
    assert [s[0] for s in sections(spark, "\n### deep\nx")] == ["Preamble > deep"]


def test_delimiter_sections(spark):
    text = "Summary\n======\nThis is a summary.\n\nDetails\n======\nMore info."
    got = corpus.delimiter_sections(docs(spark, text, "plain"), ["doc_id"]).orderBy(
        "doc_id", "section_order").collect()
    assert [(r["section_name"], r["text"]) for r in got] == [
        ("Preamble", "Summary"), ("Summary", "This is a summary.\n\nDetails"),
        ("Details", "More info."), ("Full Document", "plain")]


def test_labelled_sections(spark):
    text = "Tool\nmore\nWhat it is (short)\nA tool\nStatus: May 2023\nHow it works\none\nHow it works\ntwo"
    row = corpus.labelled_sections(docs(spark, text, "nothing here"), ["doc_id"]).orderBy("doc_id").collect()
    assert row[0]["title"] == "Tool more" and row[0]["date"] == "May 2023"
    assert row[0]["sections"] == {"What it is": "A tool", "How it works": "two"}
    assert row[1]["title"] is None and row[1]["sections"] == {}


def test_sections_of_a_document_with_very_many_headers(spark):
    n = 20_000
    text = "".join(f"## h{i}\nbody {i}\n" for i in range(n))
    got = corpus.markdown_sections(docs(spark, text), ["doc_id"], include_nested=True)
    assert got.count() == n
    last = got.where(F.col("section_order") == n - 1).first()
    assert (last.section_name, last.start_line, last.end_line) == (f"h{n - 1}", 2 * n - 2, 2 * n)
