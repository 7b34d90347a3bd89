"""Main text of pages: what is nested in boilerplate goes, reading matter stays."""

import pytest

from murmur.functions.pages import blocks, main_text, page_main_text
from murmur.operators import corpus

LONG = "This paragraph has enough words in it to be taken for the reading matter of the page."
MORE = "Another paragraph of the same kind, with <b>bold</b> words &amp; an <a href='/x'>inline link</a> in the middle."
MORE_TEXT = "Another paragraph of the same kind, with bold words & an inline link in the middle."


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize("body,want", [
    (f"<p>{LONG}</p><p>{MORE}</p>", [LONG, MORE_TEXT]),
    # navigation nested in navigation, lists in it, and text after the inner one has closed
    (f"<nav><ul><li><a href='/'>Home</a><nav><a>In</a></nav></li></ul>stray words that belong to the outer one, "
     f"long enough to be taken</nav><p>{LONG}</p>", [LONG]),
    (f"<div class='site-nav top'><div><p>{LONG}</p></div></div><p>{MORE}</p>", [MORE_TEXT]),
    (f"<script>var a = '<p>{LONG}</p>';</script><style>p > a {{}}</style><p>{MORE}</p>", [MORE_TEXT]),
    (f"<p>{MORE}</p><footer><div><p>{LONG}</p></div>&copy; someone</footer>", [MORE_TEXT]),
    (f"<p>{MORE}</p><script>unclosed <p>{LONG}", [MORE_TEXT]),
    (f"<!-- <p>{LONG}</p> --><p>{MORE}</p><!-- unclosed <p>{LONG}", [MORE_TEXT]),
    (f"<div hidden><p>{LONG}</p></div><div style='display: none'>{LONG}</div><span aria-hidden=true>{LONG}</span>"
     f"<p>{MORE}</p>", [MORE_TEXT]),
    (f"<div role=navigation>{LONG}</div><p>{MORE}</p>", [MORE_TEXT]),
    # blocks of links go, a short line beside a long block stays, a lone short one goes
    (f"<ul><li><a href='1'>A link with many words in it, more than a telling block needs</a></li></ul>"
     f"<h2>Heading</h2><p>{LONG}</p><div><a>More</a></div><p>lone</p>", ["Heading", LONG]),
    # the article is the page, short lines in it stay, its own header too
    (f"<header>Site name</header><p>{LONG}</p><article><header><h1>Title</h1></header><p>Short.<p>{MORE}"
     f"<aside>{LONG}</aside></article>", ["Title", "Short.", MORE_TEXT]),
    # a small article in a long page is not
    (f"<article>Teaser</article><p>{LONG}</p><p>{MORE}</p>", ["Teaser", LONG, MORE_TEXT]),
    (f"<body class='sidebar-left'><main id=nav-content><p>{LONG}</p></main></body>", [LONG]),
    ("<p>one<br>two<br/>three</p>", ["one", "two", "three"]),  # nothing is telling: all blocks
    (f"<p><b>{LONG}<br><p>5 < 6 &lt; 7 &#233; <unknown-tag>x</unknown-tag>", [LONG, "5 < 6 < 7 é x"]),
    (f"<p title=\"a > b\">{LONG}</p><p title=\"open>{MORE}</p>", [LONG, MORE_TEXT]),
    ("", []), ("plain words", ["plain words"]), ("<p></p><div> \n\t</div>", []), ("</div></p></nav>text", ["text"]),
])
def test_main_text(body, want):
    assert main_text(page(body)).split("\n") == (want or [""])


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + LONG + "</div>" * 3000
    assert main_text(deep) == LONG
    assert len(blocks(f"<p>{LONG}</p>" * 5000)) == 5000
    assert main_text("<" * 20_000 + "a" * 5) and main_text("<p " + "a='" * 20_000) is not None
    assert main_text("<a <b 'c " * 40_000) is not None  # unclosed tags cost no more than their length
    assert main_text(None) is None


def test_extract_pages(spark):
    rows = [(1, "http://x/a/b", page(f"<nav>{LONG}</nav><article><p>{LONG}</p><p>End.</p></article>")),
            (2, "http://x/c", page("<p>short</p>")), (3, "http://x/d", None), (4, "http://x/e", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["title"], r["text"]) for r in corpus.extract_pages(pages).collect()}
    assert got == {1: ("T", f"{LONG}\nEnd.")}
    texts = pages.select(page_main_text(pages.html).alias("t")).collect()
    assert [r["t"] for r in texts][2:] == [None, ""]
