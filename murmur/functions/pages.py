"""Main text of HTML pages: tags are read with a stack, blocks judged by their text and links.

Elements that hold no reading matter (scripts, navigation, forms, footers, hidden or advertising
boxes) are left out with everything nested in them. What remains falls into blocks. If an
``article`` or ``main`` element holds most of the text, its blocks are the page; otherwise a block
stays if it is long and poor in links or next to one that is. Pages on which nothing stays give
all their blocks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"""
                 r"""|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>"']+|"[^"]{0,4096}"|'[^']{0,4096}')*+)>"""
                 r"""|</?[a-zA-Z][^<>]*>""", re.S)
ATTR = re.compile(r"""(?i)\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title"}
BLOCK = set("""address article aside blockquote body br center dd details div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table tbody td tfoot th thead
tr ul""".split())
NO_TEXT = set("""aside button canvas dialog footer form head iframe menu nav noscript object option script select
style svg template textarea title""".split())
NO_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "dialog"}
NO_NAMES = set("""ad ads advert advertisement banner breadcrumb breadcrumbs cookie cookies footer masthead menu nav
navbar navigation newsletter pager pagination popup promo share sharing sidebar social sponsor sponsored subscribe""".split())
MAIN = {"article", "main"}
LONG, LINKED, RICH = 40, 0.5, 0.33  # characters of a telling block; shares of text inside links
MAIN_SHARE = 0.25  # of the text, that a main element must hold


@dataclass
class Block:
    text: str
    linked: float
    main: bool


@dataclass
class _Open:
    name: str
    skip: bool
    main: bool
    link: bool


@dataclass
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=list)
    parts: list[tuple[str, bool]] = field(default_factory=list)

    def state(self) -> _Open:
        return self.stack[-1] if self.stack else _Open("", False, False, False)

    def text(self, raw: str) -> None:
        if raw and not self.state().skip:
            self.parts.append((unescape(raw), self.state().link))

    def flush(self) -> None:
        whole = " ".join("".join(t for t, _ in self.parts).split())
        if whole:
            linked = sum(len("".join(t.split())) for t, link in self.parts if link)
            self.blocks.append(Block(whole, linked / max(len("".join(whole.split())), 1), self.state().main))
        self.parts = []

    def close(self, name: str) -> None:
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at].name == name:
                del self.stack[at:]
                return

    def open(self, name: str, attrs: str) -> None:
        if name in BLOCK and any(o.name == "p" for o in self.stack[-8:]):
            self.close("p")  # a paragraph ends where the next block begins
        if name == "li" and self.stack and self.stack[-1].name == "li":
            self.close("li")
        up = self.state()
        if name not in VOID:
            skip = up.skip or _unread(name, attrs, up.main)
            self.stack.append(_Open(name, skip, up.main or name in MAIN or _role(attrs) == "main", up.link or name == "a"))


def _role(attrs: str) -> str | None:
    return next(((a or b or c).lower() for n, a, b, c in ATTR.findall(attrs) if n.lower() == "role"), None)


def _unread(name: str, attrs: str, main: bool) -> bool:
    """Whether an element and all inside it is no reading matter."""
    if name in NO_TEXT or (name == "header" and not main):
        return True
    if not attrs or name in MAIN or name in ("html", "body"):
        return False
    for key, a, b, c in ATTR.findall(attrs):
        key, value = key.lower(), (a or b or c).lower()
        if key in ("class", "id") and NO_NAMES & set(re.split(r"[^a-z0-9]+", value)):
            return True
        if key == "role" and value in NO_ROLES:
            return True
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def blocks(html: str) -> list[Block]:
    """Blocks of readable text in order; unclosed and stray tags are taken as browsers do, roughly."""
    reader, at = _Reader(), 0
    while m := TAG.search(html, at):
        reader.text(html[at:m.start()])
        at, name = m.end(), (m["name"] or "").lower()
        if not name:
            continue
        if name in BLOCK:
            reader.flush()
        if m["end"]:
            reader.close(name)
        elif name in RAW:  # nothing inside is a tag
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
        else:
            reader.open(name, m["attrs"])
    reader.text(html[at:])
    reader.flush()
    return reader.blocks


def main_text(html: str | None) -> str | None:
    """A line for each block of the main text; null stays null."""
    if html is None:
        return None
    found = blocks(html)
    size = sum(len(b.text) for b in found)
    main = [b for b in found if b.main]
    if main and sum(len(b.text) for b in main) >= MAIN_SHARE * size:
        kept = [b for b in main if b.linked <= LINKED]
    else:
        telling = [len(b.text) >= LONG and b.linked < RICH for b in found]
        near = [any(telling[max(i - 1, 0):i + 2]) for i in range(len(found))]
        kept = [b for b, n in zip(found, near) if n and b.linked <= LINKED]
    return "\n".join(b.text for b in kept or found)


def _main_texts(html: pd.Series) -> pd.Series:
    return html.map(main_text)


def page_main_text(html: Column) -> Column:
    return F.pandas_udf(_main_texts, StringType())(html)
