"""Which project a text is about.

``catalogue`` has project_id, title, summary, tags, mention_keywords and ``order``
(catalogue position). Messages are scanned once for each block of projects, with one automaton
for its keywords and titles; only (text, project) pairs with a signal are ever formed.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions import text
from murmur.operators.matching import Automaton, scan

# Score weights, thresholds and words that carry no meaning here.
KEYWORD_POINTS, TITLE_POINTS, TITLE_WORD_POINTS, TAG_POINTS = 10, 8, 2, 1
MENTION_THRESHOLD = 5
PROMINENT_PREFIX = 300
GENERIC_WORDS = [
    "the", "through", "project", "walk", "tell", "about", "me", "a", "an",
    "show", "describe", "explain", "talk", "of", "for", "to", "in", "on",
]
# end of fixed values


def _listed(catalogue: DataFrame) -> DataFrame:
    """What a message may name of each project. A keyword listed twice counts twice."""
    none = F.array().cast("array<string>")
    long_words = F.filter(text.words(F.col("title")), lambda w: F.length(w) >= 4)
    searchable = F.concat_ws(" ", F.lower("title"), F.lower("summary"), F.array_join("tags", " "))
    rows = catalogue.select(
        "project_id", "order", F.lower("title").alias("title"),
        F.coalesce(F.transform("mention_keywords", lambda k: F.lower(k)), none).alias("keywords"),
        F.coalesce(long_words, none).alias("title_words"),
        F.coalesce(F.array_distinct("tags"), none).alias("tags"), text.words(searchable).alias("vocabulary"))
    size = [F.coalesce(F.length("title"), F.lit(0))] + [
        F.aggregate(c, F.lit(0), lambda n, w: n + F.coalesce(F.length(w), F.lit(0)) + 32)
        for c in ("keywords", "title_words", "tags", "vocabulary")]
    return rows.withColumn("__bytes", sum(size, F.lit(256)))


class _Signals:
    """The signals of a block of projects, looked up by term and by word."""

    def __init__(self, rows: list[dict]):
        self.ids = [r["project_id"] for r in rows]
        self.orders = [r["order"] for r in rows]
        terms: dict[str, int] = {}
        by_term: list[list[tuple[int, int, bool]]] = []
        by_word: dict[str, list[tuple[int, int]]] = {}
        vocabulary: dict[str, list[int]] = {}
        for p, r in enumerate(rows):
            named = [(k, KEYWORD_POINTS, False) for k in r["keywords"]] + [(r["title"], TITLE_POINTS, True)]
            for term, points, full in named:
                if term:
                    if terms.setdefault(term, len(terms)) == len(by_term):
                        by_term.append([])
                    by_term[terms[term]].append((p, points, full))
            for word in r["title_words"]:
                by_word.setdefault(word, []).append((p, 0))
            for tag in filter(None, r["tags"]):
                by_word.setdefault(tag, []).append((p, 1))
            for word in r["vocabulary"]:
                vocabulary.setdefault(word, []).append(p)
        self.automaton = Automaton(list(terms))
        self._terms = [np.array(t, np.int64).reshape(-1, 3) for t in by_term]
        self._words = {w: np.array(v, np.int64).reshape(-1, 2) for w, v in by_word.items()}
        self._vocabulary = {w: np.array(v, np.int64) for w, v in vocabulary.items()}

    def scores(self, low: str | None, words: list[str] | None) -> tuple[np.ndarray, np.ndarray]:
        """Projects with a positive score, and the scores."""
        none = np.zeros((0, 3), np.int64)
        terms = np.concatenate([none, *[self._terms[i] for i in self.automaton.found(low)]])
        named = np.concatenate([none[:, :2], *[self._words[w] for w in words if w in self._words]]
                               ) if words is not None else none[:, :2]
        projects, at = np.unique(np.concatenate([terms[:, 0], named[:, 0]]), return_inverse=True)
        of_terms, of_words, n = at[:len(terms)], at[len(terms):], len(projects)

        def total(where: np.ndarray, values: np.ndarray) -> np.ndarray:
            return np.bincount(where, weights=values, minlength=n).astype(np.int64)

        title_words = total(of_words, (named[:, 1] == 0).astype(float))
        full = total(of_terms, terms[:, 2].astype(float)) > 0
        score = (total(of_terms, terms[:, 1].astype(float))
                 + TAG_POINTS * total(of_words, (named[:, 1] == 1).astype(float))
                 + np.where(full, 0, TITLE_WORD_POINTS * title_words))
        return projects[score > 0], score[score > 0]

    def best(self, low: str | None, words: list[str] | None, threshold: int) -> tuple | None:
        """(project, score, order) of the best project; the earlier one wins ties."""
        projects, scores = self.scores(low, words)
        if not len(scores) or scores.max() < threshold:
            return None
        p = min(projects[scores == scores.max()], key=lambda i: (self.orders[i], str(self.ids[i])))
        return self.ids[p], int(scores.max()), self.orders[p]

    def overlap(self, words: list[str], draw: Callable) -> tuple | None:
        """(project, common words, draw) of the project with most words in common."""
        met = [self._vocabulary[w] for w in words if w in self._vocabulary]
        if not met:
            return None
        projects, counts = np.unique(np.concatenate(met), return_counts=True)
        drawn, p = min((draw(self.ids[p]), p) for p in projects[counts == counts.max()])
        return self.ids[p], int(counts.max()), drawn


def _messages(messages: DataFrame, message_id: str, message: str, *more: Column) -> DataFrame:
    return messages.select(F.col(message_id).alias("id"), F.lower(F.col(message)).alias("low"),
                           text.words(F.col(message)).alias("words"), *more)


def _kinds(messages: DataFrame, message_id: str, catalogue: DataFrame) -> tuple[str, str, str]:
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return kind(messages, message_id), kind(catalogue, "project_id"), kind(catalogue, "order")


def mention_scores(messages: DataFrame, catalogue: DataFrame, message_id: str = "message_id",
                   message: str = "message") -> DataFrame:
    """(message, project, score) for positive scores, in one scan of the messages.

    Rows that share an id are scored each on its own.
    """
    def kernel(built: _Signals, batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, low, words in zip(batch["id"], batch["low"], batch["words"]):
            projects, scores = built.scores(low, words)
            out += [(key, built.ids[p], s) for p, s in zip(projects, scores.tolist())]
        return pd.DataFrame(out, columns=["id", "project_id", "score"])

    m, p, _ = _kinds(messages, message_id, catalogue)
    return scan(_messages(messages, message_id, message), _listed(catalogue), _Signals, kernel,
                f"id {m}, project_id {p}, score bigint").withColumnRenamed("id", message_id)


def find_mentioned(messages: DataFrame, catalogue: DataFrame, message_id: str = "message_id",
                   message: str = "message", threshold: int = MENTION_THRESHOLD) -> DataFrame:
    """Best project per message at or above the threshold; the earlier project wins ties.

    Only the best of each message leaves the scan, however many projects share a word.
    """
    def kernel(built: _Signals, batch: pd.DataFrame) -> pd.DataFrame:
        rows = ((key, built.best(low, words, threshold))
                for key, low, words in zip(batch["id"], batch["low"], batch["words"]))
        return pd.DataFrame([(key, *b) for key, b in rows if b], columns=["id", "project_id", "score", "order"])

    m, p, o = _kinds(messages, message_id, catalogue)
    found = scan(_messages(messages, message_id, message), _listed(catalogue), _Signals, kernel,
                 f"id {m}, project_id {p}, score bigint, order {o}")
    best = F.max_by(F.struct("project_id", "score"), F.struct(F.col("score"), -F.col("order")))
    return found.groupBy(F.col("id").alias(message_id)).agg(best.alias("b")).select(
        message_id, "b.project_id", "b.score")


def stable_draw(*parts: Column) -> Column:
    """Reproducible stand-in for a random pick."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def _draw(*parts) -> str:
    """The same of whole numbers and strings inside a task."""
    return md5("|".join(str(p) for p in parts if p is not None).encode()).hexdigest()


def walkthrough_select(messages: DataFrame, catalogue: DataFrame, intent: Column,
                       message_id: str = "message_id", message: str = "message",
                       seed: int = 0) -> DataFrame:
    """Project to walk through for messages with that intent.

    A clear mention wins; otherwise the best word overlap with title, summary and tags,
    ties and fully generic messages drawn reproducibly from ``seed``. One scan of the messages
    finds both; ids are whole numbers or strings.
    """
    meaning = F.filter(text.words(F.col(message)),
                       lambda w: (F.length(w) > 2) & ~w.isin(GENERIC_WORDS)).alias("meaning")

    def kernel(built: _Signals, batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, low, words, own in zip(batch["id"], batch["low"], batch["words"], batch["meaning"]):
            mention = built.best(low, words, MENTION_THRESHOLD) or (None, None, None)
            overlap = None
            if mention[0] is None and own is not None and len(own) >= 2:
                overlap = built.overlap(own, lambda p: _draw(key, p, seed))  # noqa: B023
            out.append((key, *mention, *(overlap or (None, None, None))))
        columns = ["id", "mention", "score", "order", "overlap", "n", "draw"]
        return pd.DataFrame(out, columns=columns).astype(object)

    m, p, o = _kinds(messages, message_id, catalogue)
    found = scan(_messages(messages.where(intent), message_id, message, meaning), _listed(catalogue), _Signals,
                 kernel, f"id {m}, mention {p}, score bigint, order {o}, overlap {p}, n bigint, draw string")
    # Highest overlap first, smallest draw among equals.
    mention = F.max_by("mention", F.when(F.col("score").isNotNull(), F.struct(F.col("score"), -F.col("order"))))
    overlap = F.min_by("overlap", F.when(F.col("n").isNotNull(), F.struct(-F.col("n"), F.col("draw"))))
    best = found.groupBy(F.col("id").alias(message_id)).agg(mention.alias("__mention"), overlap.alias("__overlap"))
    drawn = F.conv(F.substring(stable_draw(F.col(message_id), F.lit(seed)), 1, 8), 16, 10).cast("bigint")
    # The catalogue's own order may have gaps, so the draw goes by rank.
    nth = F.row_number().over(Window.orderBy("order", "project_id")) - 1
    numbered = catalogue.select(F.col("project_id").alias("__drawn"), nth.cast("bigint").alias("__nth"))
    size = catalogue.agg(F.count(F.lit(1))).scalar()
    how = (F.when(F.col("__mention").isNotNull(), "mention").when(F.col("__overlap").isNotNull(), "overlap")
           .otherwise("draw"))
    return (best.withColumn("how", how).withColumn("__nth", F.when(F.col("how") == "draw", drawn % size))
            .join(numbered, "__nth", "left")
            .select(message_id, F.coalesce("__mention", "__overlap", "__drawn").alias("project_id"), "how"))


def prominent_project(texts: DataFrame, catalogue: DataFrame, text_id: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """First catalogue project named early in the text or at least twice, in one scan."""
    listed = (catalogue.select("project_id", "order", F.lower("title").alias("title"))
              .where(F.length("title") > 0).withColumn("__bytes", F.octet_length("title") + 128))

    def build(rows: list[dict]) -> tuple:
        first: dict[str, tuple] = {}  # of projects of one title only the first can be meant
        for r in rows:
            best = (r["order"], r["project_id"])
            first[r["title"]] = min(first.get(r["title"], best), best)
        return Automaton(list(first)), list(first.values())

    def kernel(built: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        automaton, named = built
        out = []
        for key, low in zip(batch["id"], batch["low"]):
            # two occurrences that do not overlap end at least a term apart
            hit = [named[i] for i, (a, b) in automaton.ends(low).items()
                   if a < PROMINENT_PREFIX or b - a >= len(automaton.terms[i])]
            if hit:
                out.append((key, *min(hit)))
        return pd.DataFrame(out, columns=["id", "order", "project_id"])

    m, p, o = _kinds(texts, text_id, catalogue)
    found = scan(texts.select(F.col(text_id).alias("id"), F.lower(F.col(text_col)).alias("low")), listed, build,
                 kernel, f"id {m}, order {o}, project_id {p}")
    return found.groupBy(F.col("id").alias(text_id)).agg(
        F.min(F.struct("order", "project_id")).alias("b")).select(text_id, "b.project_id")


def projects_mentioned(texts: DataFrame, names: list[str], text_col: str = "text",
                       out: str = "projects") -> DataFrame:
    """Names of a fixed list found in each text, in list order."""
    return texts.withColumn(out, text.matching_terms(F.col(text_col), names))


# Headings of the blocks that models and indexes read.
HEADINGS = {"project": "Project", "summary": "In short", "insight": "Design idea", "notes": "Notes",
            "links": "Links", "posts": "Articles", "tags": "Topics"}


def reference_block(catalogue: DataFrame, headings: dict[str, str] | None = None) -> DataFrame:
    """Prompt block per project; absent parts leave no line."""
    h = HEADINGS | (headings or {})
    line = lambda name, value: F.concat(F.lit(f"{h[name]}: "), value)
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    links = F.filter(F.map_entries(F.coalesce("links", F.create_map().cast("map<string,string>"))),
                     lambda e: e["value"].isNotNull() & (e["value"] != ""))
    posts = F.coalesce("blog_posts", F.array().cast("array<struct<title:string,url:string>>"))
    listing = lambda items, name, url: F.when(F.size(items) > 0, F.array_join(
        F.transform(items, lambda i: F.concat(F.lit("- "), i[name], F.lit(" <"), i[url], F.lit(">"))), "\n"))
    block = F.concat_ws(
        "\n", line("project", F.col("title")), line("summary", F.col("summary")),
        line("insight", blank("design_insight")), line("notes", F.col("walkthrough_context")),
        F.concat(F.lit(f"{h['links']}:\n"), listing(links, "key", "value")),
        F.concat(F.lit(f"{h['posts']}:\n"), listing(posts, "title", "url")))
    return catalogue.select("project_id", block.alias("block"))


def composite_text(catalogue: DataFrame, headings: dict[str, str] | None = None) -> DataFrame:
    """Text embedded for a project; projects without notes are skipped."""
    h = HEADINGS | (headings or {})
    notes = text.strip(F.coalesce("walkthrough_context", F.lit("")))
    body = F.concat_ws(
        "\n\n",
        F.concat_ws(": ", F.col("title"), F.col("summary")),
        F.concat(F.lit(f"{h['insight']}: "), F.nullif(F.col("design_insight"), F.lit(""))),
        notes,
        F.concat(F.lit(f"{h['tags']}: "), F.array_join("tags", ", ")))
    return catalogue.where(notes != "").select("project_id", "title", "order",
                                               body.alias("full_text"))
