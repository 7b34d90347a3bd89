"""Per-turn enrichment: positions, tiers, vote attribution, running usage.

Running measures go through :mod:`murmur.scale`, so one very long session is split
over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions import numeric, text
from murmur.operators import sessions
from murmur.scale import Running, running, trailing

# Tier order, history length, intent phrasing, overlap threshold, alert share.
TIER_RANKS = {"public": 0, "personal": 1, "inner_circle": 2}
HISTORY_LIMIT = 14
EXAMPLE_MATCH_SHARE = 0.7
ALERT_GAP_PCT = 20.0
WALKTHROUGH_PATTERNS = [
    r"walk\s*(me\s+)?through",
    r"show\s+me\s+a\s+project",
    r"(portfolio|featured)\s+project",
    r"project\s+you.*(proud|excited|built|worked)",
    r"(proud|excited)\s+.*(project|built)",
]
NAMED_WALKTHROUGH_PATTERNS = [
    r"(tell|talk)\s+(me\s+)?about\s+.*({names}|project)",
    r"(explain|describe)\s+.*?({names}|project)",
    r"how\s+(does|did|do|is)\s+.*({names})",
]
# end of fixed values

POSITION_BLOCK = 1000


def tier_rank(tier: Column) -> Column:
    """Rank of a tier; anything unknown ranks as public."""
    out = F.lit(0)
    for name, rank in TIER_RANKS.items():
        out = F.when(tier == name, rank).otherwise(out)
    return out


def tier_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in TIER_RANKS]), (rank + 1).cast("int"))


def tier_allows(section_tier: Column, visitor_tier: Column) -> Column:
    return tier_rank(section_tier) <= tier_rank(visitor_tier)


def _block(position: str) -> Column:
    return F.floor(F.col(position) / POSITION_BLOCK)


def turn_index(history: DataFrame, key: str = "conv_id", position: str = "turn") -> DataFrame:
    """User turns get their 1-based index: user messages so far in the session."""
    is_user = F.when(F.col("role") == "user", F.lit(1))
    out = running(history, [key], [position], _block(position),
                  [Running("turn_index", "count", is_user)])
    return out.where(F.col("role") == "user")


def phrase_rank(message: Column, phrases: dict[str, list[str]]) -> Column:
    """Highest tier whose phrases occur in the message, ignoring case."""
    low = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit(0)
    for tier, rank in TIER_RANKS.items():
        hit = F.lit(False)
        for phrase in phrases.get(tier, []):
            hit = hit | F.contains(low, F.lit(phrase.lower()))
        out = F.when(hit, rank).otherwise(out)
    return out


def tier_escalation(history: DataFrame, phrases: dict[str, list[str]], key: str = "conv_id",
                    position: str = "turn") -> DataFrame:
    """Sticky tier per turn: the highest tier any user text so far unlocked."""
    signal = F.when(F.col("role") == "user", phrase_rank(F.col("text"), phrases))
    out = running(history, [key], [position], _block(position),
                  [Running("__rank", "max", signal)])
    return out.withColumn("audience_tier", tier_name(F.coalesce("__rank", F.lit(0)))
                          ).drop("__rank")


def history_truncate(history: DataFrame, keep: int = HISTORY_LIMIT, key: str = "conv_id",
                     position: str = "turn") -> DataFrame:
    """The last messages per session; the rank filter prunes before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.col(position).desc())
    return (history.withColumn("__r", F.row_number().over(w))
            .where(F.col("__r") <= keep).drop("__r"))


def vote_attribute_turn(history: DataFrame, votes: DataFrame, key: str = "conv_id",
                        position: str = "turn") -> DataFrame:
    """Vote on a history position → the nearest earlier user message of the session."""
    turns = history.select(key, position, F.when(F.col("role") == "user", F.col("text"))
                           .alias("__said"), F.lit(None).cast("boolean").alias("liked"),
                           F.lit(0).alias("__vote"))
    marks = votes.select(key, position, F.lit(None).cast("string").alias("__said"), "liked",
                         F.lit(1).alias("__vote"))
    both = turns.unionByName(marks)
    out = running(both, [key], [position, "__vote"], _block(position),
                  [Running("user_message", "last", F.when(F.col("__vote") == 0, F.col("__said")),
                           inclusive=False)])
    return out.where(F.col("__vote") == 1).select(key, position, "liked", "user_message")


def _hour(ts: str) -> Column:
    return F.floor(F.unix_timestamp(ts) / 3600)


def vote_attribute_call(log: DataFrame) -> DataFrame:
    """Vote → the most recent model call of its own session, by time."""
    keyed = log.withColumn("__key", sessions.session_key())
    call = F.when(~F.col("event").eqNullSafe("vote"),
                  F.struct("row_id", "model", "cost_usd"))
    slim = keyed.select("__key", "ts", "row_id", "event", "liked", call.alias("__call"))
    out = running(slim, ["__key"], ["ts", "row_id"], _hour("ts"),
                  [Running("__last", "last", F.col("__call"), inclusive=False)])
    return out.where(F.col("event") == "vote").select(
        "row_id", "ts", "liked", F.col("__last.row_id").alias("call_row_id"),
        F.col("__last.model").alias("call_model"), F.col("__last.cost_usd").alias("call_cost_usd"))


def session_cost_running(turns: DataFrame) -> DataFrame:
    """Running cost and tokens inside a session."""
    keyed = turns.withColumn("session_key", sessions.session_key()).select(
        "row_id", "session_key", "ts", F.col("cost_usd").cast("decimal(20,6)").alias("__cost"),
        F.coalesce("prompt_tokens", F.lit(0)).alias("__p"),
        F.coalesce("completion_tokens", F.lit(0)).alias("__c"))
    out = running(keyed, ["session_key"], ["ts", "row_id"], _hour("ts"), [
        Running("running_cost", "sum", F.col("__cost")),
        Running("running_tokens", "sum", F.col("__p") + F.col("__c"))])
    return out.select("row_id", "session_key",
                      F.col("running_cost").cast("double").alias("running_cost_usd"),
                      "running_tokens")


def gap_rate_last_n(turns: DataFrame, n: int = 100, key: str = "provider") -> DataFrame:
    """Gap share over the last ``n`` turns of the same source, with the alert flag."""
    out = trailing(turns.select("row_id", "ts", key, "chunk_similarity_avg"), [key],
                   ["ts", "row_id"], _hour("ts"), n, {
        "__gaps": ("count", F.when(F.col("chunk_similarity_avg") < numeric.GAP_SIMILARITY, 1)),
        "__rows": ("count", F.lit(1))})
    pct = 100.0 * F.col("__gaps") / F.col("__rows")
    return out.select("row_id", key, pct.alias("gap_pct"), (pct > ALERT_GAP_PCT).alias("alert"))


def gap_rate_latest(turns: DataFrame, n: int = 100) -> DataFrame:
    """One-shot form over the newest ``n`` turns of the whole log."""
    newest = turns.orderBy(F.col("ts").desc(), F.col("row_id").desc()).limit(n)
    pct = 100.0 * F.count_if(F.col("chunk_similarity_avg") < numeric.GAP_SIMILARITY) / F.count(
        F.lit(1))
    return newest.agg(pct.alias("gap_pct")).withColumn(
        "alert", F.col("gap_pct") > ALERT_GAP_PCT)


def sim_stats(hits: DataFrame, keys: list[str], distance: str = "distance") -> DataFrame:
    """Average and best similarity per query from L2 distances, 3 decimals; none → 0."""
    sim = numeric.sim_from_l2(F.col(distance))
    three = lambda c: F.coalesce(F.bround(c, 3), F.lit(0.0))
    return hits.groupBy(*keys).agg(three(numeric.exact_mean(sim, 9)).alias("similarity_avg"),
                                   three(F.max(sim)).alias("similarity_max"))


def example_question_match(messages: DataFrame, examples: dict[str, str],
                           message: str = "message") -> DataFrame:
    """Closest canonical question by share of its words present; first one wins ties."""
    said = F.array_distinct(F.split(text.squash(F.lower(F.coalesce(message, F.lit("")))), " "))
    scored = []
    for order, (qid, question) in enumerate(examples.items()):
        wanted = sorted(set(question.lower().split()))
        if wanted:
            share = F.size(F.array_intersect(said, F.array(*[F.lit(w) for w in wanted]))
                           ) / F.lit(float(len(wanted)))
            scored.append(F.struct(share.alias("share"), F.lit(-order).alias("order"),
                                   F.lit(qid).alias("id")))
    best = F.array_max(F.array(*scored))
    out = messages.withColumn("__best", best)
    hit = F.col("__best.share") >= EXAMPLE_MATCH_SHARE
    return out.withColumns({
        "is_example": hit,
        "which_example": F.when(hit, F.col("__best.id")).otherwise("none")}).drop("__best")


def walkthrough_intent(message: Column, project_names: list[str]) -> Column:
    """Does the message ask for a walkthrough? ``project_names`` are regex alternatives."""
    names = "|".join(project_names)
    patterns = list(WALKTHROUGH_PATTERNS)
    for p in NAMED_WALKTHROUGH_PATTERNS:
        if names:
            patterns.append(p.format(names=names))
        elif "|project" in p:
            patterns.append(p.format(names="project"))
    return F.lower(F.coalesce(message, F.lit(""))).rlike("|".join(f"(?:{p})" for p in patterns))


def workflow_label(walkthrough: Column, has_diagram: Column) -> Column:
    return (F.when(walkthrough, "walkthrough").when(has_diagram, "diagram_only")
            .otherwise("standard"))


def route_model(is_gap: Column, walkthrough: Column, best: str, cheapest: str) -> Column:
    """Gap → notify, walkthrough → best model, else the cheapest."""
    return (F.when(is_gap, "notify").when(walkthrough, best).otherwise(cheapest))


def config_override(settings: dict[str, tuple[Column, object]]) -> Column:
    """True when any setting differs from its default."""
    changed = F.lit(False)
    for value, default in settings.values():
        changed = changed | ~value.eqNullSafe(F.lit(default))
    return changed


def enrich_turns(rows: DataFrame, message: str = "message",
                 response: str = "assistant_response") -> DataFrame:
    """Write-time enrichment shared by batch and streaming: redaction, preview, provider."""
    shown = text.redact_pii(F.col(response))
    return rows.withColumns({
        message: text.redact_pii(F.col(message)),
        response: shown,
        "assistant_response_preview": text.response_preview(shown),
        "provider": text.provider_of_model(F.col("model")),
        "empty_response": text.strip(F.coalesce(F.col(response), F.lit(""))) == ""})
