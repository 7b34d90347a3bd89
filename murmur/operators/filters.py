"""Row filters on the log. Predicates stay on raw columns so scans can use them."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions import numeric


def _parse_day(text: str | None) -> dt.datetime | None:
    if not text:
        return None
    try:
        return dt.datetime.fromisoformat(text)
    except ValueError:
        return None


def _instant(moment: dt.datetime) -> Column:
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=dt.timezone.utc)
    return F.lit(moment.astimezone(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f UTC")
                 ).cast("timestamp")


def date_range(df: DataFrame, start: str | None = None, end: str | None = None,
               ts: str = "ts") -> DataFrame:
    """UTC range, both days inclusive; rows without ts stay, unreadable bounds are ignored."""
    first, last = _parse_day(start), _parse_day(end)
    keep = F.lit(True)
    if first is not None:
        keep = keep & (F.col(ts) >= _instant(first))
    if last is not None:
        keep = keep & (F.col(ts) < _instant(last + dt.timedelta(days=1)))
    return df if first is None and last is None else df.where(F.col(ts).isNull() | keep)


def cutoff_predicate(date: str, zone: str, ts: str = "ts") -> Column:
    """Local midnight as a constant instant; rows without ts stay."""
    midnight = dt.datetime.fromisoformat(f"{date}T00:00:00").replace(tzinfo=ZoneInfo(zone))
    return F.col(ts).isNull() | (F.col(ts) >= _instant(midnight))


def cutoff_local(df: DataFrame, date: str | None, zone: str = "America/Chicago",
                 ts: str = "ts") -> DataFrame:
    return df.where(cutoff_predicate(date, zone, ts)) if date else df


def cutoff_summary(df: DataFrame, date: str, zone: str, row_class: Column,
                   ts: str = "ts") -> DataFrame:
    """Kept and removed rows per row class."""
    keep = cutoff_predicate(date, zone, ts)
    return df.groupBy(row_class.alias("row_class")).agg(
        F.count_if(keep).alias("kept"), F.count_if(~keep).alias("removed"))


def not_owner(flag: str = "is_owner_traffic") -> Column:
    return ~F.coalesce(F.col(flag), F.lit(False))


def owner_sessions(*frames: DataFrame) -> DataFrame:
    """Sessions with an owner-marked row in any of the frames; blank ids never count."""
    marked = [f.where(F.col("is_owner_traffic") & (F.trim("session_id") != ""))
              .select("session_id") for f in frames]
    out = marked[0]
    for m in marked[1:]:
        out = out.unionByName(m)
    return out.distinct()


def exclude_owner(chats: DataFrame, votes: DataFrame,
                  mode: str = "session") -> tuple[DataFrame, DataFrame]:
    """Drop owner traffic: none, marked rows only, or every row of a touched session."""
    if mode == "none":
        return chats, votes
    if mode == "row":
        return chats.where(not_owner()), votes.where(not_owner())
    if mode == "session":
        touched = owner_sessions(chats, votes)
        return (chats.where(not_owner()).join(touched, "session_id", "left_anti"),
                votes.where(not_owner()).join(touched, "session_id", "left_anti"))
    raise ValueError("mode must be one of: none, row, session")


def last_n(df: DataFrame, n: int, order: tuple[str, ...] = ("ts", "row_id")) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def by_workflow(df: DataFrame, wanted: list[str] | None) -> DataFrame:
    return df.where(F.col("workflow").isin(wanted)) if wanted else df


def workflow_values(df: DataFrame) -> DataFrame:
    return df.where(F.trim("workflow") != "").select("workflow").distinct()


def flag_turns(df: DataFrame) -> DataFrame:
    """The three quality flags of a turn."""
    return df.withColumns({
        "is_knowledge_gap": F.col("chunk_similarity_avg") < numeric.GAP_SIMILARITY,
        "is_slow": F.col("latency_ms") > numeric.SLOW_MS,
        "is_verbose": F.col("response_chars") > numeric.VERBOSE_CHARS})


def find_latest(log: DataFrame, needle: str, order: tuple[str, ...] = ("ts", "row_id"),
                message: str = "message") -> DataFrame:
    """The most recent row whose message contains the text, ignoring case."""
    hit = F.contains(F.lower(message), F.lower(F.lit(needle)))
    return last_n(log.where(hit), 1, order)
