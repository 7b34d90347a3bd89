"""Per-session state: turn counter, sticky tier, owner flag and vote attribution."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.operators.enrich import TIER_RANKS, phrase_rank
from murmur.streaming.ordered import MICROS, Job, Step, run_ordered

OUT = ("session string, pos bigint, kind string, turn_index bigint, audience_tier string, "
       "is_owner boolean, user_message string, answer string")
ROWS = "at bigint, pos bigint, kind string, text string, flag boolean, tier_rank int"
TIER_NAMES = list(TIER_RANKS)


def advance_session(carry: tuple, ready: list[tuple], now: int | None) -> Step:
    """Kinds: user, assistant, system; vote (goes to the last question and the last answer before
    it); owner (sets the flag, the last writer wins)."""
    turns, tier, owner, said, answered = carry
    out = []
    for _, pos, kind, text, flag, rank in ready:
        if kind == "user":
            turns, tier, said = turns + 1, max(tier, rank or 0), text
        elif kind == "assistant":
            answered = text
        elif kind == "owner":
            owner = bool(flag)
        vote = kind == "vote"
        out.append((pos, kind, turns, TIER_NAMES[tier], owner, said if vote else None,
                    answered if vote else None))
    return Step(out, (turns, tier, owner, said, answered), [])


SESSION = Job("session", ROWS, ["pos", "kind"],
              "turns bigint, tier int, owner boolean, said string, answered string",
              (0, 0, False, None, None), OUT, advance_session)


def session_events(events: DataFrame, phrases: dict[str, list[str]]) -> DataFrame:
    """Events with the tier their phrases ask for; matching stays in the JVM."""
    return events.withColumn("tier_rank", phrase_rank(F.col("text"), phrases))


def session_state(events: DataFrame, phrases: dict[str, list[str]], late: str,
                  forget_hours: int | None = None) -> DataFrame:
    """``events``: session, ts, pos, kind, text, flag, in any order up to ``late``.

    Give ``forget_hours`` to jobs that run for good: sessions without rows for so long start anew.
    """
    return run_ordered(session_events(events, phrases), SESSION, late, forget_hours)


# --- flush by count or time -----------------------------------------------------------

# A buffer is written at so many turns or after so much time.
FLUSH_TURNS = 10
FLUSH_SECONDS = 300
# end of fixed values


def flush_job(turns: int = FLUSH_TURNS, seconds: int = FLUSH_SECONDS) -> Job:
    """Buffers of a session's turns, written at the ``turns``-th or ``seconds`` after the first.

    A row comes out when its buffer is written, with the number of the buffer and why: ``count``,
    ``time``, or ``end`` for what the end of the input leaves open.
    """
    def advance(carry: tuple, ready: list[tuple], now: int | None) -> Step:
        flushes, lo, out = carry[0], 0, []
        at = [row[0] for row in ready]
        while lo < len(at):
            due = at[lo] + seconds * MICROS
            hi = bisect_left(at, due, lo, min(lo + turns, len(at)))
            if hi - lo == turns:
                reason = "count"
            elif hi < len(at) or (now is not None and now >= due):
                reason = "time"
            elif now is None:
                reason = "end"
            else:
                break
            flushes += 1
            out += [(row_id, flushes, reason) for _, row_id in ready[lo:hi]]
            lo = hi
        wake = at[lo] + seconds * MICROS if lo < len(at) else None
        return Step(out, (flushes,), ready[lo:], wake)

    return Job("session", "at bigint, row_id bigint", ["row_id"], "flushes bigint", (0,),
               "session string, row_id bigint, flush bigint, reason string", advance)
