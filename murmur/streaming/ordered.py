"""Rows of a key in order of event time, whatever order they arrive in.

Rows wait in state until the watermark has passed them; a timer then hands them on, sorted. What a
key holds is what arrived after the watermark: a batch (bounded by the source's limits) and the
allowed lateness, never its whole history. Rows behind the watermark are dropped by Spark
(``sinks.LateRows`` counts them). What still waits when a job stops is read from its state.

State is held by buckets of keys: calls to the state store and frames cost much more than rows, and most
keys have few of these. Only the carry is kept by key.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from murmur.streaming.sinks import use_rocksdb

MICROS = 1_000_000
BUCKETS = 1024
OUT_ROWS = 10_000  # of a frame for the sink


def columns_of(ddl: str) -> list[list[str]]:
    """Names and types of a flat schema string; works in tasks too."""
    return [part.split(maxsplit=1) for part in ddl.split(",")]


def column_names(ddl: str) -> list[str]:
    return [name for name, _ in columns_of(ddl)]


@dataclass
class Step:
    """What an advance gives: rows for the sink, the new carry, rows to keep, when to come back."""

    out: list[tuple]
    carry: tuple
    rest: list[tuple]
    wake: int | None = None  # event time in microseconds


@dataclass
class Job:
    """An operator over ordered rows.

    ``rows`` starts with ``at bigint`` (event time in microseconds) and ``order`` breaks ties.
    ``out`` starts with the key. ``advance(carry, ready, now)`` takes rows up to the watermark ``now``,
    sorted, and gives rows for the sink without the key; ``now`` is None at the end of the input, when
    nothing may be kept.
    """

    key: str
    rows: str
    order: list[str]
    carry: str
    start: tuple
    out: str
    advance: Callable[[tuple, list[tuple], int | None], Step]

    @property
    def names(self) -> list[str]:
        return column_names(self.rows)

    @property
    def key_ddl(self) -> str:
        return self.out.split(",")[0]

    @property
    def waiting(self) -> str:
        return f"{self.key_ddl}, {self.rows}"

    def sorted(self, rows: list[tuple]) -> list[tuple]:
        by = [self.names.index(c) for c in ("at", *self.order)]
        return sorted(rows, key=lambda r: [(r[i] is None, r[i]) for i in by])

    def frames(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        for lo in range(0, len(out), OUT_ROWS):
            yield pd.DataFrame(out[lo:lo + OUT_ROWS], columns=column_names(self.out), dtype=object)


def tuples(frame: pd.DataFrame, ddl: str) -> list[tuple]:
    """Rows of a frame; nulls are None, and whole numbers that nulls made floats are whole again."""
    columns = []
    for name, kind in columns_of(ddl):
        values = frame[name]
        if values.dtype.kind == "f" and kind in ("int", "bigint"):
            columns.append([None if v != v else int(v) for v in values.tolist()])
        elif values.dtype.kind in "ib":
            columns.append(values.tolist())
        else:
            columns.append([None if gone else v for v, gone in zip(values.tolist(), values.isna())])
    return list(zip(*columns))


class _Ordered(StatefulProcessor):
    def __init__(self, job: Job, forget: int | None) -> None:
        self._job, self._forget = job, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        job = self._job
        self._handle = handle
        self._waiting = handle.getListState("waiting", job.waiting)
        self._carry = handle.getMapState("carry", job.key_ddl, f"{job.carry}, last bigint")
        if self._forget is not None:
            kind = columns_of(job.key_ddl)[0][1]
            self._idle = handle.getMapState("idle", "due bigint", f"keys array<{kind}>")

    def _call_at(self, micros: int) -> None:
        self._handle.registerTimer(-(-micros // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        first = None
        for frame in rows:
            if len(frame):
                self._waiting.appendList(tuples(frame, self._job.waiting))
                low = int(frame["at"].min())
                first = low if first is None else min(first, low)
        if first is not None:
            self._call_at(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        job, now = self._job, timerValues.getCurrentWatermarkInMs() * 1000
        ready, kept, calls = defaultdict(list), [], []
        for row in self._waiting.get() if self._waiting.exists() else ():
            if row[1] <= now:
                ready[row[0]].append(tuple(row[1:]))
            else:
                kept.append(tuple(row))
                calls.append(row[1])
        out, idle = [], []
        for name, rows in ready.items():
            held = self._carry.getValue((name,))
            carry = job.start if held is None else tuple(held)[:-1]
            rows = job.sorted(rows)
            step = job.advance(carry, rows, now)
            if held is None or step.carry != carry or self._forget is not None:
                self._carry.updateValue((name,), (*step.carry, rows[-1][0]))
            out += [(name, *r) for r in step.out]
            kept += [(name, *r) for r in step.rest]
            if step.wake is not None:
                calls.append(step.wake)
            if not step.rest:
                idle.append(name)
        if ready:
            if kept:
                self._waiting.put(kept)
            else:
                self._waiting.clear()
        if calls:
            self._call_at(min(calls))
        if self._forget is not None:
            self._forget_idle(idle, {row[0] for row in kept}, now)
        yield from job.frames(out)

    def _forget_idle(self, idle: list, waiting: set, now: int) -> None:
        """Drops the carry of keys whose time is over and notes when that of ``idle`` will be."""
        for due, names in [(d[0], list(n[0])) for d, n in self._idle.iterator()] if self._idle.exists() else []:
            if due > now:
                continue
            self._idle.removeKey((due,))
            for name in names:
                held = self._carry.getValue((name,))
                if name not in waiting and held is not None and held[-1] + self._forget <= now:
                    self._carry.removeKey((name,))
        if idle:
            # Not before the watermark: none of these keys has a row behind it.
            due = now + self._forget
            known = self._idle.getValue((due,))
            self._idle.updateValue((due,), ([*(known[0] if known is not None else []), *idle],))
            self._call_at(due)

    def close(self) -> None:
        pass


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket")


def run_ordered(events: DataFrame, job: Job, late: str, forget_hours: int | None = None) -> DataFrame:
    """``events``: the key, ``ts`` and the job's rows but ``at``.

    With ``forget_hours`` a key's carry goes after so much event time without rows; the next row
    then starts anew.
    """
    use_rocksdb(events.sparkSession)
    rows = events.withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    forget = None if forget_hours is None else forget_hours * 3600 * MICROS
    return rows.select(_bucket(job.key), job.key, "ts", *job.names).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_Ordered(job, forget), outputStructType=job.out, outputMode="Append",
        timeMode="EventTime")


def finish(events: DataFrame, job: Job, checkpoint: str) -> DataFrame:
    """Output for the rows that still wait in the state of a stopped job."""
    spark = events.sparkSession

    def state(name: str) -> DataFrame:
        return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)

    waiting = state("waiting").select(F.col("key.bucket").alias("bucket"), "list_element.*")
    carry = state("carry").select(F.col("key.bucket").alias("bucket"), "user_map_key.*", "user_map_value.*")

    def end(rows: pd.DataFrame, last: pd.DataFrame) -> pd.DataFrame:
        waits, out = defaultdict(list), []
        for row in tuples(rows, job.waiting) if len(rows) else ():
            waits[row[0]].append(row[1:])
        held = {row[0]: row[1:] for row in tuples(last, f"{job.key_ddl}, {job.carry}")} if len(last) else {}
        for name, mine in waits.items():
            step = job.advance(held.get(name, job.start), job.sorted(mine), None)
            out += [(name, *r) for r in step.out]
        return pd.DataFrame(out, columns=column_names(job.out), dtype=object)

    return waiting.groupBy("bucket").cogroup(carry.groupBy("bucket")).applyInPandas(end, job.out)
