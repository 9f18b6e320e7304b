"""Structured Streaming forms: silence pairing, pause sessions and target changes.

Each takes and returns a streaming DataFrame. Rows may come out of order, also across batches, as long as they are late by
no more than late_ms; later ones are dropped as soon as the watermark of the batch before has passed them. `silence_pairs` and `target_changes` keep state by key with timers, which
needs the RocksDB state store (`with_rocksdb`).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB; the session's own setting comes back at the end."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


#: Buckets that keys are dealt to, each with the state of its keys. A checkpoint keeps its number.
BUCKETS = 1024


class InOrder(StatefulProcessor):
    """Hands the rows of each key on in order, once the watermark has passed them.

    Rows that are still early wait in `early`, so it holds no more than the rows of one lateness; `carry` is what the rows
    handed on so far leave, with the time of the last one. Once the watermark is idle_ms past a key's last row and none
    waits, `leave` says what is left over and nothing of the key stays.

    Each call on a state, and each timer, is a round trip to the JVM, so keys share buckets: the state of a bucket is one
    array a column, asked for once and written where it changes, and one timer a bucket stands at its earliest waiting row
    or end of an idle time.
    """

    given: dict[str, str]
    carried: dict[str, str]
    returned: list[str]

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def step(self, carry: tuple | None, row: tuple, out: list[tuple]) -> tuple:
        """What a row leaves after it; row is (at_ms, order, ...)."""
        raise NotImplementedError

    def leave(self, carry: tuple, out: list[tuple]) -> None:
        """Adds what a key that ends still owes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        arrays = lambda of: ", ".join(f"{n} array<{t}>" for n, t in of.items())
        self.handle = handle
        self.early = handle.getValueState("early", arrays({"key": "long"} | self.given))
        self.carry = handle.getValueState("carry", arrays({"key": "long", "last_ms": "long"} | self.carried))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: list[tuple] = []
        for frame in rows:
            ids = [None if w else k for w, k in zip(frame["without"].tolist(), frame["key"].tolist(), strict=True)]
            new += zip(ids, *(frame[c].tolist() for c in self.given), strict=True)
        return self._settle(new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._settle([], timerValues.getCurrentWatermarkInMs())

    def _settle(self, new: list[tuple], mark: int) -> Iterator[pd.DataFrame]:
        waiting, held = self.early.get(), self.carry.get()
        for at in list(self.handle.listTimers()) if waiting or held else ():  # a bucket without state has no timer
            self.handle.deleteTimer(at)
        rows: dict[int | None, list[tuple]] = {}
        for r in (*(zip(*waiting, strict=True) if waiting else ()), *new):
            rows.setdefault(r[0], []).append(r[1:])
        carry = {r[0]: r[1:] for r in zip(*held, strict=True)} if held else {}
        early, out, changed = [], [], False
        for k, own in rows.items():
            kept, told = carry.get(k), []
            for r in sorted((r for r in own if r[0] <= mark), key=lambda r: (r[1], r[0], repr(r))):
                kept = (max(r[0], kept[0]) if kept else r[0], *self.step(kept[1:] if kept else None, r, told))
                carry[k], changed = kept, True
            out += ((k, *x) for x in told)
            early += ((k, *r) for r in own if r[0] > mark)
        ends = []
        if self.idle_ms is not None:
            busy = {r[0] for r in early}
            for k, kept in [x for x in carry.items() if x[0] not in busy]:
                if kept[0] + self.idle_ms <= mark:
                    told = []
                    self.leave(kept[1:], told)
                    out += ((k, *x) for x in told)
                    del carry[k]
                    changed = True
                else:
                    ends.append(kept[0] + self.idle_ms)
        columns = lambda of: tuple(map(list, zip(*of, strict=True)))
        if early:
            self.early.update(columns(early))
        elif waiting:
            self.early.clear()
        if carry and changed:
            self.carry.update(columns((k, *kept) for k, kept in carry.items()))
        elif held and not carry:
            self.carry.clear()
        due = [*ends, *(r[1] for r in early)]
        if due:
            self.handle.registerTimer(min(due))
        if out:
            yield pd.DataFrame(out, columns=self.returned, dtype=object)


class _Pairs(InOrder):
    given = {"at_ms": "long", "line_no": "long", "opens": "boolean", "ms": "long"}
    carried, returned = {"pending": "long"}, ["clip_id", "start_ms", "end_ms"]

    def step(self, carry, row, out):
        pending = carry[0] if carry else None
        if row[2]:
            return (row[3],)
        if pending is not None:
            out.append((pending, row[3]))
        return (None,)

    def leave(self, carry, out):
        if carry[0] is not None:
            out.append((carry[0], None))


class _Targets(InOrder):
    given = {"at_ms": "long", "seq": "long", "aspect": "string", "resolution": "string"}
    carried, returned = {"aspect": "string", "resolution": "string"}, ["project_id", "seq", "effective", "invalidated"]

    def step(self, carry, row, out):
        _, seq, aspect, resolution = row
        turned = carry is not None and carry[0] != aspect
        now = "auto" if turned else resolution
        hit = "" if carry is None else "framing,reframe,safezone,captions,qc" if turned else "safezone,captions,qc" if now != carry[1] else ""
        out.append((seq, now, hit))
        return (aspect, now)


def _grouped(rows: DataFrame, key: str, needed: list[str], late_ms: int):
    """rows by bucket of their keys, which are two columns without nulls: nulls would turn whole keys into floats on their
    way to Python."""
    rows = rows.dropna(subset=["at", *needed]).withWatermark("at", f"{late_ms} milliseconds")
    rows = rows.select(F.isnull(key).alias("without"), F.coalesce(key, F.lit(0)).cast("long").alias("key"), "at", F.unix_millis("at").alias("at_ms"), *needed)
    return rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")).groupBy("bucket")


def silence_pairs(events: DataFrame, late_ms: int = 60_000, idle_ms: int = 600_000) -> DataFrame:
    """(clip_id, start_ms, end_ms) from events (clip_id, line_no, opens, ms, at): a start waits, also across batches, until
    an end closes it; a newer start takes its place.

    `at` is the event's time and doesn't fall as line_no grows. Once the watermark is idle_ms past a clip's last event, its
    open silence leaves with a null end and its state goes; an event after that begins the clip anew. Events without a
    clip form a clip of their own; those without another value leave; of events of one line the earlier comes first.
    Columns of any other name are ignored.
    """
    rows = _grouped(events, "clip_id", ["line_no", "opens", "ms"], late_ms)
    return rows.transformWithStateInPandas(_Pairs(idle_ms), "clip_id long, start_ms long, end_ms long", "Append", "EventTime")


def pause_sessions(words: DataFrame, gap_ms: int = 600, late_ms: int = 60_000) -> DataFrame:
    """(clip_id, start_ms, end_ms, n): runs of words (clip_id, at timestamp) whose starts are gap_ms
    apart at most."""
    w = F.session_window("at", f"{gap_ms} milliseconds")
    rows = words.withWatermark("at", f"{late_ms} milliseconds").groupBy("clip_id", w.alias("w")).agg(F.count("*").alias("n"))
    ms = lambda c: F.unix_millis(c)
    return rows.select("clip_id", ms(F.col("w.start")).alias("start_ms"), (ms(F.col("w.end")) - gap_ms).alias("end_ms"), "n")


def target_changes(history: DataFrame, late_ms: int = 60_000, idle_ms: int | None = None) -> DataFrame:
    """(project_id, seq, effective, invalidated) from (project_id, seq, aspect, resolution, at): the batch rule, with the
    effective target of each project kept as state.

    `at` doesn't fall as seq grows. That state is one row a project; with idle_ms it goes once the watermark is so far
    past a project's last change, and a change after that counts as the first. Rows without a value other than the
    project leave; columns of any other name are ignored.
    """
    rows = _grouped(history, "project_id", ["seq", "aspect", "resolution"], late_ms)
    return rows.transformWithStateInPandas(_Targets(idle_ms), "project_id long, seq long, effective string, invalidated string", "Append", "EventTime")
