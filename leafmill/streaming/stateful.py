"""Streams whose state ends: token assembly, completion barriers and job states by stateful processors.

Each key (a session, a job, or a bucket of jobs) has an event-time timer that moves with its newest event. A key that finishes gives its row once and keeps
only a mark, so that replays within the idle time give nothing; when the watermark passes the timer, mark and
state go. A key that never finishes gives one row saying so, and goes too. So the state holds what is open or was
closed within the idle time, however long the stream runs.

The queries run in append mode and need the RocksDB state store (`state_store`).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE = "10 minutes"
BUCKETS = 4096  # of jobs
MS = "unix_millis(ts) AS ms"  # timers count in these


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB; the session's own setting comes back at the end."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def milliseconds(interval: str) -> int:
    number, unit = interval.split()
    return int(float(number) * {"second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")])


class Ending(StatefulProcessor):
    """State of a key that ends once the watermark passes its newest event by `idle` milliseconds."""

    def __init__(self, idle: int) -> None:
        self._idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._ends = handle.getValueState("ends", "at long, closed boolean")

    def closed(self) -> bool:
        held = self._ends.get()
        return bool(held and held[1])

    def touch(self, newest: int, closed: bool = False) -> None:
        """Move the timer behind the newest event."""
        held = self._ends.get()
        at = newest + self._idle
        if held:
            at, closed = max(at, held[0]), closed or held[1]
        if held != (at, closed):
            if not held or held[0] != at:
                if held:
                    self._handle.deleteTimer(held[0])
                self._handle.registerTimer(at)
            self._ends.update((at, closed))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        rows = [] if self.closed() else list(self.unfinished(key))
        self.forget()
        self._ends.clear()
        yield from rows

    def unfinished(self, key) -> Iterator[Row]:
        """What a key that never finished gives."""
        return iter(())

    def forget(self) -> None:
        """Drop the state besides the timer."""


class TokenAssembly(Ending):
    """The tokens of one session, put in order as they come.

    Tokens wait in a reorder buffer for the number that is missing; those in order are kept as text. The `done` row
    carries the number of tokens. The session is whole when it is there, no number is missing and the citations have
    come, which may be last. A session without citations waits for them until it is idle.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self._next = handle.getValueState("next", "seq long")
        self._said = handle.getListState("said", "text string")
        self._waiting = handle.getListState("waiting", "seqs array<long>, tokens array<string>")
        self._cited = handle.getValueState("cited", "seq long, citations array<string>")
        self._count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest, fresh, cited, count = 0, {}, None, None
        for r in rows:
            newest = max(newest, r.ms)
            if r.type == "token" and r.seq is not None:
                fresh[r.seq] = max(fresh.get(r.seq, ""), r.token or "")
            elif r.type == "citations" and (cited is None or (r.seq, r.citations or []) < cited):
                cited = (r.seq, r.citations or [])
            elif r.type == "done":
                count = max(count or 0, r.seq or 0)
        if self.closed():
            self.touch(newest)
            return
        held = self._next.get()
        start = at = held[0] if held else 0
        waiting = {}  # the whole buffer in few calls
        for seqs, tokens in self._waiting.get() if held or self._ends.exists() else ():
            waiting.update(zip(seqs, tokens, strict=True))
        rest = {seq: token for seq, token in (waiting | fresh).items() if seq >= at}
        run = []
        while at in rest:
            run.append(rest.pop(at))
            at += 1
        if run and waiting:
            self._waiting.clear()
        added = rest if run else {seq: token for seq, token in rest.items() if waiting.get(seq) != token}
        if added:
            self._waiting.appendValue((list(added), list(added.values())))
        if run:
            self._said.appendValue((" ".join(run),))
        if at != start:
            self._next.update((at,))
        known = self._cited.exists()
        if cited is not None and not known:
            self._cited.update(cited)
        if count is None:
            said = self._count.get()
            count = said[0] if said else None
        else:
            self._count.update((count,))
        whole = count is not None and at >= count and (known or cited is not None)
        if whole:
            yield self._row(key, True)
            self.forget()
        self.touch(newest, whole)

    def _row(self, key, ended: bool) -> Row:
        cited = self._cited.get()
        return Row(session=key[0], text=" ".join(r[0] for r in self._said.get()), citations=list(cited[1]) if cited else [], ended=ended)

    def unfinished(self, key) -> Iterator[Row]:
        count, at = self._count.get(), self._next.get()
        yield self._row(key, bool(count and (at[0] if at else 0) >= count[0]))

    def forget(self) -> None:
        for state in (self._next, self._said, self._waiting, self._cited, self._count):
            state.clear()


def assembled(tokens: DataFrame, late: str = IDLE, idle: str = IDLE) -> DataFrame:
    """(session, text, citations, ended) of a stream of tokens (session, seq, token, type, citations, ts), once a session.

    ended is false for sessions whose `done` or tokens didn't come within the idle time: they give what was in order.
    Sessions without citations are given once they are idle, since citations may be the last to come.
    Rows without a session or time are left out; of several tokens of one number in a batch the highest counts.
    """
    rows = tokens.where("session IS NOT NULL AND ts IS NOT NULL").select("session", "seq", "token", "type", "citations", "ts", F.expr(MS)).withWatermark("ts", late)
    return rows.groupBy("session").transformWithState(TokenAssembly(milliseconds(idle)), "session long, text string, citations array<string>, ended boolean", "Append", "EventTime")


class PageBarrier(StatefulProcessor):
    """The pages of jobs as bitsets; a job is done when all its pages are there.

    A key is a bucket of jobs, whose states are read and written as one value, since a call for each job costs more than
    its rows. The bucket's timer is not later than the first job's end; jobs that end leave the bucket.
    """

    def __init__(self, idle: int) -> None:
        self._idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._held = handle.getValueState("held", "at long, jobs binary")

    def _read(self) -> tuple[int | None, dict]:
        """The timer, and by job when it ends, whether it was given, its pages and its total."""
        held = self._held.get()
        if not held:
            return None, {}
        table = pa.ipc.open_stream(bytes(held[1])).read_all()
        job, ends, closed, bits, total = (c.to_pylist() for c in table.columns)
        return held[0], {j: [e, c, int.from_bytes(b, "little"), t] for j, e, c, b, t in zip(job, ends, closed, bits, total, strict=True)}

    def _write(self, timer: int | None, jobs: dict) -> None:
        if not jobs:
            self._held.clear()
            return
        first = min(j[0] for j in jobs.values())
        if timer is None or first < timer:
            if timer is not None:
                self._handle.deleteTimer(timer)
            self._handle.registerTimer(first)
            timer = first
        ends, closed, bits, total = zip(*jobs.values(), strict=True)
        kept = [b.to_bytes((b.bit_length() + 7) // 8, "little") for b in bits]
        table = pa.table({"job": pa.array(list(jobs)), "ends": pa.array(ends, pa.int64()), "closed": pa.array(closed), "bits": pa.array(kept, pa.binary()), "total": pa.array(total, pa.int64())})
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema) as stream:
            stream.write_table(table)
        self._held.update((timer, out.getvalue().to_pybytes()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        timer, jobs = self._read()
        pages: dict = {}
        for part in rows:
            for job, total, page, ms in zip(part["job"].tolist(), part["total"].tolist(), part["page"].tolist(), part["ms"].tolist(), strict=True):
                held = jobs.get(job)
                if held is None:
                    held = jobs[job] = [ms + self._idle, False, 0, 0]
                elif ms + self._idle > held[0]:
                    held[0] = ms + self._idle
                if not held[1]:
                    if total > held[3]:
                        held[3] = total
                    found = pages.setdefault(job, set())
                    if page >= 0:
                        found.add(page)
        done = []
        for job, found in pages.items():
            held = jobs[job]
            for p in found:
                held[2] |= 1 << p
            if held[2].bit_count() >= held[3] > 0:
                done.append((job, held[2].bit_count(), held[3], True))
                held[1:] = [True, 0, 0]
        self._write(timer, jobs)
        yield _given(done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over = timerValues.getCurrentWatermarkInMs()
        jobs = self._read()[1]
        open_ = [(job, bits.bit_count(), total, False) for job, (ends, closed, bits, total) in jobs.items() if ends <= over and not closed]
        self._write(None, {job: held for job, held in jobs.items() if held[0] > over})
        yield _given(open_)


def _given(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["job", "done", "total", "ended"])


def completed_once(pages: DataFrame, job: str, total: str, page: str, ts: str, late: str = IDLE, idle: str = IDLE, buckets: int = BUCKETS) -> DataFrame:
    """(job, done, total, ended): each job once, when all its pages have come, or as not ended when none came any more.

    Pages are numbered from 0 or 1; repeated ones count once; the highest total counts. Jobs are dealt to `buckets` by
    a hash; a batch rewrites the buckets that it touches, which hold what is open or was closed within the idle time.
    """
    number = lambda c, none: F.coalesce(F.col(c).cast("long"), F.lit(none))
    rows = pages.select(F.col(job).alias("job"), number(total, 0).alias("total"), number(page, -1).alias("page"), F.col(ts).alias("ts"))
    rows = rows.where("job IS NOT NULL AND ts IS NOT NULL").select("*", F.expr(MS), F.pmod(F.xxhash64("job"), F.lit(buckets)).alias("bucket")).withWatermark("ts", late)
    kind = pages.schema[job].dataType.simpleString()
    return rows.groupBy("bucket").transformWithStateInPandas(PageBarrier(milliseconds(idle)), f"job {kind}, done long, total long, ended boolean", "Append", "EventTime")


class LatestState(Ending):
    """The newest status of one job; only changes are given."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self._held = handle.getValueState("held", "ms long, status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        found = [(r.ms, r.status or "") for r in rows]
        newest = max(found)
        held = self._held.get()
        if not held or newest > tuple(held):
            if not held or newest[1] != held[1]:
                yield Row(job=key[0], status=newest[1], ms=newest[0])
            self._held.update(newest)
        self.touch(newest[0])

    def forget(self) -> None:
        self._held.clear()


def status_changes(log: DataFrame, job: str, ts: str, status: str, late: str = IDLE, idle: str = IDLE) -> DataFrame:
    """(job, status, at): a row whenever the newest status of a job changes; late lines of older times change nothing.

    Times count by the millisecond, equal ones by status. A job is forgotten when it was idle; its next line is a change.
    """
    rows = log.select(F.col(job).alias("job"), F.col(ts).alias("ts"), F.col(status).alias("status")).where("job IS NOT NULL AND ts IS NOT NULL").select("*", F.expr(MS)).withWatermark("ts", late)
    kind = log.schema[job].dataType.simpleString()
    changes = rows.groupBy("job").transformWithState(LatestState(milliseconds(idle)), f"job {kind}, status string, ms long", "Append", "EventTime")
    return changes.select("job", "status", F.timestamp_millis("ms").alias("at"))
