"""Stateful stream operators on Spark's own keyed state and event-time timers.

Notifications may arrive in any order as long as none is later than the watermark's delay. Operators whose result depends on order hold a key's rows
back until the watermark has passed them and then go through them in order; one timer a key wakes it at its earliest row. What a key no longer needs is
removed by its timers, so state follows the active keys and the delay, not the length of the stream. State, timers and watermark are part of the
stream's checkpoint: a restarted stream goes on where the last finished batch ended.

A key's rows within one delay are worked on by one task; the batch forms in :mod:`pixelquarry.streaming.watch` spread a key over tasks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Column of the stream's event time.
CLOCK = "_clock"
#: The process that sets state up is started by the JVM and doesn't share the session's module path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def use_keyed_state(spark: SparkSession) -> None:
    """Timers and several state variables a key need this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def micros(df: DataFrame, column: str = "ts") -> Column:
    """Microseconds of a time; a time without zone is counted as it stands, whatever the session's zone."""
    if dict(df.dtypes)[column] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")
    return F.unix_micros(column)


def _clocked(events: DataFrame, delay: str) -> DataFrame:
    timed = events.withColumn("t", micros(events))
    return timed.withColumn(CLOCK, F.timestamp_micros("t")).withWatermark(CLOCK, delay)


def _due(t: int) -> int:
    """First millisecond by which a watermark has passed a time in microseconds."""
    return -(-t // 1000)


class InOrder(StatefulProcessor):
    """Holds a key's rows back until the watermark has passed them. ``fields``: columns kept of each row (name, SQL type), ``t`` and ``event_id`` first."""

    def __init__(self, fields: list[tuple[str, str]], out: list[str]) -> None:
        self.fields, self.out = [("t", "bigint"), ("event_id", "bigint"), *fields], out

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", ", ".join(f"{n} {k}" for n, k in self.fields))
        self.wake = handle.getValueState("wake", "at bigint")
        self.open()

    def _wake_at(self, at: int) -> None:
        now = self.wake.get()[0] if self.wake.exists() else None
        if now is None or at < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(at)
            self.wake.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = [n for n, _ in self.fields]
        for part in rows:
            kept = part[names].astype(object).where(part[names].notna(), None)
            self.held.appendList(list(kept.itertuples(index=False, name=None)))
            self._wake_at(_due(int(part["t"].min())))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        if not self.wake.exists() or self.wake.get()[0] > passed:
            return
        self.wake.clear()
        rows = sorted((tuple(r) for r in self.held.get()), key=lambda r: r[:2])
        ready = [r for r in rows if _due(r[0]) <= passed]
        rest = rows[len(ready) :]
        self.held.clear()
        if rest:
            self.held.put(rest)
        out = self.go_through(key, ready)
        until = self.forget(passed) if not rest else None
        if rest:
            self._wake_at(_due(rest[0][0]))
        elif until is not None:
            self._wake_at(until)
        if out:
            yield pd.DataFrame(out, columns=self.out)

    def open(self) -> None:
        """State of its own."""

    def go_through(self, key: tuple, ready: list[tuple]) -> list[tuple]:
        """Output rows for rows in order."""
        raise NotImplementedError

    def forget(self, passed: int) -> int | None:
        """Clears what an idle key no longer needs, or says when to ask again."""
        return None

    def close(self) -> None:
        pass


class Modified(InOrder):
    """Events whose file time differs from the one before; a path without events for ``keep_ms`` counts as new again."""

    def __init__(self, keep_ms: int | None) -> None:
        super().__init__([("m", "bigint")], ["event_id", "path"])
        self.keep_ms = keep_ms

    def open(self) -> None:
        self.last = self.handle.getValueState("last", "m bigint, t bigint")

    def go_through(self, key: tuple, ready: list[tuple]) -> list[tuple]:
        seen, at = self.last.get() if self.last.exists() else (None, None)
        out = []
        for t, event_id, m in ready:
            gone = self.keep_ms is not None and at is not None and t - at > self.keep_ms * 1000
            if at is None or gone or m != seen:
                out.append((event_id, key[0]))
            seen, at = m, t
        if ready:
            self.last.update((seen, at))
        return out

    def forget(self, passed: int) -> int | None:
        if self.keep_ms is None or not self.last.exists():
            return None
        until = _due(self.last.get()[1]) + self.keep_ms + 1
        if until <= passed:
            self.last.clear()
            return None
        return until


class Throttled(InOrder):
    """Passes an event and then stays silent for ``wait`` microseconds; the passed time is forgotten once it can't block any more."""

    def __init__(self, wait: int) -> None:
        super().__init__([], ["event_id", "dir"])
        self.wait = wait

    def open(self) -> None:
        self.free = self.handle.getValueState("free", "t bigint")

    def go_through(self, key: tuple, ready: list[tuple]) -> list[tuple]:
        free = self.free.get()[0] if self.free.exists() else None
        out = []
        for t, event_id in ready:
            if free is None or t >= free:
                out.append((event_id, key[0]))
                free = t + self.wait
        if out:
            self.free.update((free,))
        return out

    def forget(self, passed: int) -> int | None:
        if not self.free.exists():
            return None
        until = _due(self.free.get()[0])
        if until <= passed:
            self.free.clear()
            return None
        return until


ENTRY = "dir string, m bigint, length bigint, deleted boolean, t bigint, event_id bigint"
FEED = f"path string, {ENTRY}"


class Upkeep(StatefulProcessor):
    """The newest event of every path is its entry. A deletion stays as a mark until the watermark has passed it, so that an older event can't bring a file back."""

    def init(self, handle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", ENTRY)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = tuple(self.entry.get()) if self.entry.exists() else None
        before = best
        for part in rows:
            newest = part.sort_values(["t", "event_id"]).iloc[-1]
            own = (newest["dir"], *(None if pd.isna(newest[c]) else int(newest[c]) for c in ("m", "length")), bool(newest["deleted"]), int(newest["t"]), int(newest["event_id"]))
            if best is None or own[4:] > best[4:]:
                best = own
        if best != before:
            self.entry.update(best)
            if best[3]:
                self.handle.registerTimer(_due(best[4]))
            yield pd.DataFrame([(key[0], *best)], columns=[c.split()[0] for c in FEED.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.entry.exists():
            entry = self.entry.get()
            if entry[3] and _due(entry[4]) <= timerValues.getCurrentWatermarkInMs():
                self.entry.clear()
        return iter(())

    def close(self) -> None:
        pass


def modified_stream(events: DataFrame, delay: str, keep_ms: int | None = None) -> DataFrame:
    """Events (path, ts, event_id, mtime) whose file time differs from the one before, in the order of (ts, event_id): event_id, path."""
    use_keyed_state(events.sparkSession)
    rows = _clocked(events, delay).withColumn("m", micros(events, "mtime")).select("path", "t", "event_id", "m", CLOCK)
    return rows.groupBy("path").transformWithStateInPandas(Modified(keep_ms), "event_id bigint, path string", "Append", "EventTime")


def throttled_stream(events: DataFrame, wait_ms: int, delay: str) -> DataFrame:
    """Per folder, an event passes and blocks others for ``wait_ms``: event_id, dir."""
    use_keyed_state(events.sparkSession)
    rows = _clocked(events, delay).select("dir", "t", "event_id", CLOCK)
    return rows.groupBy("dir").transformWithStateInPandas(Throttled(wait_ms * 1000), "event_id bigint, dir string", "Append", "EventTime")


def catalog_stream(events: DataFrame, delay: str) -> DataFrame:
    """Feed of changed entries (path, dir, length, deleted, times in microseconds); the state itself is the catalog, see :func:`read_catalog`."""
    use_keyed_state(events.sparkSession)
    rows = _clocked(events, delay).withColumn("m", micros(events, "mtime")).withColumn("deleted", F.col("kind") == "deleted")
    rows = rows.select("path", "dir", "m", "length", "deleted", "t", "event_id", CLOCK)
    return rows.groupBy("path").transformWithStateInPandas(Upkeep(), FEED, "Append", "EventTime")


def read_catalog(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The entries a catalog stream holds after its last finished batch, read from its state: path, dir, mtime, length."""
    use_keyed_state(spark)
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "entry").load()
    flat = state.select("key.path", "value.*").filter("NOT deleted")
    mtime = F.expr("timestampadd(MICROSECOND, m, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    return flat.select("path", "dir", mtime.alias("mtime"), "length")
