"""State by key: listings' error counters and jobs' heartbeats, kept in RocksDB; both give what the batch rules give."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marketgrain.operators.lifecycle import DEACTIVATE_AFTER, HEARTBEAT_S

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which processors with timers and initial state need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class _Listings(StatefulProcessor):
    """One listing's failures in a row and whether it is active; errors of one attempt don't outlive the next one's start."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("listing", "streak long, active boolean")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.kept.update((int(row["streak"]), bool(row["active"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        streak, active = self.kept.get() if self.kept.exists() else (0, True)
        attempts = pd.concat(list(rows)).sort_values(["created_at", "id"])
        found = []
        for n, ok, error in zip(attempts["id"], attempts["ok"], attempts["error"]):
            errors, last = 0, None  # before the attempt
            if ok:
                streak = 0
            else:
                errors, last, streak = errors + 1, error if isinstance(error, str) else "scrape_failed", streak + 1
                active = active and streak < DEACTIVATE_AFTER
            found.append((n, key[0], errors, last, streak, active))
        self.kept.update((streak, active))
        yield pd.DataFrame(found, columns=["id", "listing_id", "errors", "last_error", "streak", "active"])

    def close(self) -> None:
        pass


LISTING_ROWS = "id long, listing_id long, errors long, last_error string, streak long, active boolean"


def listing_states(attempts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Attempts (listing_id, id, created_at, ok, error) of a stream with their listing's state after each, going on from
    ``known`` (listing_id, streak, active), what a batch table has. See ``lifecycle.attempt_streaks`` for the batch rule."""
    start = None if known is None else known.select("listing_id", "streak", "active").groupBy("listing_id")
    return attempts.groupBy("listing_id").transformWithStateInPandas(_Listings(), LISTING_ROWS, "Append", "None", start)


class _Heartbeats(StatefulProcessor):
    """One job's last sign of life, and a timer for when it is missed. A job that was given up stays so."""

    def __init__(self, limit_s: int, event_time: bool):
        self.limit, self.event_time = limit_s * 1000, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("job", "beat long, dead boolean")

    def _row(self, key, beat: int) -> pd.DataFrame:
        at = lambda ms: pd.Timestamp(ms, unit="ms", tz="UTC").tz_localize(None)
        return pd.DataFrame({"job_id": [key[0]], "last_beat": [at(beat)], "reaped_at": [at(beat + self.limit)]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, dead = self.kept.get() if self.kept.exists() else (None, False)
        if dead:
            return
        before = last
        for beat in sorted(b for chunk in rows for b in (chunk["beat_ms"]).tolist()):
            if last is not None and self.event_time and beat - last > self.limit:
                dead = True
                break
            last = beat if last is None else max(last, beat)
        if before is not None:
            self.handle.deleteTimer(before + self.limit + 1)
        self.kept.update((last, dead))
        if dead:
            yield self._row(key, last)
        else:
            self.handle.registerTimer(last + self.limit + 1)  # once more than the limit has passed

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, dead = self.kept.get()
        if not dead:
            self.kept.update((last, True))
            yield self._row(key, last)

    def close(self) -> None:
        pass


def missed_heartbeats(beats: DataFrame, limit_s: int = HEARTBEAT_S, late: str = "1 minute", event_time: bool = True) -> DataFrame:
    """Jobs of a stream of beats (job_id, beat_at) that gave no sign of life for more than ``limit_s`` seconds: job_id, last_beat,
    reaped_at. Each is told once, when time has passed and without input of its own.

    Time is that of the beats, less ``late``, so a stored stream gives the same each time; or with ``event_time=False`` the clock's.
    """
    rows = beats.withWatermark("beat_at", late) if event_time else beats
    rows = rows.withColumn("beat_ms", F.unix_millis("beat_at"))
    found = rows.groupBy("job_id").transformWithStateInPandas(_Heartbeats(limit_s, event_time), "job_id long, last_beat timestamp, reaped_at timestamp", "Append", "EventTime" if event_time else "ProcessingTime")
    return found
