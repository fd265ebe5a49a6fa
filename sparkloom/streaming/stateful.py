"""Limits, presence, failure runs and turns of calls as stateful streams: typed state per key, and timers that clear it.

Every stream takes events (user_id, event_id, ts, event_type) and gives what the batch reports give of the same events, batch by batch. A batch's events of one
key are taken in order of (ts, event_id). Timers run on event time: once the watermark has passed what a key could still need, its state goes, so state follows the
keys that are alive, not all that ever were. The session needs the RocksDB state store (``use_state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..plans.activity import ASKED, DONE, FAILED, SPOKE, VOICE

#: How late an event may come.
LATE = "10 minutes"
#: Failures in a row that open the breaker, and seconds without a sign after which nobody is there.
TRIP, ABSENT = 3, 90


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(["ts", "event_id"])


def _millis(ts: pd.Series) -> list[int]:
    return (ts.astype("datetime64[us]").astype("int64") // 1000).tolist()


class _Keyed(StatefulProcessor):
    """One value of state a key, and at most one timer, at which it goes."""

    SCHEMA = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.SCHEMA)

    def held(self, start: tuple) -> tuple:
        return tuple(self.state.get()) if self.state.exists() else start

    def keep(self, value: tuple, until: int | None = None) -> None:
        self.state.update(value)
        if until is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(until)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


class _Limiter(_Keyed):
    """A window opens at a key's first event and lasts some time; beyond ``limit`` events in it are refused. Once it is over, the key has no state."""

    SCHEMA = "opened long, used int"

    def __init__(self, limit: int, seconds: int) -> None:
        self.limit, self.lasts = limit, seconds * 1000

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        opened, used = self.held((None, 0))
        frame, passed = _ordered(rows), []
        for at in _millis(frame.ts):
            if opened is None or at >= opened + self.lasts:
                opened, used = at, 0
            used += 1
            passed.append(used <= self.limit)
        self.keep((opened, used), opened + self.lasts)
        yield pd.DataFrame({"event_id": frame.event_id, "passed": passed})


class _Presence(_Keyed):
    """Someone arrives with a first sign, and has left once the watermark is ``absent`` seconds past the last."""

    SCHEMA = "seen long"

    def __init__(self, absent: int) -> None:
        self.absent = absent * 1000

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        (seen,) = self.held((None,))
        times = _millis(_ordered(rows).ts)
        out = [] if seen is not None else [(key[0], pd.Timestamp(times[0], unit="ms"), True)]
        seen = max([*times, seen or 0])
        self.keep((seen,), seen + self.absent)
        yield pd.DataFrame(out, columns=["user_id", "at", "present"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        (seen,) = self.held((0,))
        self.state.clear()
        yield pd.DataFrame([(key[0], pd.Timestamp(seen + self.absent, unit="ms"), False)], columns=["user_id", "at", "present"])


class _Breaker(_Keyed):
    """The event at which a run of failures reaches ``trip``; any success ends the run."""

    SCHEMA = "run int"

    def __init__(self, trip: int) -> None:
        self.trip = trip

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        (run,) = self.held((0,))
        frame, out = _ordered(rows), []
        for event, kind in zip(frame.event_id, frame.event_type):
            run = run + 1 if kind == FAILED else 0
            if run == self.trip:
                out.append((key[0], event))
        if run:
            self.keep((run,))
        elif self.state.exists():
            self.state.clear()
        yield pd.DataFrame(out, columns=["user_id", "event_id"])


class _Turns(_Keyed):
    """The turns of a call, each told when it ends: answered, failed, interrupted by a voice over an audible answer, or replaced by the next question."""

    SCHEMA = "turn long, question long, spoke boolean, open boolean, audible boolean"

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        turn, question, spoke, open_, audible = self.held((0, 0, False, False, False))
        frame, out = _ordered(rows), []

        def end(how: str) -> None:
            nonlocal open_
            out.append((key[0], turn, question, audible, how))
            open_ = False

        for event, kind in zip(frame.event_id.tolist(), frame.event_type):
            if kind == ASKED:
                if open_:
                    end("replaced")
                turn, question, spoke, open_, audible = turn + 1, event, False, True, False
            elif open_ and kind == SPOKE:
                spoke = audible = True
            elif open_ and (kind in (DONE, FAILED) or kind == VOICE and spoke):
                end({DONE: "answered", FAILED: "failed"}.get(kind, "interrupted"))
        self.keep((turn, question, spoke, open_, audible))
        yield pd.DataFrame(out, columns=["user_id", "turn", "question", "audible", "outcome"])


def _stream(events: DataFrame, processor: StatefulProcessor, schema: str, late: str, timed: bool) -> DataFrame:
    use_state_store(events.sparkSession)
    rows = events.select("user_id", "event_id", "ts", "event_type")
    if timed:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithStateInPandas(processor, schema, "Append", "EventTime" if timed else "None")


def limited(events: DataFrame, limit: int, seconds: int, late: str = LATE) -> DataFrame:
    """event_id and passed, as activity.limit_rate() has them."""
    return _stream(events, _Limiter(limit, seconds), "event_id long, passed boolean", late, True)


def presence(events: DataFrame, absent: int = ABSENT, late: str = LATE) -> DataFrame:
    """user_id, at and present: when each user came and, ``absent`` seconds after the last sign, was gone."""
    return _stream(events, _Presence(absent), "user_id long, at timestamp, present boolean", late, True)


def trips(events: DataFrame, trip: int = TRIP) -> DataFrame:
    """user_id and event_id of each event that opens the user's breaker."""
    return _stream(events, _Breaker(trip), "user_id long, event_id long", LATE, False)


def turns(events: DataFrame) -> DataFrame:
    """user_id, turn, question, audible and outcome of each turn once it is over, as activity.voice_turns() has them; open turns are not told."""
    return _stream(events, _Turns(), "user_id long, turn long, question long, audible boolean, outcome string", LATE, False)
