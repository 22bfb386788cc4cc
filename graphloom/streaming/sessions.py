"""Sessions of pending decisions as keyed state: opened, decided, or swept when they are too old.

A session lasts SESSION minutes; a sweep every SWEEP minutes drops those that are
older, so one opened at c goes at the first sweep after c + SESSION. Events are taken
in the order of their own times, however batches cut them: they wait until the
watermark has passed them. An event at the moment of a sweep comes after it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Minutes that a session lasts, and between sweeps.
SESSION, SWEEP = 30, 10
_MINUTE = 60_000

OUTCOMES = "session_id string, at timestamp, outcome string"


def expiry(opened: int, session: int = SESSION, sweep: int = SWEEP) -> int:
    """The millisecond of the sweep that drops a session opened at `opened`."""
    return ((opened + session * _MINUTE) // (sweep * _MINUTE) + 1) * sweep * _MINUTE


def expiry_column(at: Column, session: int = SESSION, sweep: int = SWEEP) -> Column:
    """The same for a timestamp column."""
    step = sweep * 60
    return F.timestamp_seconds((F.floor((F.unix_seconds(at) + session * 60) / step) + 1) * step)


class Sessions(StatefulProcessor):
    """State of one session: events that wait for the watermark, when it was opened, and its one timer. Each call of the state is a message to the JVM, so each is read once a visit and written if it changed."""

    def __init__(self, session: int = SESSION, sweep: int = SWEEP):
        self.session, self.sweep = session, sweep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, kind string")
        self.opened = handle.getValueState("opened", "at long, timer long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        yield from self._settle(key, [(r["ms"], r["kind"]) for r in rows], timerValues.getCurrentWatermarkInMs(), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        yield from self._settle(key, [], timerValues.getCurrentWatermarkInMs(), True)

    def _settle(self, key, new: list[tuple[int, str]], passed: int, expired: bool) -> Iterator[Row]:
        held = self.opened.get()  # there is one as long as anything is kept, for its timer
        opened, timer = held or (None, None)
        waited = [(e[0], e[1]) for e in self.waiting.get()] if held else []
        events = sorted((at, {"open": 0}.get(kind, 1), kind) for at, kind in [*waited, *new])
        out = []

        def swept(until: int) -> None:
            nonlocal opened
            if opened is not None and (end := expiry(opened, self.session, self.sweep)) <= until:
                out.append((end, "expired"))
                opened = None

        for at, _, kind in [e for e in events if e[0] <= passed]:
            swept(at)
            if kind == "open":
                out.append((at, "opened"))
                opened = at
            elif opened is None:
                out.append((at, "unknown"))
            else:
                out.append((at, "decided"))
                opened = None
        swept(passed)
        later = [e for e in events if e[0] > passed]
        if len(later) == len(events):
            if new:
                self.waiting.appendList(new)
        elif later:
            self.waiting.put([(e[0], e[2]) for e in later])
        elif waited:
            self.waiting.clear()
        ahead = [e[0] for e in later] + ([expiry(opened, self.session, self.sweep)] if opened is not None else [])
        due = min(ahead, default=None)
        if timer is not None and timer != due and not (expired and timer <= passed):
            self.handle.deleteTimer(timer)
        if due is not None and (due != timer or expired):
            self.handle.registerTimer(due)
        if due is None:
            if held:
                self.opened.clear()
        elif not held or (opened, due) != tuple(held):
            self.opened.update((opened, due))
        yield from (Row(session_id=key[0], ms=at, outcome=outcome) for at, outcome in out)

    def close(self) -> None:
        pass


def outcomes(events: DataFrame, delay: str = "0 seconds", session: int = SESSION, sweep: int = SWEEP) -> DataFrame:
    """A stream of (session_id, at, outcome) from a stream of events(session_id, at timestamp, kind): an `open` opens a session (anew, if it is open); any other kind decides it, or is unknown if it isn't open.

    Events later than `delay` behind the newest are dropped, as the watermark says.
    Needs the RocksDB state store.
    """
    keyed = events.select("session_id", "at", F.unix_millis("at").alias("ms"), "kind").withWatermark("at", delay).groupBy("session_id")
    out = keyed.transformWithState(statefulProcessor=Sessions(session, sweep), outputStructType="session_id string, ms long, outcome string", outputMode="Append", timeMode="EventTime")
    return out.select("session_id", F.timestamp_millis("ms").alias("at"), "outcome")
