"""What a session's visits cost: each call of the state is a message to another process."""

from graphloom.streaming.sessions import Sessions, expiry
from pyspark.sql import Row


class Handle:
    """State of one key, counting calls."""

    def __init__(self):
        self.calls, self.list, self.value, self.timers = 0, [], None, set()

    def getListState(self, *a):  # noqa: N802
        return self

    def getValueState(self, *a):  # noqa: N802
        h = self

        class Value:
            def get(self):
                h.calls += 1
                return h.value

            def update(self, x):
                h.calls += 1
                h.value = x

            def clear(self):
                h.calls += 1
                h.value = None

        return Value()

    def get(self):
        self.calls += 1
        return iter(self.list)

    def appendList(self, x):  # noqa: N802
        self.calls += 1
        self.list += x

    def put(self, x):
        self.calls += 1
        self.list = list(x)

    def clear(self):
        self.calls += 1
        self.list = []

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.discard(at)


class Time:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.at


def test_visits():
    h, s = Handle(), Sessions()
    s.init(h)
    rows = [Row(ms=60_000, kind="open"), Row(ms=120_000, kind="decide"), Row(ms=300_000, kind="open")]
    assert list(s.handleInputRows(("k",), iter(rows), Time(0))) == [] and h.calls <= 4 and h.timers == {60_000}
    h.calls, h.timers = 0, set()  # the engine takes an expired timer away
    out = [(r.ms, r.outcome) for r in s.handleExpiredTimer(("k",), Time(200_000), None)]
    assert out == [(60_000, "opened"), (120_000, "decided")] and h.calls <= 5 and h.timers == {300_000} and len(h.list) == 1
    h.calls, h.timers = 0, set()
    end = expiry(300_000)
    out = [(r.ms, r.outcome) for r in s.handleExpiredTimer(("k",), Time(end), None)]
    assert out == [(300_000, "opened"), (end, "expired")] and h.calls <= 4 and not h.timers and not h.list and h.value is None
