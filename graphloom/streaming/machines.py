"""State machines over streams, in order of event time: a circuit breaker for each source, and the bounded session table of each monitor.

Both keep what has arrived until the watermark has passed it, so that the result doesn't depend on the
order of arrival: when an event-time timer fires, the events before the watermark are folded into the
state in order of time and id. An event that arrives when the watermark has already passed it is late and
left out, and so is one with a null key, time or other value. What a key's state holds is bounded: the events of one watermark delay, and a
state of fixed size. A micro-batch may bring all of a log at once, so of a key that has more than ``HELD`` events waiting those of one span of time
(``SPAN``) wait together, and are read span by span: a task holds the events of one span of a key, or ``HELD``, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that such processors need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


#: Microseconds of a span, and events of a key that wait in one list, at most.
SPAN, HELD = 3_600_000_000, 100_000


class InOrder(StatefulProcessor):
    """Gives each key's events to :meth:`fold` in order of time and id, once the watermark has passed them."""

    #: Columns of an event after its time in microseconds and its id.
    event = ""
    columns: tuple[str, ...] = ()

    def __init__(self) -> None:
        self.span, self.held = SPAN, HELD

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        schema = f"at long, id long, {self.event}"
        self.pending = handle.getListState("pending", schema)
        kinds = [c.strip().split(" ") for c in schema.split(",")]
        self.spans = handle.getMapState("spans", "span long, part long", ", ".join(f"{name} array<{kind}>" for name, kind in kinds))
        #: events in the list, and parts of spans that have been written
        self.waiting = handle.getValueState("waiting", "listed long, parts long")

    def fold(self, key: tuple, spans: Iterator[list[tuple]], until: int) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = max(0, timerValues.getCurrentWatermarkInMs()) * 1000
        listed, parts = self.waiting.get() if self.waiting.exists() else (0, 0)
        came, first = [], None
        for frame in rows:
            frame = frame[frame["at"] >= passed]
            came += list(zip(*[frame[c].tolist() for c in ("at", "id", *self.columns)], strict=True))
            if listed + len(came) > self.held:
                first = min(e[0] for e in chain(came, [(first,)] if first is not None else []))
                parts += self._part(came, parts) + self._unlist(listed, parts + 1)
                came, listed = [], 0
        if came:
            first = min(e[0] for e in chain(came, [(first,)] if first is not None else []))
            self.pending.appendList(came)
        if first is not None:
            self.waiting.update((listed + len(came), parts))
            self._wake(first)
        return iter(())

    def _part(self, events: list[tuple], part: int) -> int:
        """Add a part to each span that some events belong to; 1, the number of parts."""
        for span, own in groupby(sorted(events), key=lambda e: e[0] // self.span):
            self.spans.updateValue((span, part), tuple(list(c) for c in zip(*own, strict=True)))
        return 1

    def _unlist(self, listed: int, part: int) -> int:
        """Move the list's events to their spans; the number of parts."""
        if not listed:
            return 0
        events = list(self.pending.get())
        self.pending.clear()
        return self._part(events, part)

    def _ready(self, until: int) -> Iterator[list[tuple]]:
        """The events before a time, those of one span or of the whole list at once; they are forgotten, and the next ones get a timer."""
        listed, parts = self.waiting.get() if self.waiting.exists() else (0, 0)
        if not parts:
            held = sorted(self.pending.get())
            ready = [e for e in held if e[0] < until]
            rest = held[len(ready) :]
            self.pending.clear()
            if rest:
                self.pending.put(rest)
                self._wake(rest[0][0])
            self.waiting.update((len(rest), 0))
            if ready:
                yield ready
            return
        parts += self._unlist(listed, parts)
        self.waiting.update((0, parts))
        for span, keys in groupby(sorted(tuple(k) for k in self.spans.keys()), key=lambda k: k[0]):  # noqa: SIM118
            if span * self.span >= until:
                self._wake(span * self.span)
                return
            keys = list(keys)
            held = sorted(e for k in keys for e in zip(*self.spans.getValue(k), strict=True))
            ready = [e for e in held if e[0] < until]
            rest = held[len(ready) :]
            if ready:
                for k in keys:
                    self.spans.removeKey(k)
                if rest:
                    self.spans.updateValue(keys[0], tuple(list(c) for c in zip(*rest, strict=True)))
                yield ready
            if rest:
                self._wake(rest[0][0])
                return
        # none is left in spans, so the list is enough again
        self.waiting.update((0, 0))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = timerValues.getCurrentWatermarkInMs() * 1000
        spans = self._ready(until)
        first = next(spans, None)
        return self.fold(key, chain([first], spans), until) if first is not None else iter(())

    def _wake(self, at: int) -> None:
        """A timer for the first watermark after an event; one that is there already is the same."""
        self.handle.registerTimer(at // 1000 + 1)

    def close(self) -> None:
        pass


CLOSED, OPEN, HALF_OPEN = "closed", "open", "half_open"


class _Breaker(InOrder):
    event, columns = "failed boolean", ("failed",)

    def __init__(self, window: int, failures: int, successes: int, timeout: int):
        super().__init__()
        self.window, self.failures, self.successes, self.timeout = window, failures, successes, timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.machine = handle.getValueState("machine", "state string, good int, failed_at long")
        #: times of the failures that count while the circuit is closed: fewer than open it
        self.recent = handle.getListState("recent", "at long")

    def fold(self, key: tuple, spans: Iterator[list[tuple]], until: int) -> Iterator[pd.DataFrame]:
        state, good, failed_at = self.machine.get() if self.machine.exists() else (CLOSED, 0, 0)
        recent = [at for (at,) in self.recent.get()]
        out = []

        def turn(to: str) -> None:
            nonlocal state, good
            state, good = to, 0
            out.append((key[0], event_id, at, sum(1 for o in out if o[1] == event_id) + 1, to))

        for events in spans:
            out.clear()
            for at, event_id, failed in events:
                if state == OPEN and at - failed_at >= self.timeout:
                    turn(HALF_OPEN)
                if state == OPEN:
                    continue  # blocked: what would have come of it doesn't count
                if failed:
                    failed_at = at
                    if state == HALF_OPEN:
                        turn(OPEN)
                    else:
                        recent = [t for t in recent if t > at - self.window] + [at]
                        if len(recent) >= self.failures:
                            turn(OPEN)
                            recent = []
                elif state == HALF_OPEN:
                    good += 1
                    if good >= self.successes:
                        turn(CLOSED)
            if out:
                yield pd.DataFrame(out, columns=["source", "event_id", "at", "step", "state"])
        self.machine.update((state, good, failed_at))
        self.recent.clear()
        if recent:
            self.recent.put([(t,) for t in recent])


def breaker(log: DataFrame, source: Column, failed: Column, window: int = 60, failures: int = 5, successes: int = 2, timeout: int = 60, late: str = "1 hour") -> DataFrame:
    """``(source, event_id, at, step, state)``: each change of the state of a source's circuit, with the event that made it.

    A closed circuit opens at ``failures`` failures within ``window`` seconds. An open one lets nothing
    through until ``timeout`` seconds after the last failure; then it is half open: ``successes`` successes
    close it, a failure opens it again. One event may make two changes, which ``step`` numbers.
    """
    rows = log.withWatermark("ts", late).select(source.alias("source"), "ts", F.unix_micros("ts").alias("at"), F.col("event_id").alias("id"), failed.alias("failed"))
    kind = f"source {rows.schema['source'].dataType.simpleString()}, event_id long, at long, step int, state string"
    machine = _Breaker(window * 1_000_000, failures, successes, timeout * 1_000_000)
    return rows.where("source IS NOT NULL AND at IS NOT NULL AND id IS NOT NULL AND failed IS NOT NULL").groupBy("source").transformWithStateInPandas(machine, kind, "append", "EventTime")


class _Sessions(InOrder):
    event, columns = "session long, stage string", ("session", "stage")

    def __init__(self, most: int, evicted: int, idle: int):
        super().__init__()
        self.most, self.evicted, self.idle = most, evicted, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        #: in order of their start; never more than ``most`` when a fold ends
        self.sessions = handle.getListState("sessions", "session long, started long, last long, stages array<string>, ids array<long>")

    def fold(self, key: tuple, spans: Iterator[list[tuple]], until: int) -> Iterator[pd.DataFrame]:
        held = {s: [started, last, dict(zip(stages, ids, strict=True))] for s, started, last, stages, ids in self.sessions.get()}
        for at, event_id, session, stage in chain.from_iterable(spans):
            held = {s: x for s, x in held.items() if x[1] >= at - self.idle}
            mine = held.setdefault(session, [at, at, {}])
            mine[1] = at
            mine[2][stage] = event_id
            if len(held) > self.most:
                for s in sorted(held, key=lambda s: held[s][0])[: self.evicted]:
                    del held[s]
        self.sessions.clear()
        self.sessions.put([(s, started, last, list(stages), list(stages.values())) for s, (started, last, stages) in held.items()])
        rows = [(key[0], s, started, stage, event_id, until) for s, (started, _, stages) in held.items() for stage, event_id in stages.items()]
        yield pd.DataFrame(rows, columns=["monitor", "session", "started", "stage", "event_id", "as_of"])


def session_stages(log: DataFrame, monitor: Column, session: Column, stage: Column, most: int = 100, evicted: int = 10, idle: int = 86_400, late: str = "1 hour") -> DataFrame:
    """``(monitor, session, started, stage, event_id, as_of)``: each monitor's session table whenever it changed, a row for each stage's latest event.

    A session is forgotten when ``idle`` seconds passed without an event of it, and of more than ``most`` sessions
    the ``evicted`` that started first are; a later event starts it anew. The table at a time are the rows with the
    largest ``as_of`` of a monitor.
    """
    rows = log.withWatermark("ts", late).select(
        monitor.alias("monitor"), "ts", F.unix_micros("ts").alias("at"), F.col("event_id").alias("id"), session.cast("long").alias("session"), stage.alias("stage")
    )
    kind = f"monitor {rows.schema['monitor'].dataType.simpleString()}, session long, started long, stage string, event_id long, as_of long"
    table = _Sessions(most, evicted, idle * 1_000_000)
    known = rows.where("at IS NOT NULL AND id IS NOT NULL AND monitor IS NOT NULL AND session IS NOT NULL AND stage IS NOT NULL")
    return known.groupBy("monitor").transformWithStateInPandas(table, kind, "append", "EventTime")
