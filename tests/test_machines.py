"""Streams of state machines: order of arrival, late events and the bound of what is held."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphloom.streaming import events, machines

START = datetime(2024, 5, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"


def stream(spark, folder, batches):
    """A stream that reads one of the batches at a time."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/b{k:02}")
    files = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
    return files.parquet(str(folder))


def at(seconds):
    return START + timedelta(seconds=seconds)


def run_breaker(log, **how):
    turns = machines.breaker(log, F.col("user_id"), F.col("event_type") == "error", **how)
    rows = events.run_now(turns, conf=machines.STORE).collect()
    return sorted((r.source, r.event_id, r.step, r.state) for r in rows)


def test_breaker_at_its_defaults(spark, tmp_path):
    kinds = ["error"] * 5 + ["ok", "ok"] + ["ok", "ok", "error", "ok"]
    # five failures in 40 s open it; blocked until 60 s after the last; two successes close it
    times = [0, 10, 20, 30, 40, 50, 99, 100, 110, 120, 130]
    rows = [(i, at(t), 1, k) for i, (t, k) in enumerate(zip(times, kinds, strict=True))]
    # four failures in time, the fifth 61 s after the first: stays closed
    rows += [(100 + i, at(t), 2, "error") for i, t in enumerate([0, 10, 20, 30, 61])]
    # half open, and a failure opens it again at once
    rows += [(200 + i, at(t), 3, "error") for i, t in enumerate([0, 1, 2, 3, 4, 64])]
    rows += [(999, at(10_000), 9, "ok"), (300, at(5), None, "error")]
    found = run_breaker(stream(spark, tmp_path, [rows]))
    assert found == [(1, 4, 1, "open"), (1, 7, 1, "half_open"), (1, 8, 1, "closed"), (3, 204, 1, "open"), (3, 205, 1, "half_open"), (3, 205, 2, "open")]


@pytest.mark.parametrize("seed", [1, 2])
def test_order_of_arrival_within_the_watermark_changes_nothing(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(i, at(i * 3), i % 3, rng.choice(["error", "error", "ok"])) for i in range(300)] + [(999, at(20_000), 9, "ok")]
    whole = run_breaker(stream(spark, tmp_path / "whole", [rows]))
    assert len(whole) > 10
    # each event comes up to ten minutes late, in five batches
    moved = sorted(rows[:-1], key=lambda r: r[1] + timedelta(seconds=rng.uniform(0, 600)))
    parts = [moved[k : k + 60] for k in range(0, 300, 60)] + [rows[-1:]]
    assert run_breaker(stream(spark, tmp_path / "parts", parts)) == whole


def test_events_that_are_late_are_left_out(spark, tmp_path):
    rows = [[(i, at(i), 1, "error") for i in range(4)], [(50, at(9_000), 9, "ok")], [(51, at(9_001), 9, "ok")], [(4, at(4), 1, "error")], [(60, at(30_000), 9, "ok")]]
    # the fifth failure arrives when the watermark is at 9000 s less an hour
    assert run_breaker(stream(spark, tmp_path, rows)) == []
    assert run_breaker(stream(spark, tmp_path / "in_time", [rows[0] + rows[3], rows[4]])) == [(1, 4, 1, "open")]


def plain_sessions(rows, most, evicted, idle):
    held = {}
    for event_id, ts, session, stage in sorted(rows, key=lambda r: (r[1], r[0])):
        held = {s: x for s, x in held.items() if x["last"] >= ts - timedelta(seconds=idle)}
        mine = held.setdefault(session, {"started": ts, "stages": {}})
        mine["last"] = ts
        mine["stages"][stage] = event_id
        if len(held) > most:
            for s in sorted(held, key=lambda s: held[s]["started"])[:evicted]:
                del held[s]
    return sorted((s, stage, e) for s, x in held.items() for stage, e in x["stages"].items())


def test_sessions_are_bounded_evicted_and_forgotten(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, at(i * 20), rng.randrange(90), rng.choice(["vector", "traverse", "answer"])) for i in range(900)]
    end = [(9999, at(90_000), 500, "answer"), (10_000, None, 501, "answer")]
    tables = machines.session_stages(stream(spark, tmp_path, [rows[:400], rows[400:], end]), F.lit(0), F.col("user_id"), F.col("event_type"), 30, 4, 5_000)
    found = events.run_now(tables, conf=machines.STORE).cache()
    # no table ever holds more sessions than it may
    sizes = [r.n for r in found.groupBy("as_of").agg(F.count_distinct("session").alias("n")).collect()]
    assert len(sizes) >= 2 and max(sizes) <= 30
    last = found.where(F.col("as_of") == found.agg(F.max("as_of")).first()[0]).collect()
    assert sorted((r.session, r.stage, r.event_id) for r in last) == plain_sessions(rows, 30, 4, 5_000)


def test_last_events_of_many_micro_batches(spark, tmp_path):
    from datetime import datetime, timedelta

    from graphloom.plans import registry
    from graphloom.streaming import events

    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(seconds=k // 3), k % 4 if k % 2 else 9, float(k)) for k in range(300)]
    schema = "event_id long, ts timestamp_ntz, user_id long, value double"
    for part in range(3):
        spark.createDataFrame(rows[part::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    want = sorted((u, e, v) for u in {r[2] for r in rows} for e, _, _, v in sorted((r for r in rows if r[2] == u), key=lambda r: (r[1], r[0]))[-20:])
    assert sorted(map(tuple, events.recent_now(log, 20).collect())) == want
    # no group of Python per user and part, which took most of the time
    found = registry.QUERIES["stream_recent"](spark, "/root/testdata/sf0.001")
    assert found.inputFiles() and all("version=" in f for f in found.inputFiles())


@pytest.mark.parametrize("held", [40, 400])
def test_waiting_events_are_held_by_span(spark, tmp_path, monkeypatch, held):
    """In whatever order a key's events come, they make the same tables."""
    rng = random.Random(8)
    rows = [(i, at(i * 20), rng.randrange(90), rng.choice(["vector", "traverse", "answer"])) for i in range(900)]
    end = [(9999, at(90_000), 500, "answer")]
    monkeypatch.setattr(machines, "HELD", held)
    monkeypatch.setattr(machines, "SPAN", 2_000_000_000)
    mixed = rng.sample(rows[:500], 500)
    tables = machines.session_stages(stream(spark, tmp_path / "log", [mixed, rows[500:], end]), F.lit(0), F.col("user_id"), F.col("event_type"), 30, 4, 5_000)
    found = events.run_now(tables, conf=machines.STORE).cache()
    last = found.where(F.col("as_of") == found.agg(F.max("as_of")).first()[0]).collect()
    assert sorted((r.session, r.stage, r.event_id) for r in last) == plain_sessions(rows, 30, 4, 5_000)


class Held:
    """State of one key as a processor sees it."""

    def __init__(self):
        self.value, self.rows, self.map, self.timers, self.most = None, [], {}, set(), 0

    def getListState(self, name, schema):  # noqa: N802
        own = Held()
        own.get, own.clear, own.put, own.appendList = lambda: iter(own.rows), own.rows.clear, own.rows.extend, own.rows.extend
        setattr(self, name, own)
        return own

    def getValueState(self, name, schema):  # noqa: N802
        own = Held()
        own.exists, own.get, own.update = lambda: own.value is not None, lambda: own.value, lambda v: setattr(own, "value", v)
        return own

    def getMapState(self, name, keys, schema):  # noqa: N802
        own = Held()
        own.keys, own.getValue, own.removeKey, own.updateValue = lambda: iter(list(own.map)), own.map.__getitem__, own.map.pop, own.map.__setitem__
        return own

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.now


def test_a_task_holds_a_span_and_not_a_key():
    """10,000 events of one key that arrive at once, in any order, are given in order and never more than a span's at a time."""
    rng = random.Random(3)
    table = machines._Sessions(30, 4, 5_000 * 1_000_000)
    table.span, table.held = 1_000_000_000, 300
    handle, sizes, order = Held(), [], []
    handle.now = 0
    table.init(handle)

    def fold(key, spans, until):
        for events in spans:
            sizes.append(len(events))
            order.extend(events)
        yield pd.DataFrame()

    table.fold = fold
    rows = [(k * 1_000_000, k, k % 7, "answer") for k in range(10_000)]
    mixed = rng.sample(rows, len(rows))
    frame = lambda part: pd.DataFrame(part, columns=["at", "id", "session", "stage"])
    assert not list(table.handleInputRows((0,), iter([frame(mixed[k : k + 100]) for k in range(0, 10_000, 100)]), handle))
    # the watermark passes in three steps, the last within a span; no timer is missing
    for seconds in (2_500, 7_000, 20_000):
        handle.now = seconds * 1000
        while due := sorted(t for t in handle.timers if t <= handle.now):
            handle.timers.difference_update(due)
            for _ in due:
                list(table.handleExpiredTimer((0,), handle, None))
        assert order == rows[: min(seconds, 10_000)]
    assert max(sizes) <= 1_000 and not handle.timers


@pytest.mark.parametrize("held", [3, 1_000])
def test_breaker_is_the_same_by_spans(spark, tmp_path, monkeypatch, held):
    rng = random.Random(1)
    rows = [(i, at(i * 3), i % 3, rng.choice(["error", "error", "ok"])) for i in range(300)] + [(999, at(20_000), 9, "ok")]
    whole = run_breaker(stream(spark, tmp_path / "whole", [rows]))
    monkeypatch.setattr(machines, "HELD", held)
    monkeypatch.setattr(machines, "SPAN", 60_000_000)
    moved = rng.sample(rows[:-1], 299)
    assert run_breaker(stream(spark, tmp_path / "parts", [moved[:100], moved[100:], rows[-1:]])) == whole
