"""Lives of tasks from streams against a plain loop over all events."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pandas as pd

from spanveil.streaming.lives import EVENTS, Lives, run_through, task_lives
from spanveil.streaming.tasks import MOVES

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
KIND = "task_id string, seq long, ts timestamp, event string"


def plain(events, end, abandoned_after, kept_for):
    """Second by second, for each task: what is due, then what comes."""
    out = []
    for task in {t for t, *_ in events}:
        mine, status, asked = sorted((s, n, e) for t, n, s, e in events if t == task), None, 0
        for now in range(end + 1):
            if status == "pending" and now == asked + abandoned_after:
                status, asked = "failed", now
                out.append((task, float(now), "failed", "abandoned"))
            elif status in ("failed", "finished") and now == asked + kept_for:
                status = None
                out.append((task, float(now), "expired", "expired"))
            for _, _, event in (x for x in mine if x[0] == now):
                to = MOVES.get((status or "", event))
                if to:
                    status, asked = to, now
                    out.append((task, float(now), to, event))
                elif event == "poll":
                    asked = now
    return sorted(out)


def write(spark, path, events):
    rows = [(t, n, T0 + timedelta(seconds=s), e) for t, n, s, e in events]
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(path)


def test_a_stream_and_its_restart(spark, tmp_path):
    rng = random.Random(5)
    path, base = str(tmp_path / "in"), T0.timestamp()
    events = [(f"t{rng.randrange(12)}", n, rng.randrange(600), rng.choice(("submit", "start", "poll", "poll", "finish", "fail", "cancel", "other"))) for n in range(400)]
    early, late = [e for e in events if e[2] < 300], [e for e in events if e[2] >= 300]
    for part in (early, late):
        rng.shuffle(part)
        write(spark, path, part)
        stream = task_lives(spark.readStream.schema(KIND).parquet(path), "5 seconds", 40.0, 90.0)
        got = sorted((r.task_id, r.at - base, r.status, r.reason) for r in run_through(stream, str(tmp_path / "run")).collect())
        seen = [e for e in events if e[2] < 300] if part is early else events
        end = max(e[2] for e in seen) - 5
        assert got == plain([e for e in seen if e[2] <= end], end, 40, 90)
    assert {r[3] for r in got} >= {"abandoned", "expired", "cancel", "finish"}


class State:
    """Both kinds of state of one key, with the values that were sent to it."""

    def __init__(self):
        self.values, self.sent = [], 0

    def appendList(self, values):
        self.values += values
        self.sent += len(values)

    def appendValue(self, value):
        self.appendList([value])

    def put(self, values):
        self.values = []
        self.appendList(values)

    def update(self, value):
        self.put([value])

    def exists(self):
        return bool(self.values)

    def get(self):
        return iter(self.values) if self.many else next(iter(self.values), None)

    def clear(self):
        self.values = []


class Handle:
    """One key's states, timers and watermark."""

    def __init__(self):
        self.states, self.timers, self.now = {}, set(), 0

    def made(self, name, many):
        self.states[name] = State()
        self.states[name].many = many
        return self.states[name]

    def getListState(self, name, schema):
        return self.made(name, True)

    def getValueState(self, name, schema):
        return self.made(name, False)

    def registerTimer(self, at):
        self.timers.add(at)

    def getCurrentWatermarkInMs(self):
        return self.now


def test_values_of_a_state_do_not_grow_with_events():
    """A batch's events of a key are one value for each frame, and its tasks one value: each value costs a call of its own."""
    rng = random.Random(3)
    lives, handle, out = Lives(40.0, 90.0), Handle(), []
    lives.init(handle)
    events = [(f"t{rng.randrange(20)}", n, rng.randrange(3000), rng.choice(EVENTS)) for n in range(6000)]
    for batch in ([e for e in events if e[2] < 1500], [e for e in events if e[2] >= 1500]):
        rng.shuffle(batch)
        frames = [pd.DataFrame([(t, float(s), n, EVENTS.index(e)) for t, n, s, e in part], columns=["task_id", "at", "seq", "event"]) for part in (batch[:1000], batch[1000:])]
        list(lives.handleInputRows((7,), iter(frames), handle))
        handle.now = max(e[2] for e in batch) * 1000
        while due := min((t for t in handle.timers if t <= handle.now), default=None):
            for frame in lives.handleExpiredTimer((7,), handle, due):
                out += frame.itertuples(index=False, name=None)
            handle.timers.discard(due)
    end = handle.now // 1000
    assert sorted(out) == plain(events, end, 40, 90)
    assert sum(s.sent for s in handle.states.values()) < 20
    assert len(handle.timers) <= 1


def test_several_tasks_of_a_key_and_events_without_time_number_or_effect(spark, tmp_path):
    path, base = str(tmp_path / "in"), T0.timestamp()
    events = [(f"t{i}", 10 * i + k, s, e) for i in range(6) for k, (s, e) in enumerate([(i, "submit"), (i + 3, "start"), (i + 9, "finish"), (i + 20, "nothing"), (200, "other")])]
    rows = [(t, n, T0 + timedelta(seconds=s), e) for t, n, s, e in events] + [("t0", 900, None, "cancel"), ("t1", 901, T0 + timedelta(seconds=4), None), ("t2", None, T0 + timedelta(seconds=11), "poll"), ("t3", None, T0 + timedelta(seconds=3), "start")]
    spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(path)
    stream = task_lives(spark.readStream.schema(KIND).parquet(path), "5 seconds", 40.0, 90.0, parts=2)
    got = sorted((r.task_id, r.at - base, r.status, r.reason) for r in run_through(stream).collect())
    numbered = events + [("t2", 999, 11, "poll"), ("t3", 999, 3, "start")]
    assert got == plain(numbered, 195, 40, 90)
