"""Live trials: packets out of order, lost, repeated; ends, caps and late events."""

import datetime as dt
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from support import DATA, same_as_sql

from trialweave.plans.catalogue import ORACLE_SQL, QUERIES
from trialweave.streaming import arrival, clock, live
from trialweave.streaming.arrival import arriving, files_for
from trialweave.streaming.clock import HEARTBEAT, FrameClock, FrameClocks, frames_of
from trialweave.streaming.live import live_answers, live_windows


class Held:
    """State of one key, in memory."""

    def __init__(self):
        self.value, self.map, self.timers = None, {}, set()

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def getMapState(self, name, key, value):  # noqa: N802
        return self.Early(self.map)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)

    class Early:
        def __init__(self, held):
            self.held = held

        def containsKey(self, key):  # noqa: N802
            return key in self.held

        def getValue(self, key):  # noqa: N802
            return self.held[key]

        def updateValue(self, key, value):  # noqa: N802
            self.held[key] = value

        def removeKey(self, key):  # noqa: N802
            del self.held[key]

        def iterator(self):
            return iter(list(self.held.items()))

        def clear(self):
            self.held.clear()


def played(batches, frame=4, silence=0, most=None):
    """The frames of one trial whose packets (seq, samples) come in ``batches``, and the state before and after its end."""
    held, clock, out = Held(), FrameClock(frame, silence, most, 1.0), []
    clock.init(held)
    for k, batch in enumerate(batches):
        rows = pd.DataFrame({"seq": [s for s, _ in batch], "pcm": [p for _, p in batch], "ts": pd.to_datetime([1000 * k + s for s, _ in batch], unit="ms")})
        out += list(clock.handleInputRows((7,), iter([rows]), None))
        assert len(held.timers) == 1
    before = held.value
    out += list(clock.handleExpiredTimer((7,), None, None))
    assert held.value is None
    assert not held.map
    found = pd.concat(out) if out else pd.DataFrame({"step": [], "frame": []})
    assert found["step"].tolist() == list(range(len(found)))
    return [[float(x) for x in f] for f in found["frame"]], before


def packets(n, size):
    return [(k, np.arange(k * size, min((k + 1) * size, n), dtype=float).tolist()) for k in range(-(-n // size))]


def whole(n, frame, silence=0, most=None):
    pcm = np.append(np.arange(n, dtype=float), np.zeros(silence + (-(n + silence)) % frame))
    return pcm.reshape(-1, frame).tolist()[:most]


@pytest.mark.parametrize("size", [1, 3, 4, 9])
def test_frames_whatever_the_batches(size):
    all_at_once, _ = played([packets(22, size)])
    one_by_one, _ = played([[p] for p in packets(22, size)])
    assert all_at_once == one_by_one == whole(22, 4)


def test_packets_that_overtake_each_other_or_come_twice():
    p = packets(22, 3)
    assert played([[p[1], p[2]], [p[0], p[0], p[5]], [p[1], p[4], p[3]], [p[7], p[6]]])[0] == whole(22, 4)


def test_a_lost_packet_is_left_out():
    p = packets(12, 3)
    assert played([[p[0], p[1]], [p[3]]])[0] == [[0, 1, 2, 3], [4, 5, 9, 10], [11, 0, 0, 0]]


def test_silence_and_cap():
    assert played([packets(10, 3)], silence=7)[0] == whole(10, 4, 7)
    assert played([packets(10, 3)], silence=7, most=3)[0] == whole(10, 4, 7, 3)
    found, before = played([[p] for p in packets(40, 3)], most=2)
    assert found == whole(40, 4, 0, 2)
    assert before[3] == []  # beyond the cap no samples are kept


def test_heartbeats_have_no_frames():
    clock = FrameClock(4, 9, None, 1.0)
    clock.init(Held())
    assert list(clock.handleInputRows((HEARTBEAT,), iter([]), None)) == []


def test_trials_over_micro_batches(spark):
    at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(t, k, at + dt.timedelta(milliseconds=80 * k + 3 * t), p) for t in range(3) for k, p in packets(20 + t, 3)]
    folder = arriving(spark.createDataFrame(rows, "trial_id long, seq long, ts timestamp, pcm array<float>"), "ts", 3, trial_id=HEARTBEAT)
    found = frames_of(spark, folder, 1, frame=4, silence=2, most=6, idle=0.5, delay="1 second").orderBy("trial_id", "step").collect()
    assert [[r["frame"] for r in found if r["trial_id"] == t] for t in range(3)] == [whole(20 + t, 4, 2, 6) for t in range(3)]


def test_late_events_are_dropped_and_their_frame_stays(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    schema = "event_id long, ts timestamp, user_id long, event_type string, props string"
    for k, millis in enumerate(([0, 10, 100], [5000], [5001], [20, 5002], [5010, 90_000], [95_000])):
        rows = [(i, at + dt.timedelta(milliseconds=m), 1, "click", '{"k": 5}') for i, m in enumerate(millis)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
    found = live_windows(spark, str(tmp_path), 80, "80 milliseconds", "1 second").collect()
    base = int(at.timestamp() * 1e6)
    assert {(r["frame"] - base) // 1000: r["n_outputs"] for r in found} == {0: 2, 80: 1, 4960: 4, 90_000: 1}


class Listed:
    """List state and timers of one key, and how often they were called."""

    def __init__(self):
        self.rows, self.timers, self.calls = [], set(), 0

    def getListState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self.calls += 1
        self.rows = rows

    def clear(self):
        self.calls += 1
        self.rows = []

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.remove(at)


@pytest.mark.parametrize("trials", [1, 40])
def test_trials_of_one_key_take_few_calls_to_the_store(trials):
    rng = np.random.default_rng(trials)
    sent = [(t, k, 1000 * t + 10 * k, p) for t in range(trials) for k, p in packets(20 + t, 3)]
    batches = np.array_split(rng.permutation(len(sent)), 5)
    held, clocks, out = Listed(), FrameClocks(4, 2, None, 1.0), []
    clocks.init(held)
    for batch in batches:
        rows = pd.DataFrame([sent[i] for i in batch] + [(HEARTBEAT, 0, 0, None)], columns=["trial_id", "seq", "at", "pcm"])
        out += list(clocks.handleInputRows((0,), iter([rows]), None))
        assert len(held.timers) == 1
    while held.timers:
        due = min(held.timers)
        assert due == min(r[3] for r in held.rows)
        watermark = TimerValues(-1, due + 5000)
        out += list(clocks.handleExpiredTimer((0,), watermark, ExpiredTimerInfo(due)))
        held.timers.remove(due)
        assert all(r[3] >= due + 5000 for r in held.rows)
    assert not held.rows
    assert held.calls <= 5 * 4 + 3 * -(-trials // 5)
    found = pd.concat(out).sort_values(["trial_id", "step"])
    assert {t: [x.tolist() for x in rows["frame"]] for t, rows in found.groupby("trial_id")} == {t: whole(20 + t, 4, 2) for t in range(trials)}


@pytest.mark.parametrize("buckets", [1, 3])
def test_trials_that_share_a_key_over_micro_batches(spark, monkeypatch, buckets):
    monkeypatch.setattr(clock, "BUCKETS", buckets)
    at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(t, k, at + dt.timedelta(milliseconds=80 * k + 700 * t + (250 if k % 5 == 3 else 0)), p) for t in range(12) for k, p in packets(20 + t, 3)]
    folder = arriving(spark.createDataFrame(rows, "trial_id long, seq long, ts timestamp, pcm array<float>"), "ts", 4, trial_id=HEARTBEAT)
    found = frames_of(spark, folder, 1, frame=4, silence=2, most=None, idle=0.5, delay="1 second").orderBy("trial_id", "step").collect()
    assert {t: [r["frame"] for r in found if r["trial_id"] == t] for t in range(12)} == {t: whole(20 + t, 4, 2) for t in range(12)}


def test_answers_of_trials_that_share_a_key(spark, monkeypatch):
    monkeypatch.setattr(live, "BUCKETS", 2)
    rng = np.random.default_rng(5)
    at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    events = [(i, at + dt.timedelta(seconds=int(rng.integers(0, 50))), int(rng.integers(0, 9)) if i % 10 else None, "click", None if i % 7 == 0 else f'{{"k": {int(rng.integers(-50, 50))}}}') for i in range(300)]
    folder = arriving(spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, props string"), "ts", 3)
    want, heard, steps = [], {}, {}
    for _, _, user, _, props in sorted(events, key=lambda e: (e[1], e[0])):
        if user is not None:
            heard[user] = heard.get(user, 0) + (int(props[6:-1]) if props else 0)
            steps[user] = steps.get(user, -1) + 1
            want.append((user, steps[user], (heard[user] + 4) % 97))
    assert sorted(tuple(r) for r in live_answers(spark, folder, 4).select("trial_id", "step", "text_id").collect()) == sorted(want)


def test_the_cap_of_trials_that_share_a_key():
    held, clocks, out = Listed(), FrameClocks(4, 7, 3, 1.0), []
    clocks.init(held)
    sent = [(t, k, 10 * k, p) for t in (1, 2, 3) for k, p in packets(6 * t, 3)]
    for part in (sent[::2], sent[1::2]):
        out += list(clocks.handleInputRows((0,), iter([pd.DataFrame(part, columns=["trial_id", "seq", "at", "pcm"])]), None))
    assert {r[0]: len(r[4]) for r in held.rows} == {1: 4 * 2, 2: 0, 3: 0}  # bytes; beyond the cap no samples are kept
    for due in sorted({r[3] for r in held.rows}):
        out += list(clocks.handleExpiredTimer((0,), TimerValues(-1, due), ExpiredTimerInfo(due)))
    found = pd.concat(out).sort_values(["trial_id", "step"])
    assert {t: [x.tolist() for x in rows["frame"]] for t, rows in found.groupby("trial_id")} == {t: whole(6 * t, 4, 7, 3) for t in (1, 2, 3)}


def test_each_slice_arrives_in_as_many_files(spark, monkeypatch):
    monkeypatch.setattr(arrival, "ROWS", 50)
    at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    # By time 400 rows, none, 2 and 3.
    seconds = [*(k % 25 for k in range(400)), 55, 56, 80, 81, 100]
    rows = spark.createDataFrame([(i, at + dt.timedelta(seconds=s)) for i, s in enumerate(seconds)], "id long, ts timestamp")
    assert files_for(rows, 4) == 3
    folder = arriving(rows, "ts", 4, files_for(rows, 4), id=HEARTBEAT)
    files = sorted(Path(folder.removeprefix("file://")).glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    assert len(files) == 3 * 3 + 1
    found = [sorted(r["id"] for r in spark.read.parquet(*map(str, files[k : k + 3])).collect()) for k in range(0, 10, 3)]
    assert found == [list(range(400)), [400, 401], [402, 403, 404], [HEARTBEAT]]
    assert min(spark.read.parquet(str(p)).count() for p in files[:3]) > 0


@pytest.mark.parametrize("name", ["q33_stream_equals_batch", "q37_stream_answers", "q46_live_frames", "q47_live_steps", "q48_live_windows"])
def test_streams_of_slices_in_several_files_equal_sql(spark, monkeypatch, name):
    monkeypatch.setattr(arrival, "ROWS", 120)
    same_as_sql(spark, QUERIES[name], ORACLE_SQL[name], f"{DATA}/sf0.001")
