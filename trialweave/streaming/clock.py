"""The frames of a trial while its samples still arrive.

Packets (trial_id, seq from 0, ts, pcm) may overtake each other within the watermark's delay. A trial's state is the next
packet's number, the steps so far, the samples of the unfinished frame, and packets that came too early. A
trial ends when event time has passed its last packet by ``idle`` seconds: a timer then feeds the silence, fills up the last
frame, and clears the state. No more than ``most`` frames are made of a trial; after that only its numbers are kept.
Each call of a worker to its state store takes far longer than a frame, so a stream deals its trials over ``BUCKETS`` keys; the open trials of a key are
read and written at once, and its timer is that of the trial that ends first.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trialweave.session import ship_by_value
from trialweave.streaming.live import BUCKETS, _run_out

#: A row of this trial only moves event time on.
HEARTBEAT = -1
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Trial:
    """What is kept of an open trial."""

    seq: int = 0
    step: int = 0
    ends: int = -1
    left: np.ndarray = field(default_factory=lambda: np.empty(0, np.float32))
    early: dict[int, np.ndarray] = field(default_factory=dict)


class FrameClock(StatefulProcessor):
    """The frames of one trial for each key."""

    def __init__(self, frame: int, silence: int, most: int | None, idle: float) -> None:
        self.frame, self.silence, self.most, self.idle = frame, silence, most, int(idle * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.trial = handle.getValueState("trial", "seq long, step long, ends long, left array<float>")
        self.early = handle.getMapState("early", "seq long", "pcm array<float>")

    def _cut(self, trial: Trial, parts: list[np.ndarray], fill: bool) -> tuple[int, np.ndarray]:
        """The first step and the whole frames of what is left and ``parts``, or with ``fill`` of all of it."""
        pcm, first = np.concatenate([trial.left, *parts]), trial.step
        n = -(-len(pcm) // self.frame) if fill else len(pcm) // self.frame
        room = n if self.most is None else max(0, min(n, self.most - first))
        trial.step += room
        trial.left = pcm[:0] if self.most is not None and trial.step >= self.most else pcm[n * self.frame :]
        found = pcm[: room * self.frame]
        if len(found) < room * self.frame:
            found = np.append(found, np.zeros(room * self.frame - len(found), np.float32))
        return first, found.reshape(room, self.frame)

    def _heard(self, trial: Trial, packets: dict[int, np.ndarray], ends: int) -> tuple[int, np.ndarray]:
        """The first step and the frames that ``packets`` complete."""
        parts = []
        while trial.seq in packets or trial.seq in trial.early:
            early = trial.early.pop(trial.seq, None)
            parts.append(packets.get(trial.seq, early))
            trial.seq += 1
        trial.early |= {k: pcm for k, pcm in packets.items() if k > trial.seq}
        trial.ends = max(trial.ends, ends)
        return self._cut(trial, parts, False)

    def _ended(self, trial: Trial) -> tuple[int, np.ndarray]:
        """The first step and the last frames. Packets behind a lost one are taken as if it had not been."""
        return self._cut(trial, [*(trial.early[k] for k in sorted(trial.early)), np.zeros(self.silence, np.float32)], True)

    @staticmethod
    def _rows(found: list[tuple[int, int, np.ndarray]]) -> Iterator[pd.DataFrame]:
        """Rows of (trial, first step, frames); nothing if there are none."""
        sizes = [len(frames) for _, _, frames in found]
        if sum(sizes):
            steps = np.concatenate([np.arange(first, first + n) for (_, first, _), n in zip(found, sizes, strict=True)])
            trials = np.repeat(np.array([trial for trial, _, _ in found], np.int64), sizes)
            yield pd.DataFrame({"trial_id": trials, "step": steps, "frame": pd.Series([x for _, _, frames in found for x in frames], dtype=object)})

    def _kept(self) -> Trial:
        seq, step, ends, left = self.trial.get()
        return Trial(seq, step, ends, np.array(left, np.float32), {k[0]: np.array(pcm[0], np.float32) for k, pcm in self.early.iterator()})

    def _timed(self, before: int, after: int) -> None:
        """Moves the key's timer; -1 is none."""
        if after != before:
            if before >= 0:
                self.handle.deleteTimer(before)
            if after >= 0:
                self.handle.registerTimer(after)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        if key[0] == HEARTBEAT:
            return
        trial = self._kept() if self.trial.exists() else Trial()
        came, before, early = pd.concat(rows), trial.ends, set(trial.early)
        packets = {int(k): np.array(pcm, np.float32) for k, pcm in zip(came["seq"], came["pcm"], strict=True)}
        first, frames = self._heard(trial, packets, int(came["ts"].max().timestamp() * 1000) + self.idle)
        for number in early - set(trial.early):
            self.early.removeKey((number,))
        for number in set(trial.early) & set(packets):
            self.early.updateValue((number,), (trial.early[number].tolist(),))
        self._timed(before, trial.ends)
        self.trial.update((trial.seq, trial.step, trial.ends, trial.left.tolist()))
        yield from self._rows([(key[0], first, frames)])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        if self.trial.exists():
            first, frames = self._ended(self._kept())
            self.early.clear()
            self.trial.clear()
            yield from self._rows([(key[0], first, frames)])

    def close(self) -> None:
        pass


class FrameClocks(FrameClock):
    """The frames of all trials that share a key; rows are trial_id, seq, at (milliseconds) and pcm."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "trial_id long, seq long, step long, ends long, left binary, numbers array<long>, sizes array<long>, early binary")

    def _load(self) -> dict[int, Trial]:
        found = {}
        for number, seq, step, ends, left, numbers, sizes, early in self.open.get():
            parts = np.split(np.frombuffer(early, np.float32), np.cumsum(sizes)[:-1]) if numbers else []
            found[number] = Trial(seq, step, ends, np.frombuffer(left, np.float32), dict(zip(numbers, parts, strict=True)))
        return found

    def _save(self, trials: dict[int, Trial]) -> None:
        if trials:
            self.open.put([(number, x.seq, x.step, x.ends, x.left.tobytes(), list(x.early), [len(p) for p in x.early.values()], b"".join(p.tobytes() for p in x.early.values())) for number, x in trials.items()])
        else:
            self.open.clear()

    @staticmethod
    def _next(trials: dict[int, Trial]) -> int:
        """When the first of them ends; -1 if there are none."""
        return min((x.ends for x in trials.values()), default=-1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        came = pd.concat(rows)
        came = came[came["trial_id"] != HEARTBEAT].sort_values("trial_id", kind="stable")
        if came.empty:
            return
        trials, found = self._load(), []
        before = self._next(trials)
        numbers, firsts = np.unique(came["trial_id"].to_numpy(), return_index=True)
        seq, at, pcm = came["seq"].tolist(), came["at"].to_numpy(), came["pcm"].to_numpy()
        for number, a, b in zip(numbers.tolist(), firsts, [*firsts[1:], len(came)], strict=True):
            packets = {k: np.asarray(x, np.float32) for k, x in zip(seq[a:b], pcm[a:b], strict=True)}
            found.append((number, *self._heard(trials.setdefault(number, Trial()), packets, int(at[a:b].max()) + self.idle)))
        self._timed(before, self._next(trials))
        self._save(trials)
        yield from self._rows(found)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        trials, now, due = self._load(), timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        over = [number for number, x in trials.items() if x.ends < now or x.ends <= due]
        found = [(number, *self._ended(trials.pop(number))) for number in over]
        # Spark itself removes the timer that has expired.
        self._timed(-1, self._next(trials))
        self._save(trials)
        yield from self._rows(found)


@contextmanager
def _state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started within this keep their state in RocksDB, which state of this kind needs."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def live_frames(packets: DataFrame, frame: int, silence: int, most: int | None, idle: float, delay: str) -> DataFrame:
    """trial_id, step and frame of a stream of ``packets``; start it with ``frames_of``, or within ``_state_in_rocksdb``.

    Packets later than ``delay`` behind the newest are dropped, as Spark does with a watermark. A packet that comes twice counts once.
    """
    ship_by_value()
    timed = packets.select("trial_id", "seq", "ts", F.unix_millis("ts").alias("at"), "pcm").withWatermark("ts", delay)
    bucket = F.pmod(F.xxhash64("trial_id"), F.lit(BUCKETS)).alias("bucket")
    return timed.select(bucket, "*").groupBy("bucket").transformWithStateInPandas(FrameClocks(frame, silence, most, idle), "trial_id long, step long, frame array<float>", "append", "EventTime")


def frames_of(spark: SparkSession, folder: str, files_at_once: int, frame: int, silence: int, most: int | None, idle: float, delay: str) -> DataFrame:
    """All frames of the packets in a folder's files, read a few files at a time in the order they were written."""
    stream = spark.readStream.schema("trial_id long, seq long, ts timestamp, pcm array<float>").option("maxFilesPerTrigger", files_at_once).parquet(folder)
    with _state_in_rocksdb(spark):
        return _run_out(live_frames(stream, frame, silence, most, idle, delay), "append").drop("batch")
