"""Runs of a response model, one trial at a time, many trials at once.

A responder is a plug-in: called with a seed, it returns a function from one
frame to a step's output, (text_id, audio_tokens), or none while it buffers. Its
state lives within one trial, so trials may run in any order and anywhere.
"""

from __future__ import annotations

import sys
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.session import ship_by_value
from trialweave.sources.arrays import arrays

#: Outputs that are held before a batch of trials leaves.
OUTPUTS = 20_000
Step = Callable[[np.ndarray], tuple[int, list[int]] | None]
Responder = Callable[[int], Step]

_STEPS = pa.list_(pa.struct([("step", pa.int32()), ("text_id", pa.int32()), ("audio_tokens", pa.list_(pa.int32()))]))


class PerWorker:
    """A responder or decoder that ``build`` makes, such as a model that takes long to load: once in each worker process, whatever tasks it runs.

    If it can't be made, that fails the trials that ask for it, one after another.
    """

    def __init__(self, build: Callable[[], Callable]) -> None:
        self.build, self.key = build, uuid.uuid4().hex

    def __call__(self, *args: object) -> object:
        # Functions travel by value, so their module begins anew in each task; ``sys`` lasts as long as the process.
        held = sys.__dict__.setdefault("_trialweave_built", {})
        if self.key not in held:
            held[self.key] = self.build()
        return held[self.key](*args)


def echo_responder(seed: int) -> Step:
    """A deterministic stand-in for a model: it buffers one frame, then answers from the loudness of what it heard."""
    heard = [0]

    def step(frame: np.ndarray) -> tuple[int, list[int]] | None:
        heard[0] += int(np.rint(np.abs(frame.astype(np.float64)) * 1000).sum())
        buffered, heard[1:] = len(heard) == 1, [True]
        return None if buffered else ((heard[0] + seed) % 97, [heard[0] % 5 - seed % 2, seed])

    return step


_DONE = "trial_idx long, seed long, status string, error string, total_steps int, wall_time_sec double, steps array<struct<step:int,text_id:int,audio_tokens:array<int>>>"
_NAMES = [x.split()[0] for x in _DONE.split(", ")]


def _one(responder: Responder, seed: int, pcm: np.ndarray | None, silence_samples: int, frame_size: int, most_steps: int) -> tuple[str, str | None, int, float, list[dict]]:
    """Status, error, fed steps, seconds and outputs of a trial. Frames are cut from the waveform one at a time."""
    if pcm is None:
        return "load_failed", "no waveform", 0, 0.0, []
    began, n, found = time.monotonic(), min(-(-(len(pcm) + silence_samples) // frame_size), most_steps), []
    try:
        step = responder(seed)
        for k in range(n):
            frame = pcm[k * frame_size : (k + 1) * frame_size]
            out = step(frame if len(frame) == frame_size else np.pad(frame, (0, frame_size - len(frame))))
            if out is not None:
                found.append({"step": k, "text_id": out[0], "audio_tokens": out[1]})
    except Exception as error:  # noqa: BLE001  a trial's failure is a result
        return "failed", str(error), n, round(time.monotonic() - began, 3), []
    return "completed", None, n, round(time.monotonic() - began, 3), found


def _batches(trials: Iterable[tuple[int, int, np.ndarray | None]], run: Callable[[int, np.ndarray | None], tuple]) -> Iterator[pa.RecordBatch]:
    """The rows of trials (trial_idx, seed, pcm), as many at a time as have ``OUTPUTS`` outputs."""
    held, size = [], 0
    for trial_idx, seed, pcm in trials:
        held.append((trial_idx, seed, *run(seed, pcm)))
        size += 1 + len(held[-1][-1])
        if size >= OUTPUTS:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, seeds, status, error, n, took, steps = (list(x) for x in zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(seeds, pa.int64()), pa.array(status, pa.string()), pa.array(error, pa.string()), pa.array(n, pa.int32()), pa.array(took, pa.float64()), pa.array(steps, _STEPS)], names=_NAMES)


def run_trials(trials: DataFrame, responder: Responder, silence_samples: int, frame_size: int, most_steps: int) -> DataFrame:
    """Every trial of ``trials`` (trial_idx, seed, pcm, ...) through a responder.

    Returns trial_idx, seed, status, error, total_steps, wall_time_sec and steps
    (step, text_id, audio_tokens). Silence is appended, the last frame filled up, and no
    more than ``most_steps`` frames are fed; total_steps counts those fed. Status is completed, failed for whatever fails within a trial, or
    load_failed for a null waveform; it stops no other trial.
    """
    ship_by_value()
    one = lambda seed, pcm: _one(responder, seed, pcm, silence_samples, frame_size, most_steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), arrays(batch.column(2)), strict=True), one)

    return trials.select("trial_idx", "seed", F.col("pcm").cast("array<float>")).mapInArrow(run, _DONE)


def run_inputs(inputs: DataFrame, seeds: list[int], responder: Responder, silence_samples: int, frame_size: int, most_steps: int) -> DataFrame:
    """Every input of ``inputs`` (input_number from 1 up, pcm, ...) with every seed, as ``run_trials`` gives it.

    The trials of an input run where its waveform is, which is so read once and never copied. A waveform that is null
    fails all of its input's trials. trial_idx counts trials input by input, 1 and up.
    """
    ship_by_value()
    one = lambda seed, pcm: _one(responder, seed, pcm, silence_samples, frame_size, most_steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inputs_of = zip(batch.column(0).to_pylist(), arrays(batch.column(1)), strict=True)
            yield from _batches((((number - 1) * len(seeds) + k + 1, seed, pcm) for number, pcm in inputs_of for k, seed in enumerate(seeds)), one)

    return inputs.select(F.col("input_number").cast("long"), F.col("pcm").cast("array<float>")).mapInArrow(run, _DONE)


def run_summary(trials: DataFrame) -> DataFrame:
    """One row: total, completed and skipped trials of ``trials`` (status), and how many of the skipped ones had an input that couldn't be loaded."""
    of = lambda status: F.count_if(F.col("status") == status)
    counted = trials.agg(F.count(F.lit(1)).alias("total"), of("completed").alias("completed"), of("load_failed").alias("load_failed"))
    return counted.select("total", "completed", (F.col("total") - F.col("completed")).alias("skipped"), "load_failed")
