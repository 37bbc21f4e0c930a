"""From a trial's audio tokens to its waveform.

A decoder is a plug-in: a function from the tokens of consecutive frames, an array of (codebooks, frames), to
samples. A causal decoder is one that is called to begin a trial, and then with the tokens of one frame after another; what it
remembers of them is its own. A decoder that fails ends its trial, and no other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.functions.signal import duration
from trialweave.operators.tokens import is_decodable
from trialweave.session import ship_by_value, staged
from trialweave.sources.arrays import lists

Decoder = Callable[[np.ndarray], np.ndarray]
CausalDecoder = Callable[[], Decoder]

#: Samples of a row of sound.
BLOCK = 65_536


def level_decoder(frame_size: int) -> Decoder:
    """A deterministic stand-in for a codec: each frame becomes ``frame_size`` samples of one level, from its tokens."""
    return lambda tokens: np.repeat((7 * tokens[0] + tokens[1:].sum(axis=0)) % 50 / 50, frame_size)


def gliding_decoder(frame_size: int) -> CausalDecoder:
    """A causal stand-in: each frame glides from the level of the one before, 0 at first, to its own."""

    def begin() -> Decoder:
        level = [0.0]

        def step(tokens: np.ndarray) -> np.ndarray:
            before, level[0] = level[0], float((7 * tokens[0] + tokens[1:].sum()) % 50 / 50)
            return before + (level[0] - before) * np.arange(1, frame_size + 1) / frame_size

        return step

    return begin


def _frames(column: pa.ListArray) -> Iterator[np.ndarray | None]:
    """The frames of each row, (codebooks, frames), from a list of lists; none for a row without frames. Raises for the row where frames aren't of one length or hold nulls."""
    inner = column.values
    numbers, offsets = inner.values, inner.offsets.to_numpy()
    for valid, a, b in zip(column.is_valid().to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1], column.offsets.to_numpy()[1:], strict=True):
        if not valid or a == b:
            yield None
            continue
        held = numbers.slice(offsets[a], offsets[b] - offsets[a])
        sizes = np.diff(offsets[a : b + 1])
        yield ValueError("a frame holds a null token") if held.null_count else ValueError("frames are of several lengths") if (sizes != sizes[0]).any() else held.to_numpy().reshape(b - a, -1).T


def decoded_audio(trials: DataFrame, decoder: Decoder, delay: int, rate: int, most_sec: float | None = None) -> DataFrame:
    """trial_idx, status, error, pcm and output_audio_sec of ``trials`` (trial_idx, steps with audio_tokens).

    Frames with a negative token are left out, then the first ``delay`` of the others, and the rest is decoded
    in one piece and cut after ``most_sec`` seconds, if that is more than 0. A trial with no more
    frames than the delay has a null waveform and a duration of 0. Status is completed, or failed for whatever fails for a trial, which then has no waveform. Durations have four places, half to even.
    """
    ship_by_value()
    most = int(most_sec * rate) if most_sec and most_sec > 0 else None
    frames = F.transform(F.filter("steps", lambda x: is_decodable(x["audio_tokens"]) & (F.size(x["audio_tokens"]) > 0)), lambda x: x["audio_tokens"])

    def one(tokens: np.ndarray | ValueError | None) -> tuple[np.ndarray | None, str | None]:
        try:
            if isinstance(tokens, ValueError):
                raise tokens
            return (decoder(tokens).astype(np.float32)[:most] if tokens is not None else None), None
        except Exception as error:  # noqa: BLE001  a trial's failure is a result
            return None, str(error)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(tokens) for tokens in _frames(batch.column(1))]
            status = pa.array(["completed" if error is None else "failed" for _, error in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), status, pa.array([e for _, e in found], pa.string()), lists(pcm for pcm, _ in found)], names=["trial_idx", "status", "error", "pcm"])

    kept = F.slice(frames, delay + 1, F.greatest(F.size(frames) - delay, F.lit(0)))
    out = trials.select("trial_idx", kept.cast("array<array<int>>").alias("frames")).mapInArrow(run, "trial_idx long, status string, error string, pcm array<float>")
    seconds = F.when(F.col("pcm").isNotNull(), F.bround(duration(F.col("pcm"), rate), 4)).otherwise(0.0)
    return out.withColumn("output_audio_sec", seconds)


class _Trial:
    """One trial's decoding under way: its frames so far and the sound that isn't given out yet."""

    def __init__(self, trial_idx: int, decoder: CausalDecoder, delay: int, most: int | None) -> None:
        self.trial_idx, self.decoder, self.delay, self.most = trial_idx, decoder, delay, most
        self.seen, self.step, self.start, self.held, self.error = 0, None, 0, [], None

    def feed(self, tokens: pa.Array) -> None:
        """The next step; those that can't be decoded, come before the delay or after the cap, or follow a failure don't reach the decoder."""
        known = tokens.drop_null().to_numpy()
        if not len(tokens) or self.error is not None or (known < 0).any():
            return
        self.seen += 1
        room = None if self.most is None else self.most - self.start - sum(map(len, self.held))
        if self.seen <= self.delay or room == 0:
            return
        try:
            if tokens.null_count:
                raise ValueError("a frame holds a null token")
            if self.step is None:
                self.step = self.decoder()
            self.held.append(self.step(known).astype(np.float32)[:room])
        except Exception as error:  # noqa: BLE001  a trial's failure is a result
            self.error, self.held = str(error), []

    def sound(self, least: int) -> tuple[int, int, np.ndarray] | None:
        """The sound held, if there are ``least`` samples of it."""
        if not self.held or sum(map(len, self.held)) < least:
            return None
        pcm, at = np.concatenate(self.held), self.start
        self.start, self.held = at + len(pcm), []
        return self.trial_idx, at, pcm


def decoded_in_order(steps: DataFrame, decoder: CausalDecoder, delay: int, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Sound (trial_idx, start, pcm) in rows of about ``BLOCK`` samples, and a row (trial_idx, status, error, n_samples) for each trial, of ``steps`` (trial_idx, step, audio_tokens).

    Each trial's steps pass through one task in order, and the decoder's state with them from batch to batch, so a trial is never
    held whole. Which steps count is as in ``decoded_audio``; after ``most`` samples nothing is decoded any more. A trial whose decoder fails has no sound.
    """
    ship_by_value()

    def rows(sounds: list[tuple[int, int, np.ndarray]], ended: list[_Trial]) -> pa.RecordBatch:
        ids = pa.array([s[0] for s in sounds] + [t.trial_idx for t in ended], pa.int64())
        start = pa.array([s[1] for s in sounds] + [0 if t.error is not None else t.start for t in ended], pa.int64())
        status = pa.array([None] * len(sounds) + ["failed" if t.error is not None else "completed" for t in ended], pa.string())
        error = pa.array([None] * len(sounds) + [t.error for t in ended], pa.string())
        return pa.RecordBatch.from_arrays([ids, start, status, error, lists([s[2] for s in sounds] + [None] * len(ended))], names=["trial_idx", "start", "status", "error", "pcm"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trial = None
        for batch in batches:
            sounds, ended = [], []
            flat, offsets = batch.column(1).values, batch.column(1).offsets.to_numpy()
            valid = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            for k, trial_idx in enumerate(batch.column(0).to_pylist()):
                if trial is None or trial.trial_idx != trial_idx:
                    if trial is not None:
                        last = trial.sound(1)
                        sounds, ended = [*sounds, *([last] if last else [])], [*ended, trial]
                    trial = _Trial(trial_idx, decoder, delay, most)
                if valid[k]:
                    trial.feed(flat.slice(offsets[k], offsets[k + 1] - offsets[k]))
                if (found := trial.sound(BLOCK)) is not None:
                    sounds.append(found)
            yield rows(sounds, ended)
        if trial is not None:
            last = trial.sound(1)
            yield rows([last] if last else [], [trial])

    ordered = steps.select(F.col("trial_idx").cast("long"), "step", F.col("audio_tokens").cast("array<int>").alias("audio_tokens")).repartition("trial_idx").sortWithinPartitions("trial_idx", "step")
    found = staged(ordered.select("trial_idx", "audio_tokens").mapInArrow(run, "trial_idx long, start long, status string, error string, pcm array<float>"), "decoded")
    trials = found.where("status is not null").select("trial_idx", "status", "error", F.col("start").alias("n_samples"))
    return found.where("status is null").select("trial_idx", "start", "pcm").join(trials.where("status = 'failed'"), "trial_idx", "left_anti"), trials
