"""Waveforms as arrays of floats: mixing down, scaling, framing, timing.

Everything here is an expression over one row's array, which suits clips of up
to some ten thousand samples.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def silence(pcm: Column, seconds: Column, rate: Column) -> Column:
    """``pcm`` followed by whole samples of silence."""
    return F.concat(pcm, F.array_repeat(F.lit(0.0).cast("float"), (seconds * rate).cast("int")))


def downmix(channels: Column) -> Column:
    """The mean over channels of each sample; ``channels`` is an array of waveforms of one length."""
    total = F.aggregate(
        F.slice(channels, 2, F.greatest(F.size(channels) - 1, F.lit(0))),
        F.transform(F.element_at(channels, 1), lambda x: x.cast("double")),
        lambda a, b: F.zip_with(a, b, lambda x, y: x + y.cast("double")),
    )
    return F.transform(total, lambda x: (x / F.size(channels)).cast("float"))


def peak(pcm: Column) -> Column:
    """The greatest magnitude; 0 for an empty waveform."""
    return F.coalesce(F.array_max(F.transform(pcm, F.abs)), F.lit(0.0).cast("float"))


def normalised(pcm: Column) -> Column:
    """``pcm`` scaled to a peak of 1 if its peak is above 1."""
    return F.get(F.transform(F.array(peak(pcm)), lambda p: F.when(p > 1, F.transform(pcm, lambda x: (x / p).cast("float"))).otherwise(pcm)), F.lit(0))


def frames(pcm: Column, size: int) -> Column:
    """Frames of ``size`` samples, the last filled up with silence; none for an empty waveform."""
    n = F.ceil(F.size(pcm) / size).cast("int")

    def frame(i: Column) -> Column:
        own = F.slice(pcm, i * size + 1, F.lit(size))
        return F.concat(own, F.array_repeat(F.lit(0.0).cast("float"), size - F.size(own)))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), frame)).otherwise(F.array().cast("array<array<float>>"))


def at_speed(pcm: Column, speed: float) -> Column:
    """``pcm`` resampled by linear interpolation to play ``speed`` times as fast."""
    if speed <= 0:
        raise ValueError("speed must be greater than 0")
    if abs(speed - 1.0) < 1e-6:
        return pcm
    n = F.size(pcm)
    length = F.greatest(F.lit(1), F.rint(n / F.lit(speed)).cast("int"))

    def sample(i: Column) -> Column:
        at = i * (n - 1).cast("double") / F.greatest(length - 1, F.lit(1))
        low = F.least(F.floor(at).cast("int"), n - 2)
        a, b = F.get(pcm, low).cast("double"), F.get(pcm, low + 1).cast("double")
        return (a + (b - a) * (at - low)).cast("float")

    return F.when(pcm.isNull() | (n < 2), pcm).otherwise(F.transform(F.sequence(F.lit(0), length - 1), sample))


def capped(pcm: Column, seconds: float | None, rate: int) -> Column:
    """The first ``seconds``; all of it for none, zero or less."""
    return F.slice(pcm, 1, int(seconds * rate)) if seconds and seconds > 0 else pcm


def duration(pcm: Column, rate: int) -> Column:
    return F.size(pcm) / F.lit(float(rate))


def step_plan(samples: Column, silence_sec: float, most_sec: float, rate: int, frame_rate: float) -> dict[str, Column]:
    """Numbers of frames: input_steps, total_frames, max_steps and n_steps."""
    size = int(rate / frame_rate)
    up = lambda n: F.floor((n + size - 1) / size).cast("long")
    most, total = F.lit(int(most_sec * frame_rate)).cast("long"), up(samples + int(silence_sec * rate))
    return {"input_steps": up(samples), "total_frames": total, "max_steps": most, "n_steps": F.least(total, most)}


def synthesis_rate(words_per_minute: Column) -> Column:
    """A speaking rate on the scale from -10 to 10 that some speech synthesizers use."""
    return F.greatest(F.lit(-10), F.least(F.lit(10), ((words_per_minute - 200) / 20).cast("int")))
