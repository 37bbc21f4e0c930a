"""Derived times of a trial."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def step_time(step: Column, frame_rate: float) -> Column:
    """Seconds of a step, to four places, half to even."""
    return F.bround(step / F.lit(frame_rate), 4)


def end_step(duration: Column, frame_rate: float) -> Column:
    """The step nearest to the input's end, half to even."""
    return F.rint(duration * frame_rate).cast("long")


def latencies(trials: DataFrame, frame_rate: float, delay: int) -> DataFrame:
    """``trials`` (first_audio_step, first_response_step, duration_sec) with their latency columns.

    A missing first step leaves what follows from it null. A negative
    audible_start_after_input_sec means that the answer began over the input.
    """
    audible = F.col("first_audio_step") + delay
    return trials.withColumns({
        "first_response_latency_sec": F.col("first_response_step") / F.lit(frame_rate),
        "first_audio_time_sec": F.col("first_audio_step") / F.lit(frame_rate),
        "audible_response_start_step": audible,
        "audible_response_start_sec": audible / F.lit(frame_rate),
        "input_end_step": end_step(F.col("duration_sec"), frame_rate),
        "audible_start_after_input_sec": audible / F.lit(frame_rate) - F.col("duration_sec"),
    })


def or_nan(value: Column) -> Column:
    """An option that wasn't given is NaN, which is no null."""
    return F.coalesce(value, F.lit(float("nan")))


def precision_label(half: Column) -> Column:
    return F.when(half, "float16").otherwise("bfloat16")
