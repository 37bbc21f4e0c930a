"""Waveforms in blocks, for clips of any length.

A clip is rows (clip_id, start, pcm): consecutive samples from ``start`` on. What depends on neighbours gets
the edge samples that it needs from the blocks around, so no task ever holds a clip. Facts of a
clip are joined by clip and stretch, so that a long clip isn't one key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.functions import signal
from trialweave.session import ship_by_value
from trialweave.sources.arrays import arrays, lists
from trialweave.sources.wav import kernel

#: Samples of a block, and of a stretch that meets one copy of its clip's facts.
SIZE, STRETCH = 65_536, 1 << 24


def in_blocks(clips: DataFrame, size: int = SIZE) -> DataFrame:
    """``clips`` (clip_id, pcm) in blocks of ``size`` samples; an empty clip has one empty block, and a null one none."""
    last = F.greatest(F.ceil(F.size("pcm") / size).cast("int") - 1, F.lit(0))
    rows = clips.where(F.col("pcm").isNotNull()).select("clip_id", "pcm", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    return rows.select("clip_id", (F.col("k") * size).cast("long").alias("start"), F.slice("pcm", F.col("k") * size + 1, F.lit(size)).alias("pcm"))


def facts(blocks: DataFrame) -> DataFrame:
    """clip_id, n and peak: a clip's length and greatest magnitude. Tasks send a row for each clip, and no samples."""
    found = blocks.groupBy("clip_id").agg(F.max(F.col("start") + F.size("pcm")).alias("n"), F.max(signal.peak(F.col("pcm"))).alias("peak"))
    return found.withColumn("n", F.col("n").cast("long"))


def with_facts(blocks: DataFrame) -> DataFrame:
    """``blocks`` with n and peak of their clip."""
    stretches = F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("n") - 1, F.lit(0)) / STRETCH))
    known = facts(blocks).withColumn("stretch", F.explode(stretches))
    return blocks.withColumn("stretch", F.floor(F.col("start") / STRETCH)).join(known, ["clip_id", "stretch"]).drop("stretch")


def normalised(blocks: DataFrame) -> DataFrame:
    """Clips scaled to a peak of 1 if theirs is above 1: one pass for the peaks, one to scale."""
    scaled = F.when(F.col("peak") > 1, F.transform("pcm", lambda x: (x / F.col("peak")).cast("float"))).otherwise(F.col("pcm"))
    return with_facts(blocks).select("clip_id", "start", scaled.alias("pcm"))


def dealt(blocks: DataFrame, size: int, length: Column, ratio: Column, before: int, after: int) -> DataFrame:
    """clip_id, block, n, length, at and pcm: what each output block of ``size`` samples is made of.

    An output of ``length`` samples (of n and peak) has ``ratio`` input samples for each of its own. Block j gets the input
    from floor(j * size * ratio) - before to ceil((j + 1) * size * ratio) + after, as far as there is any, and ``at`` is the place of the first sample. Each
    input block is cut where output blocks begin; only samples near a cut are sent twice.
    """
    known = with_facts(blocks).withColumns({"length": length.cast("long"), "ratio": ratio.cast("double")})
    span, last = F.col("ratio") * size, F.ceil(F.col("length") / size) - 1
    start, end = F.col("start"), F.col("start") + F.size("pcm")
    low, high = F.greatest(F.floor((start - after) / span) - 1, F.lit(0)), F.least(F.floor((end + before) / span) + 1, last)
    rows = known.where((F.size("pcm") > 0) & (low <= high)).withColumn("block", F.explode(F.sequence(low, high)))
    first, stop = F.greatest(F.floor(F.col("block") * span) - before, start), F.least(F.ceil((F.col("block") + 1) * span) + after, end)
    pieces = rows.where(first < stop).select("clip_id", "block", "n", "length", first.alias("at"), F.slice("pcm", (first - start + 1).cast("int"), (stop - first).cast("int")).alias("pcm"))
    # Every block of the output has a row, even one made of silence.
    every = facts(blocks).withColumn("length", length.cast("long")).where("length > 0")
    every = every.select("clip_id", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("length") / size) - 1)).alias("block"), "n", "length", F.lit(None).cast("long").alias("at"), F.array().cast("array<float>").alias("pcm"))
    found = pieces.unionByName(every).groupBy("clip_id", "block", "n", "length").agg(F.min("at").alias("at"), F.array_sort(F.collect_list(F.struct("at", "pcm"))).alias("parts"))
    return found.select("clip_id", "block", "n", "length", F.coalesce("at", F.lit(0)).alias("at"), F.flatten("parts.pcm").alias("pcm"))


def _made(rows: DataFrame, size: int, make: Callable[[np.ndarray, int, int, int, int, int], np.ndarray]) -> DataFrame:
    """clip_id, start and pcm of the output blocks of ``dealt``: ``make`` gets samples, their place, n, length, and the first and the end of the output."""
    ship_by_value()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = zip(*(c.to_pylist() for c in batch.columns[1:5]), strict=True)
            found = [make(pcm, at, n, length, k * size, min((k + 1) * size, length)) for (k, n, length, at), pcm in zip(numbers, arrays(batch.column(5)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k * size for k in batch.column(1).to_pylist()], pa.int64()), lists(found)], names=["clip_id", "start", "pcm"])

    return rows.select("clip_id", "block", "n", "length", "at", "pcm").mapInArrow(run, "clip_id long, start long, pcm array<float>")


def at_speed(blocks: DataFrame, speed: float, size: int = SIZE) -> DataFrame:
    """Clips resampled by linear interpolation to play ``speed`` times as fast; those of one sample or none stay."""
    if speed <= 0:
        raise ValueError("speed must be greater than 0")
    if abs(speed - 1.0) < 1e-6:
        return blocks
    n = F.col("n")
    length = F.when(n < 2, n).otherwise(F.greatest(F.lit(1), F.rint(n / F.lit(speed))))
    ratio = F.when(n < 2, 1.0).otherwise((n - 1) / F.greatest(length - 1, F.lit(1)))

    def make(pcm: np.ndarray, at: int, n: int, length: int, first: int, end: int) -> np.ndarray:
        if n < 2:
            return pcm
        place = np.arange(first, end) * np.float64(n - 1) / max(length - 1, 1)
        low = np.minimum(np.floor(place).astype(np.int64), n - 2)
        a, b = pcm[low - at].astype(np.float64), pcm[low + 1 - at].astype(np.float64)
        return (a + (b - a) * (place - low)).astype(np.float32)

    return _made(dealt(blocks, size, length, ratio, 2, 3), size, make)


def resampled(blocks: DataFrame, rate: int, target: int, size: int = SIZE) -> DataFrame:
    """Clips of ``rate`` at ``target``, by the windowed sinc of ``sources.wav.kernel``."""
    if rate == target:
        return blocks
    filters, old, new, reach = kernel(rate, target)
    size = -(-size // new) * new  # blocks begin with the first phase

    def make(pcm: np.ndarray, at: int, n: int, length: int, first: int, end: int) -> np.ndarray:
        steps = -(-(end - first) // new)
        begin = first // new * old - reach
        held = np.zeros((steps - 1) * old + filters.shape[1])
        a, b = max(at, begin), min(at + len(pcm), begin + len(held))
        held[a - begin : b - begin] = pcm[a - at : b - at]
        return (np.lib.stride_tricks.sliding_window_view(held, filters.shape[1])[::old] @ filters.T).reshape(-1)[: end - first].astype(np.float32)

    return _made(dealt(blocks, size, F.ceil(F.col("n") * new / old), F.lit(old / new), reach + 1, reach + old + 1), size, make)


def framed(blocks: DataFrame, frame: int, silence: int = 0, most: int | None = None, at_once: int = 64) -> DataFrame:
    """clip_id, step and frame: frames of ``frame`` samples of clips with ``silence`` samples after them.

    The last one is filled up; no more than ``most`` frames are made of a clip. ``at_once`` of them are made from one row.
    """
    size = frame * at_once
    total = F.col("n") + silence
    length = F.ceil(total / frame) * frame if most is None else F.least(F.ceil(total / frame), F.lit(most)) * frame
    rows = dealt(blocks, size, length, F.lit(1.0), 0, 0)
    own = F.least(F.lit(size), F.col("length") - F.col("block") * size)
    held = F.slice("pcm", 1, own.cast("int"))
    filled = F.concat(held, F.array_repeat(F.lit(0.0).cast("float"), (own - F.size(held)).cast("int")))
    found = rows.select("clip_id", "block", filled.alias("pcm")).select("clip_id", "block", F.posexplode(signal.frames(F.col("pcm"), frame)).alias("k", "frame"))
    return found.select("clip_id", (F.col("block") * at_once + F.col("k")).alias("step"), "frame")


def capped(blocks: DataFrame, samples: int) -> DataFrame:
    """The first ``samples`` of each clip; blocks after them go, but for a clip's first."""
    left = (F.lit(samples) - F.col("start")).cast("int")
    return blocks.where((F.col("start") < samples) | (F.col("start") == 0)).withColumn("pcm", F.slice("pcm", 1, F.greatest(left, F.lit(0))))


def joined(blocks: DataFrame) -> DataFrame:
    """clip_id and pcm: clips in one piece, where they are short enough for that."""
    parts = F.array_sort(F.collect_list(F.struct("start", "pcm")))
    return blocks.groupBy("clip_id").agg(parts.alias("parts")).select("clip_id", F.flatten("parts.pcm").alias("pcm"))
