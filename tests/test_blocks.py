"""Waveforms in blocks give what whole waveforms give, at every size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.functions import signal
from trialweave.operators import blocks
from trialweave.sources import wav


@pytest.fixture(scope="module")
def clips(spark):
    rng = np.random.default_rng(4)
    rows = [(k, (rng.uniform(-1, 1, n) * (3 if k % 2 else 0.5)).astype(np.float32).tolist()) for k, n in enumerate([0, 1, 2, 3, 9, 10, 11, 64, 100, 333, 1000])]
    return spark.createDataFrame([*rows, (99, None)], "clip_id long, pcm array<float>").repartition(3)


def shown(df):
    return {r[0]: [round(float(x), 6) for x in r[1]] for r in df.collect() if r[1]}


@pytest.mark.parametrize("size", [1, 64])
def test_blocks_equal_whole_clips(clips, size, monkeypatch):
    monkeypatch.setattr(blocks, "STRETCH", 50)
    cut = blocks.in_blocks(clips, size)
    assert shown(blocks.joined(cut)) == shown(clips)
    assert {r["clip_id"]: (r["n"], round(r["peak"], 6)) for r in blocks.facts(cut).collect()} == {r[0]: (len(r[1]), round(max(map(abs, r[1]), default=0.0), 6)) for r in clips.collect() if r[1] is not None}
    assert shown(blocks.joined(blocks.normalised(cut))) == shown(clips.select("clip_id", signal.normalised(F.col("pcm"))))
    assert shown(blocks.joined(blocks.capped(cut, 50))) == shown(clips.select("clip_id", F.slice("pcm", 1, 50)))
    for speed in (0.4, 1.25, 1.0):
        assert shown(blocks.joined(blocks.at_speed(cut, speed, size))) == shown(clips.select("clip_id", signal.at_speed(F.col("pcm"), speed)))
    for rate, target in ((16000, 24000), (22050, 24000)):
        whole = wav.resampled(clips.select(F.col("clip_id").cast("string").alias("path"), F.lit(rate).alias("sample_rate"), "pcm"), target)
        assert shown(blocks.joined(blocks.resampled(cut, rate, target, size))) == shown(whole.select(F.col("path").cast("long"), "pcm"))


@pytest.mark.parametrize(("size", "silence", "most", "at_once"), [(1, 0, None, 1), (7, 23, None, 2), (64, 500, 3, 5)])
def test_frames_of_blocks_equal_those_of_whole_clips(clips, size, silence, most, at_once):
    quiet = F.concat(F.col("pcm"), F.array_repeat(F.lit(0.0).cast("float"), silence))
    whole = clips.where("pcm is not null").select("clip_id", F.posexplode(signal.frames(quiet, 10)).alias("step", "frame"))
    want = sorted((r["clip_id"], r["step"], r["frame"]) for r in whole.collect() if most is None or r["step"] < most)
    got = blocks.framed(blocks.in_blocks(clips, size), 10, silence, most, at_once)
    assert sorted((r["clip_id"], r["step"], r["frame"]) for r in got.collect()) == want


def test_no_clips(clips):
    none = blocks.in_blocks(clips.limit(0), 8)
    assert blocks.at_speed(none, 2.0, 8).count() == blocks.framed(none, 10).count() == blocks.normalised(none).count() == 0
    with pytest.raises(ValueError, match="greater than 0"):
        blocks.at_speed(none, 0.0)
