"""Decoding: order, state, caps, and failures that stay with their trial; models that are built once."""

import os
import pathlib
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.operators import decode, model
from trialweave.operators.decode import decoded_audio, decoded_in_order, gliding_decoder, level_decoder
from trialweave.operators.model import PerWorker, run_inputs

STEPS = "trial_idx long, step long, audio_tokens array<int>"


def sound_of(found):
    out = {}
    for r in found.orderBy("trial_idx", "start").collect():
        assert r["start"] == len(out.get(r["trial_idx"], []))
        out.setdefault(r["trial_idx"], []).extend(r["pcm"])
    return {k: [round(x, 6) for x in v] for k, v in out.items()}


def glide(frames, size):
    level, out = 0.0, []
    for tokens in frames:
        to = (7 * tokens[0] + sum(tokens[1:])) % 50 / 50
        out += [round(float(np.float32(level + (to - level) * (i + 1) / size)), 6) for i in range(size)]
        level = to
    return out


@pytest.mark.parametrize(("batch", "block"), [(1, 3), (7, 10), (10_000, 65_536)])
def test_state_is_carried_over_batches(spark, monkeypatch, batch, block):
    monkeypatch.setattr(decode, "BLOCK", block)
    rng = np.random.default_rng(1)
    trials = {t: [[int(x) for x in rng.integers(-1, 30, 3)] for _ in range(n)] for t, n in ((1, 40), (2, 1), (3, 0), (4, 3), (5, 25))}
    rows = [(t, k, tokens) for t, frames in trials.items() for k, tokens in enumerate(frames)] + [(5, 100, None), (5, 101, []), (6, 0, None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        sound, ended = decoded_in_order(spark.createDataFrame(rows, STEPS).repartition(5), gliding_decoder(4), 2)
        kept = {t: [f for f in frames if min(f) >= 0][2:] for t, frames in trials.items()}
        assert sound_of(sound) == {t: glide(frames, 4) for t, frames in kept.items() if frames}
        assert {r["trial_idx"]: (r["status"], r["n_samples"]) for r in ended.collect()} == {t: ("completed", 4 * len(kept.get(t, []))) for t in (1, 2, 4, 5, 6)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def careful(most):
    """A decoder that must not be asked for more frames than it needs."""

    def begin():
        left = [most]

        def step(tokens):
            left[0] -= 1
            if left[0] < 0:
                raise AssertionError("asked beyond the cap")
            return np.full(4, tokens[0] / 50)

        return step

    return begin


def test_the_cap_comes_before_decoding(spark):
    rows = [(1, k, [k, 0]) for k in range(20)]
    sound, ended = decoded_in_order(spark.createDataFrame(rows, STEPS), careful(3), 1, most=10)
    assert [len(v) for v in sound_of(sound).values()] == [10]
    assert [r["status"] for r in ended.collect()] == ["completed"]


def breaking():
    """A decoder that travels by value, as it isn't a name of this module."""

    def breaks(tokens):
        if (tokens == 13).any():
            raise ValueError("thirteen")
        return np.zeros(4 * (tokens.shape[1] if tokens.ndim > 1 else 1))

    return breaks


ODD = [(1, [[1, 2], [3, 4]]), (2, [[1, 2], [13, 4]]), (3, [[1, None], [3, 4]]), (4, [[1], [3, 4]]), (5, []), (6, None), (7, [[-1, 2]]), (8, [[5, 5]])]


def test_a_decoder_that_fails_fails_its_trial_only(spark):
    trials = spark.createDataFrame([(t, None if f is None else [(x,) for x in f]) for t, f in ODD], "trial_idx long, steps array<struct<audio_tokens:array<int>>>").coalesce(1)
    found = {r["trial_idx"]: (r["status"], r["error"], None if r["pcm"] is None else len(r["pcm"])) for r in decoded_audio(trials, breaking(), 0, 24000).collect()}
    assert found == {1: ("completed", None, 8), 2: ("failed", "thirteen", None), 3: ("failed", "a frame holds a null token", None), 4: ("failed", "frames are of several lengths", None), **{t: ("completed", None, None) for t in (5, 6, 7)}, 8: ("completed", None, 4)}


def test_a_causal_decoder_that_fails_leaves_no_sound(spark, monkeypatch):
    monkeypatch.setattr(decode, "BLOCK", 2)  # so that some had been given out before
    breaks = breaking()
    rows = [(t, k, f) for t, frames in ODD if t != 4 for k, f in enumerate(frames or [])]
    sound, ended = decoded_in_order(spark.createDataFrame(rows, STEPS), lambda: breaks, 0)
    assert {k: len(v) for k, v in sound_of(sound).items()} == {1: 8, 8: 4}
    assert {r["trial_idx"]: (r["status"], r["error"], r["n_samples"]) for r in ended.collect()} == {1: ("completed", None, 8), 2: ("failed", "thirteen", 0), 3: ("failed", "a frame holds a null token", 0), 7: ("completed", None, 0), 8: ("completed", None, 4)}


def test_a_model_is_built_once_in_a_worker(spark):
    folder = tempfile.mkdtemp(prefix="spark-")

    def build():
        pathlib.Path(folder, f"{os.getpid()}-{os.urandom(4).hex()}").touch()
        return model.echo_responder

    inputs = spark.createDataFrame([(k, [0.5] * 30) for k in range(1, 41)], "input_number long, pcm array<float>").repartition(20)
    plain = run_inputs(inputs, [0, 1], model.echo_responder, 5, 10, 99)
    once = PerWorker(build)
    for _ in range(2):
        found = run_inputs(inputs, [0, 1], once, 5, 10, 99)
        assert sorted(map(str, found.drop("wall_time_sec").collect())) == sorted(map(str, plain.drop("wall_time_sec").collect()))
    pids = [p.name.split("-")[0] for p in pathlib.Path(folder).iterdir()]
    assert len(pids) == len(set(pids))


def test_a_model_that_cannot_be_built_fails_its_trials(spark):
    def build():
        raise OSError("no weights")

    found = run_inputs(spark.createDataFrame([(1, [0.5] * 30), (2, None)], "input_number long, pcm array<float>"), [0], PerWorker(build), 5, 10, 99)
    assert sorted((r["trial_idx"], r["status"], r["error"]) for r in found.collect()) == [(1, "failed", "no weights"), (2, "load_failed", "no waveform")]


def test_outputs_leave_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(model, "OUTPUTS", 25)
    trials = ((k, 0, np.full(80, 0.5, np.float32)) for k in range(30))
    sizes = [sum(len(s) for s in b.column(6).to_pylist()) for b in model._batches(trials, lambda seed, pcm: model._one(model.echo_responder, seed, pcm, 0, 10, 99))]
    assert sum(sizes) == 30 * 7
    assert max(sizes) <= 25 + 7


def test_level_decoder_as_a_causal_one(spark):
    rows = [(1, k, [k % 5, k]) for k in range(9)]
    sound, _ = decoded_in_order(spark.createDataFrame(rows, STEPS), lambda: level_decoder(6), 2)
    whole = decoded_audio(spark.createDataFrame([(1, [(x,) for _, _, x in rows])], "trial_idx long, steps array<struct<audio_tokens:array<int>>>"), level_decoder(6), 2, 24000)
    assert sound_of(sound) == {1: [round(x, 6) for x in whole.select(F.explode("pcm")).toPandas()["col"]]}
