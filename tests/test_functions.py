import io
import math
import wave

import numpy as np
import pytest
from support import rows_of
from pyspark.sql import functions as F

from trialweave.functions import signal
from trialweave.functions.numbering import numbered
from trialweave.functions.text import clock, or_default, prompt_stem, stem_of, strip, timeline_line, without_suffix
from trialweave.operators import metrics, timeline, tokens
from trialweave.operators.grid import chosen_seeds, last_written, parsed_seeds, trial_grid, with_sidecars
from trialweave.operators.decode import decoded_audio, level_decoder
from trialweave.operators.model import echo_responder, run_inputs, run_summary, run_trials
from trialweave.plans.config import ExperimentConfig, first_given
from trialweave.sources.prompts import file_prompts, inline_prompts, union_prompts, whole_prompt
from trialweave.sources.wav import decoded, encoded, wav_files
from trialweave.streaming.live import live_answers, live_first_steps


def evaluated(spark, column, value, kind):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text", ["", "  ", "　a b　", "\x1c\x1fx\x85", "​ x", "a\n", "﻿q", "  z "])
def test_strip_like_python(spark, text):
    assert evaluated(spark, strip, text, "string") == text.strip()


@pytest.mark.parametrize(
    ("text", "want"),
    [("", "text_007"), ("  ", "text_007"), ("a  b\tc", "text_007_a_b_c"), ('<>:"/\\|?*\x01', "text_007"), ("..x..", "text_007_x"), ("a" * 39 + " b", "text_007_" + "a" * 39), ("x" * 60, "text_007_" + "x" * 40), ("\U0001f600" * 41, "text_007_" + "\U0001f600" * 40)],
)
def test_prompt_stem(spark, text, want):
    assert evaluated(spark, lambda x: prompt_stem(x, F.lit(7)), text, "string") == want


@pytest.mark.parametrize(("seconds", "want"), [(None, "--:--.---"), (0.0, "00:00.000"), (59.9996, "00:60.000"), (61.5, "01:01.500"), (0.0625, "00:00.062"), (3600.0, "60:00.000")])
def test_clock(spark, seconds, want):
    assert evaluated(spark, clock, seconds, "double") == want


def test_timeline_line_pads_and_never_cuts(spark):
    line = lambda s, e, t: spark.range(1).select(timeline_line(F.lit("00:00.000"), F.lit(s), F.lit(e), F.lit(t)).alias("y")).first()["y"]
    assert line("user", "speech_end", "") == "[00:00.000] user  speech_end  "
    assert line("assistant", "text_output", "hi") == "[00:00.000] assistant text_output  hi"


def test_paths_and_defaults(spark):
    assert evaluated(spark, stem_of, "a/b.c/x.tar.wav", "string") == "x.tar"
    assert evaluated(spark, stem_of, "a/.hidden", "string") == ".hidden"
    assert evaluated(spark, without_suffix, "a.b/x.wav", "string") == "a.b/x"
    assert evaluated(spark, lambda x: or_default(x, F.lit("d")), "", "string") == "d"
    assert evaluated(spark, lambda x: or_default(x, F.lit("d")), None, "string") == "d"


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 25])
def test_frames_concatenate_to_the_padded_input(spark, n):
    pcm = [float(i) for i in range(n)]
    frames = evaluated(spark, lambda x: signal.frames(x, 10), pcm, "array<float>")
    flat = [x for f in frames for x in f]
    assert all(len(f) == 10 for f in frames)
    assert flat[:n] == pcm
    assert not any(flat[n:])
    assert len(frames) == math.ceil(n / 10)


@pytest.mark.parametrize(("n", "speed"), [(0, 1.25), (1, 2.0), (2, 1.25), (64, 1.25), (64, 0.5), (7, 100.0), (10, 1.0)])
def test_speed_like_interpolation(spark, n, speed):
    pcm = np.random.default_rng(n).normal(size=n).astype(np.float32)
    found = evaluated(spark, lambda x: signal.at_speed(x, speed), pcm.tolist(), "array<float>")
    if n < 2 or speed == 1:
        want = pcm
    else:
        m = max(1, round(n / speed))
        want = np.interp(np.linspace(0, 1, m), np.linspace(0, 1, n), pcm)
    np.testing.assert_allclose(found, want, atol=1e-6)


def test_speed_must_be_positive():
    with pytest.raises(ValueError):
        signal.at_speed(None, 0)


def test_levels(spark):
    assert evaluated(spark, signal.peak, [], "array<float>") == 0.0
    assert evaluated(spark, signal.normalised, [0.5, -0.25], "array<float>") == [0.5, -0.25]
    assert evaluated(spark, signal.normalised, [2.0, -4.0], "array<float>") == [0.5, -1.0]
    assert evaluated(spark, signal.downmix, [[1.0, 2.0], [3.0, 6.0]], "array<array<float>>") == [2.0, 4.0]
    assert evaluated(spark, signal.downmix, [[1.0]], "array<array<float>>") == [1.0]
    assert evaluated(spark, lambda x: signal.silence(x, F.lit(0.29), F.lit(100)), [1.0], "array<float>") == [1.0] + [0.0] * 28
    assert evaluated(spark, lambda x: signal.capped(x, 0.0, 10), [1.0, 2.0], "array<float>") == [1.0, 2.0]
    assert evaluated(spark, lambda x: signal.capped(x, 0.15, 10), [1.0, 2.0], "array<float>") == [1.0]
    assert [evaluated(spark, signal.synthesis_rate, r, "int") for r in (0, 199, 221, 1000)] == [-10, 0, 1, 10]


def test_seeds(spark):
    assert evaluated(spark, parsed_seeds, " 3,, -1 , ", "string") == [3, -1]
    assert evaluated(spark, parsed_seeds, "", "string") == []
    pick = lambda s, n: spark.createDataFrame([(s, n)], "s string, n int").select(chosen_seeds(F.col("s"), F.col("n")).alias("y")).first()["y"]
    assert pick("", 5) == []
    assert pick(None, 3) == [0, 1, 2]
    assert pick(None, 0) == []
    assert pick(None, -2) == []
    assert pick(None, None) == [0]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        pick("1,x", None)
    assert ExperimentConfig(seeds="4, 5,").seed_list() == [4, 5]
    assert ExperimentConfig(num_trials=2).seed_list() == [0, 1]
    assert ExperimentConfig().frame_size == 1920


def test_grid_keeps_repeated_names_apart(spark):
    inputs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "input_number bigint, input_stem string")
    grid = trial_grid(inputs, [7, 7])
    assert sorted(r[0] for r in rows_of(grid, ["trial_idx"])) == [1, 2, 3, 4, 5, 6]
    assert shown_set(last_written(grid), "input_stem", "trial_idx") == {("a", 4), ("b", 6)}


def shown_set(df, *columns):
    return set(rows_of(df, list(columns)))


def test_sidecars(spark):
    inputs = spark.createDataFrame([("p/a",), ("p/b",), ("p/c",)], "path_no_ext string")
    side = spark.createDataFrame([("p/a", " hi\n"), ("p/b", " 　 ")], "path_no_ext string, text string")
    assert shown_set(with_sidecars(inputs, side), "path_no_ext", "prompt_text") == {("p/a", "hi"), ("p/b", None), ("p/c", None)}


def test_prompts(spark, tmp_path):
    path = tmp_path / "prompts.txt"
    path.write_text("  one \n\n　\ntwo\r\n", encoding="utf-8")
    found = union_prompts(texts=inline_prompts(spark, ["", "x"]), file=file_prompts(spark, f"file://{path}"), stdin=whole_prompt(spark, " a\nb "))
    assert sorted(rows_of(found, ["prompt_idx", "source", "text"])) == [(1, "texts", ""), (2, "texts", "x"), (3, "file", "one"), (4, "file", "two"), (5, "stdin", "a\nb")]
    assert whole_prompt(spark, " \n").count() == 0


def test_numbered(spark):
    found = numbered(spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("k")), "n", "k")
    assert all(k + 1 == n for k, n in rows_of(found, ["k", "n"]))
    assert numbered(spark.range(0), "n", "id").count() == 0


def test_wav_files(spark, tmp_path):
    with wave.open(str(tmp_path / "b.wav"), "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(16000)
        f.writeframes(np.array([[16384, 0], [-16384, 16384]], "<i2").tobytes())
    (tmp_path / "a.wav").write_bytes(b"not a wave")
    (tmp_path / "c.txt").write_text("x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.wav").write_bytes(b"")
    found = {r["path"].rpartition("/")[2]: r for r in decoded(wav_files(spark, f"file://{tmp_path}")).collect()}
    assert set(found) == {"a.wav", "b.wav"}
    assert found["a.wav"]["pcm"] is None
    assert found["a.wav"]["duration_sec"] == 0.0
    assert found["b.wav"]["pcm"] == [0.25, 0.0]
    assert found["b.wav"]["sample_rate"] == 16000
    made = encoded(spark.createDataFrame([("x", [0.5, 2.0]), ("y", []), ("z", None)], "path string, pcm array<float>"), 24000)
    content = {r["path"]: r["content"] for r in made.collect()}
    assert content["z"] is None
    with wave.open(io.BytesIO(content["x"])) as f:
        assert np.frombuffer(f.readframes(9), "<i2").tolist() == [16384, 32767]


def test_tokens(spark):
    frame = spark.createDataFrame([(0, [1, -2]), (1, []), (2, [0, None]), (3, None), (4, [-1, None])], "k int, a array<int>")
    assert dict(rows_of(frame.select("k", tokens.is_decodable(F.col("a")).alias("d")), ["k", "d"])) == {0: False, 1: True, 2: True, 3: True, 4: False}
    rows = spark.createDataFrame([(1, 0, False, None), (1, 5, True, " b"), (1, 3, True, "a"), (2, 0, False, None)], "trial_id int, step int, decodable boolean, piece string")
    assert shown_set(tokens.first_steps(rows), "trial_id", "first_audio_step", "first_response_step", "n_text_tokens", "n_outputs") == {(1, 3, 3, 2, 3), (2, None, None, 0, 1)}
    assert shown_set(tokens.transcripts(rows), "trial_id", "transcript") == {(1, "a b"), (2, "")}
    assert tokens.after_delay(rows, 2).count() == 0
    assert shown_set(tokens.after_delay(rows, 1), "trial_id", "step", "frame_idx") == {(1, 5, 0)}


def test_worked_example(spark):
    """2.56 s of input at 12.5 Hz, first audio and text at step 18, delay 2."""
    trial = spark.createDataFrame([(18, 18, 2.56)], "first_audio_step long, first_response_step long, duration_sec double")
    row = metrics.latencies(trial, 12.5, 2).first()
    assert (row["input_end_step"], row["audible_response_start_step"]) == (32, 20)
    assert row["first_audio_time_sec"] == row["first_response_latency_sec"] == 1.44
    assert row["audible_response_start_sec"] == 1.6
    assert row["audible_start_after_input_sec"] == pytest.approx(-0.96)
    plan = signal.step_plan(F.lit(61440), 15.0, 60.0, 24000, 12.5)
    assert spark.range(1).select(*(c.alias(n) for n, c in plan.items())).first().asDict() == {"input_steps": 32, "total_frames": 220, "max_steps": 750, "n_steps": 220}


def test_timeline_order(spark):
    schema = "trial_id int, input_name string, prompt_text string, duration_sec double, transcript string, first_response_latency_sec double, audible_response_start_sec double"
    trials = spark.createDataFrame([(1, "a.wav", None, 0.0, "  ", 0.0, None), (2, "b.wav", "hi", 2.0, " yes ", None, 1.0), (3, "c.wav", "", 1.0, "", None, None)], schema)
    found = {}
    for row in timeline.ranked(timeline.events(trials)).orderBy("trial_id", "position").collect():
        found.setdefault(row["trial_id"], []).append((row["speaker"], row["event"], row["text"]))
    assert found[1] == [("assistant", "text_output", "(empty)"), ("user", "speech_end", ""), ("user", "speech_start", "(audio input: a.wav)")]
    assert found[2] == [("user", "speech_start", "hi"), ("assistant", "speech_start", "(audio starts)"), ("user", "speech_end", ""), ("assistant", "text_output", "yes")]
    assert [e[1] for e in found[3]] == ["speech_start", "speech_end"]


def test_runs_isolate_failures_and_ignore_partitions(spark):
    trials = spark.createDataFrame([(k, k % 3, [0.1 * k] * 15 if k % 4 else None) for k in range(12)], "trial_idx long, seed long, pcm array<float>")
    run = lambda n: sorted(map(str, rows_of(run_trials(trials.repartition(n), echo_responder, 5, 4, 4).drop("wall_time_sec"))))
    found = run(1)
    assert found == run(5)
    status = rows_of(run_trials(trials, echo_responder, 5, 4, 4), ["trial_idx", "status", "total_steps"])
    assert {s for k, s, _ in status if k % 4 == 0} == {"load_failed"}
    assert {(s, n) for k, s, n in status if k % 4} == {("completed", 4)}

    def broken(seed):
        def step(frame):
            raise RuntimeError(f"seed {seed}")

        return step

    errors = rows_of(run_trials(trials, broken, 5, 4, 4), ["trial_idx", "status", "error"])
    assert all(s == ("failed" if k % 4 else "load_failed") for k, s, _ in errors)
    assert ("seed 1") in {e for _, _, e in errors}


def test_wav_of_all_widths_and_a_long_clip(spark, tmp_path):
    """75 seconds at 24 kHz and short ones, stereo and mono, through every width; what isn't known has no samples."""
    rng = np.random.default_rng(2)
    long = rng.uniform(-1, 1, 75 * 24000).astype(np.float32)
    rows = spark.createDataFrame([("long", long.tolist()), ("short", [0.5, -1.0, 1.5, 0.0, 1e-3]), ("empty", []), ("none", None)], "path string, pcm array<float>")
    for bits, floats in ((8, False), (16, False), (24, False), (32, False), (32, True), (64, True)):
        found = {r["path"]: r for r in decoded(encoded(rows, 24000, bits, floats)).collect()}
        step = 0 if floats else 2.0 ** (1 - bits)
        np.testing.assert_allclose(found["long"]["pcm"], long, atol=step + 1e-7)
        assert found["long"]["duration_sec"] == 75.0
        np.testing.assert_allclose(found["short"]["pcm"], [0.5, -1.0, 1.5 if floats else 1 - step, 0.0, 1e-3], atol=step / 2 + 1e-7)
        assert (found["empty"]["pcm"], found["empty"]["duration_sec"]) == ([], 0.0)
        assert (found["none"]["pcm"], found["none"]["duration_sec"]) == (None, 0.0)
    with wave.open(str(tmp_path / "stereo.wav"), "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(3)
        f.setframerate(8000)
        f.writeframes(b"\0\0\x40\0\0\xc0" * 10 + b"\0")
    (tmp_path / "law.wav").write_bytes(b"RIFF\0\0\0\0WAVEfmt \x10\0\0\0\x07\0\x01\0\x40\x1f\0\0\x40\x1f\0\0\x01\0\x08\0data\x02\0\0\0ab")
    found = {r["path"].rpartition("/")[2]: r for r in decoded(wav_files(spark, f"file://{tmp_path}")).collect()}
    assert found["stereo.wav"]["pcm"] == [0.0] * 10
    assert found["stereo.wav"]["duration_sec"] == 10 / 8000
    assert found["law.wav"]["pcm"] is None


def test_runs_by_input_are_runs_by_trial(spark):
    rows = [(k, [k / 10, -k / 7, 0.3] * k if k % 4 else None) for k in range(1, 12)]
    inputs = spark.createDataFrame(rows, "input_number long, pcm array<float>").repartition(3)
    trials = trial_grid(inputs, [5, 9])
    shown = lambda df: sorted(map(str, rows_of(df.drop("wall_time_sec"))))
    assert shown(run_inputs(inputs, [5, 9], echo_responder, 5, 4, 6)) == shown(run_trials(trials, echo_responder, 5, 4, 6))
    summary = run_summary(run_inputs(inputs, [5, 9], echo_responder, 5, 4, 6)).first()
    assert tuple(summary) == (22, 18, 4, 4)
    assert run_inputs(inputs.limit(0), [5], echo_responder, 5, 4, 6).count() == 0


def test_decoded_audio(spark):
    """Bad frames go first, then the delay; no more frames than that leave none; nulls and nothing."""
    step = lambda k, *tokens: (k, 1, list(tokens))
    rows = [(1, [step(k, k, 1) for k in range(5)]), (2, [step(0, 1, 1), step(1, -1, 1), step(2, 3, 4), step(3, 2, 0)]), (3, [step(0, 1, 1), step(1, 1, 2)]), (4, []), (5, None)]
    trials = spark.createDataFrame(rows, "trial_idx long, steps array<struct<step:int,text_id:int,audio_tokens:array<int>>>")
    found = {r["trial_idx"]: r for r in decoded_audio(trials, level_decoder(2), 2, 100, 0.055).collect()}
    np.testing.assert_allclose(found[1]["pcm"], [0.3, 0.3, 0.44, 0.44, 0.58], rtol=1e-6)
    assert found[1]["output_audio_sec"] == 0.05
    np.testing.assert_allclose(found[2]["pcm"], [0.28, 0.28], rtol=1e-6)
    assert all((found[k]["pcm"], found[k]["output_audio_sec"]) == (None, 0.0) for k in (3, 4, 5))


def test_transcripts_of_trials_without_output(spark):
    tokens_ = spark.createDataFrame([(1, 0, "a"), (1, 1, None), (2, 0, None)], "trial_id long, step long, piece string")
    found = rows_of(tokens.transcripts(tokens_, spark.createDataFrame([(1,), (2,), (3,)], "trial_id long")), ["trial_id", "transcript"])
    assert sorted(found) == [(1, "a"), (2, ""), (3, "")]


def test_numbers_by_key_and_options_by_name(spark):
    rows = spark.createDataFrame([(k, f"text {k}", 10 - k % 3) for k in range(20)], "id long, text string, rank int").repartition(4)
    plain = rows_of(numbered(rows, "n", "rank", "id"), ["id", "text", "n"])
    assert sorted(plain) == sorted(rows_of(numbered(rows, "n", "rank", "id", key="id"), ["id", "text", "n"]))
    options = spark.createDataFrame([(None, 2.0), (1.0, 2.0), (None, None)], "temp double, temperature double")
    assert [r[0] for r in options.select(first_given("temp", "temperature", default=F.lit(0.5))).collect()] == [2.0, 1.0, 0.5]


def test_streamed_state_lasts_from_batch_to_batch(spark, tmp_path):
    """Several files in order, with a neighbour that isn't one of them."""
    day = lambda k: f"2024-01-01 00:00:{k:02d}"
    rows = [(k, day(k), k % 3, "x", f'{{"k": {k}}}') for k in range(30)] + [(30, day(30), 0, "x", None)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, props string").withColumn("ts", F.to_timestamp_ntz("ts"))
    for k in range(3):
        events.where(f"event_id >= {k * 11} and event_id < {k * 11 + 11}").coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    events.write.parquet(str(tmp_path / "events-old"))
    found = sorted(rows_of(live_answers(spark, str(tmp_path / "events"), 5), ["trial_id", "step", "text_id"]))
    want = []
    for trial in range(3):
        heard = 0
        for step, k in enumerate(k for k, _, user, _, _ in rows if user == trial):
            heard += k if k < 30 else 0
            want.append((trial, step, (heard + 5) % 97))
    assert found == sorted(want)
    firsts = {r["trial_id"]: r["n_outputs"] for r in live_first_steps(spark, str(tmp_path / "events"), 80).collect()}
    assert firsts == {0: 11, 1: 10, 2: 10}
