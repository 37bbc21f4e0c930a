"""Files written by a commit, and WAV files read by range."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from support import rows_of

from trialweave.operators.artefacts import AUDIO, META, STEPS, artefacts, last_artefacts, text_files
from trialweave.sources import wavscan
from trialweave.sources.trees import read_tree, write_tree
from trialweave.sources.wav import decoded, encoded, wav_files
from trialweave.sources.wavscan import wav_blocks, wav_headers

FILES = "path string, content binary"


def tree(path):
    return {str(p.relative_to(path)): p.read_bytes() for p in path.rglob("*") if p.is_file()}


def test_files_have_exact_names_and_replace_only_their_own(spark, tmp_path):
    rows = spark.createDataFrame([(f"in {k}/seed_0/x.txt", str(k).encode()) for k in range(20)] + [("é/empty.jsonl", b""), ("é/none.wav", None)], FILES)
    write_tree(rows.repartition(4), f"file://{tmp_path}/out")
    want = {f"in {k}/seed_0/x.txt": str(k).encode() for k in range(20)} | {"é/empty.jsonl": b""}
    assert tree(tmp_path / "out") == want
    write_tree(spark.createDataFrame([("in 3/seed_0/x.txt", b"new"), ("in 3/seed_1/x.txt", b"")], FILES), f"file://{tmp_path}/out")
    want |= {"in 3/seed_0/x.txt": b"new", "in 3/seed_1/x.txt": b""}
    assert tree(tmp_path / "out") == want
    assert {r["path"]: bytes(r["content"]) for r in read_tree(spark, f"file://{tmp_path}/out").collect()} == want
    write_tree(rows.limit(0), str(tmp_path / "nothing"))
    assert tree(tmp_path / "nothing") == {}


@pytest.mark.parametrize("bad", ["/etc/x", "../x", "a/../../x", "", "a//b"])
def test_paths_out_of_the_folder_are_refused(spark, tmp_path, bad):
    with pytest.raises(Exception, match="no path below a folder"):
        write_tree(spark.createDataFrame([("fine", b"1"), (bad, b"2")], FILES), str(tmp_path / "out"))
    assert tree(tmp_path) == {}


def test_a_failed_job_leaves_nothing_and_changes_nothing(spark, tmp_path):
    write_tree(spark.createDataFrame([("a", b"old")], FILES), str(tmp_path))
    rows = spark.range(40).repartition(8).select(F.when(F.col("id") == 0, "a").otherwise(F.col("id").cast("string")).alias("path"), F.when(F.col("id") == 17, F.raise_error(F.lit("broke off"))).otherwise(F.lit("new")).cast("binary").alias("content"))
    with pytest.raises(Exception, match="broke off"):
        write_tree(rows, str(tmp_path))
    assert tree(tmp_path) == {"a": b"old"}
    assert not (tmp_path / "_temporary").exists()


def test_audio_of_an_earlier_trial_survives(spark):
    trials = spark.createDataFrame([("a", 0, 1, True), ("a", 0, 5, False), ("a", 1, 2, False), ("b", 0, 3, True), ("b", 0, 4, True)], "input_stem string, seed long, trial_idx long, audible boolean")
    found = {(r["input_stem"], r["seed"], r["artefact"]): r["trial_idx"] for r in last_artefacts(artefacts(trials, F.col("audible"))).collect()}
    assert (found["a", 0, AUDIO], found["a", 0, META], found["b", 0, AUDIO], found["b", 0, STEPS]) == (1, 5, 4, 4)
    assert ("a", 1, AUDIO) not in found


def test_texts_of_a_trial_without_events(spark):
    rows = spark.createDataFrame([("a", 0, a, [], [{"time_sec": None, "text": 'say "é"\n'}], "shown", {"x": None}) for a in ("transcript.jsonl", "transcript.txt", "conversation_timeline.jsonl", "conversation_timeline.txt", "meta.json")], "input_stem string, seed long, artefact string, events array<struct<step:long,time_sec:double,piece:string>>, timeline array<struct<time_sec:double,text:string>>, rendered string, meta struct<x:long>")
    found = {r["path"].rpartition("/")[2]: bytes(r["content"]).decode() for r in text_files(rows).collect()}
    assert found == {"transcript.jsonl": "", "transcript.txt": "", "conversation_timeline.jsonl": '{"time_sec": null, "text": "say \\"é\\"\\n"}\n', "conversation_timeline.txt": "shown\n", "meta.json": '{\n  "x": null\n}'}


def odd_files(spark, folder):
    rng = np.random.default_rng(1)
    for k, (bits, floats) in enumerate(((8, False), (16, False), (24, False), (32, False), (32, True), (64, True))):
        rows = spark.createDataFrame([(f"w{k}", rng.uniform(-1, 1, 1000 + k).tolist())], "path string, pcm array<float>")
        (folder / f"w{k}.wav").write_bytes(bytes(encoded(rows, 16000, bits, floats).first()["content"]))
    good = (folder / "w1.wav").read_bytes()
    (folder / "cut.wav").write_bytes(good[:301])
    (folder / "head.wav").write_bytes(good[:40])
    (folder / "none.wav").write_bytes(b"")
    (folder / "text.wav").write_bytes(b"RIFF and no more")
    (folder / "wide.wav").write_bytes(good[:36] + b"LIST" + struct.pack("<I", 3) + b"abc\0" + good[36:])
    (folder / "empty.wav").write_bytes(good[:40] + struct.pack("<I", 0))
    stereo = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 0, b"WAVE", b"fmt ", 16, 1, 2, 8000, 32000, 4, 16, b"data", 80) + np.arange(40, dtype="<i2").tobytes()
    (folder / "stereo.wav").write_bytes(stereo)
    (folder / "note.txt").write_bytes(b"no sound")
    (folder / "deep").mkdir()
    (folder / "deep" / "x.wav").write_bytes(good)


@pytest.mark.parametrize(("samples", "split"), [(7, 64), (100, 300), (4096, 1 << 20)])
def test_ranges_of_files_give_what_whole_files_give(spark, tmp_path, samples, split):
    odd_files(spark, tmp_path)
    name = F.regexp_extract("path", "[^/]+$", 0)
    want = {r["name"]: r for r in decoded(wav_files(spark, str(tmp_path))).withColumn("name", name).collect()}
    want["none.wav"] = {"sample_rate": None, "duration_sec": 0.0, "pcm": None}  # Spark's reader leaves empty files out
    heads = {r["name"]: r for r in wav_headers(spark, f"file://{tmp_path}", split=split).withColumn("name", name).collect()}
    assert {k: (r["sample_rate"], r["duration_sec"]) for k, r in heads.items()} == {k: (r["sample_rate"], r["duration_sec"]) for k, r in want.items()}
    parts = {}
    for r in wav_blocks(spark, str(tmp_path), samples, split).withColumn("name", name).orderBy("name", "block").collect():
        parts.setdefault(r["name"], []).append(r)
    assert set(parts) == set(want)
    for k, rows in parts.items():
        assert [r["block"] for r in rows] == list(range(len(rows)))
        if want[k]["pcm"] is None:
            assert [r["pcm"] for r in rows] == [None]
        else:
            assert all(len(r["pcm"]) == samples for r in rows[:-1])
            assert [x for r in rows for x in r["pcm"]] == list(want[k]["pcm"])


def test_headers_of_folders_in_folders(spark, tmp_path):
    odd_files(spark, tmp_path)
    assert wav_headers(spark, str(tmp_path), deep=True).where(F.col("path").endswith("/deep/x.wav")).count() == 1
    assert rows_of(wav_headers(spark, str(tmp_path / "stereo.wav")), ["channels", "bits", "n_samples"]) == [(2, 16, 20)]


def test_tasks_do_not_grow_with_the_number_of_small_files(tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    for k in range(300):
        (tmp_path / f"{k:03d}.wav").write_bytes(struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 0, b"WAVE", b"fmt ", 16, 1, 1, 8000, 16000, 2, 16, b"data", 40) + rng.integers(-99, 99, 20).astype("<i2").tobytes())
    monkeypatch.setattr(wavscan, "TASKS", 5)
    for pcm in (True, False):
        reader = wavscan.WavReader(str(tmp_path), False, pcm, 10, 20_000)
        shares = reader.partitions()
        assert len(shares) <= 6
        batches = [list(reader.read(x)) for x in shares]
        assert all(len(x) == 1 for x in batches)
        assert sum(x[0].num_rows for x in batches) == (600 if pcm else 300)


def test_ranges_of_one_file_stay_apart_in_different_tasks(tmp_path):
    (tmp_path / "x.wav").write_bytes(struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 0, b"WAVE", b"fmt ", 16, 1, 1, 8000, 16000, 2, 16, b"data", 400_000) + bytes(400_000))
    reader = wavscan.WavReader(str(tmp_path), False, True, 1000, 100_000)
    assert [x.ranges for x in reader.partitions()] == [[(str(tmp_path / "x.wav"), a, min(a + 100_000, 400_044))] for a in range(0, 400_044, 100_000)]
    assert [b for x in reader.partitions() for batch in reader.read(x) for b in batch.column(6).to_pylist()] == list(range(200))
