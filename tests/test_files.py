import json

import numpy as np
import pytest
from support import rows_of

from trialweave.sources.files import input_files, sidecar_files, write_lines, write_records
from trialweave.sources.wav import resampled


def test_input_files(spark, tmp_path):
    for name in ("b.wav", "a.wav", "note.txt", "x.flac"):
        (tmp_path / name).write_bytes(b"  hi\n")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "c.wav").write_bytes(b"")
    found = input_files(spark, [str(tmp_path / "x.flac"), str(tmp_path / "missing"), str(tmp_path), str(tmp_path / "a.wav")])
    assert [r[1] for r in sorted(rows_of(found, ["input_idx", "input_stem"]))] == ["x", "a", "b", "a"]
    assert input_files(spark, [str(tmp_path / "missing")]).count() == 0
    side = rows_of(sidecar_files(spark, str(tmp_path)), ["path_no_ext", "text"])
    assert [(p.rpartition("/")[2], t) for p, t in side] == [("note", "hi")]


def test_results_by_input_and_seed(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 2, "second"), ("a", 1, 1, "first"), ("b", 1, 1, "é")], "input_stem string, seed long, position long, line string")
    write_lines(rows, str(tmp_path / "lines"))
    write_lines(rows.where("input_stem = 'b'").withColumn("line", rows["seed"].cast("string")), str(tmp_path / "lines"))
    text = lambda stem: "".join(p.read_text() for p in (tmp_path / "lines" / f"input_stem={stem}" / "seed=1").glob("part-*"))
    assert text("a") == "first\nsecond\n"
    assert text("b") == "1\n"
    write_records(spark.createDataFrame([("a", 1, None, 2.5)], "input_stem string, seed long, first_audio_step long, duration double"), str(tmp_path / "meta"))
    (part,) = (tmp_path / "meta" / "input_stem=a" / "seed=1").glob("part-*")
    assert json.loads(part.read_text()) == {"first_audio_step": None, "duration": 2.5}


@pytest.mark.parametrize(("rate", "target"), [(16000, 24000), (48000, 24000), (22050, 24000)])
def test_resampling_keeps_a_tone(spark, rate, target):
    tone = lambda r, n: np.sin(2 * np.pi * 440 * np.arange(n) / r)
    rows = spark.createDataFrame([("x", rate, tone(rate, rate // 10).tolist()), ("y", rate, []), ("z", None, None), ("same", target, [0.5])], "path string, sample_rate int, pcm array<float>")
    found = {r["path"]: r for r in resampled(rows, target).collect()}
    pcm = np.array(found["x"]["pcm"])
    assert len(pcm) == target // 10
    np.testing.assert_allclose(pcm[200:-200], tone(target, len(pcm))[200:-200], atol=5e-3)
    assert found["y"]["pcm"] == []
    assert found["z"]["pcm"] is None
    assert found["same"]["pcm"] == [0.5]


def test_staged_tables_can_be_discarded(spark):
    from pathlib import Path

    from trialweave.session import discard, staged

    table = staged(spark.range(10), "kept")
    folder = Path(table.inputFiles()[0].removeprefix("file://")).parent
    assert table.count() == 10
    discard(table)
    assert not folder.exists()
    assert folder.parent.exists()
