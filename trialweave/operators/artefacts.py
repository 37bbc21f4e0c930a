"""What a trial leaves behind: its files by name, and which trial's file stays where several have one name."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.session import ship_by_value

#: File names.
AUDIO, STEPS, TRANSCRIPT, EVENTS, TIMELINE, META = "response.wav", "transcript.jsonl", "transcript.txt", "conversation_timeline.jsonl", "conversation_timeline.txt", "meta.json"
WRITTEN = (STEPS, TRANSCRIPT, EVENTS, TIMELINE, META)


def artefacts(trials: DataFrame, audible: Column) -> DataFrame:
    """``trials`` with an ``artefact`` each: every trial writes its texts, and its audio only if it has any."""
    names = F.concat(F.array(*map(F.lit, WRITTEN)), F.when(audible, F.array(F.lit(AUDIO))).otherwise(F.array().cast("array<string>")))
    return trials.withColumn("artefact", F.explode(names))


def last_artefacts(written: DataFrame) -> DataFrame:
    """input_stem, seed, artefact and trial_idx: for each file name the last of the trials that wrote it.

    ``written`` has these columns. Trials with one (input_stem, seed) share a folder, in order of trial_idx; what an earlier one
    wrote there and a later one doesn't, survives.
    """
    return written.groupBy("input_stem", "seed", "artefact").agg(F.max("trial_idx").alias("trial_idx"))


def trial_path(artefact: Column) -> Column:
    """Where a trial's file is, below the folder of the run."""
    return F.concat(F.col("input_stem"), F.lit("/seed_"), F.col("seed").cast("string"), F.lit("/"), artefact)


def _lines(rows: list[dict]) -> str:
    return "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows)


def _content(row: dict) -> str:
    if row["artefact"] == STEPS:
        return _lines(row["events"])
    if row["artefact"] == TRANSCRIPT:
        return "".join(e["piece"] for e in row["events"])
    if row["artefact"] == EVENTS:
        return _lines(row["timeline"])
    if row["artefact"] == TIMELINE:
        return row["rendered"] + "\n"
    return json.dumps(row["meta"], indent=2, ensure_ascii=False)


def text_files(trials: DataFrame) -> DataFrame:
    """path and content of each trial's texts, of ``trials`` (input_stem, seed, artefact, events, timeline, rendered, meta).

    ``events`` (step, time_sec, piece) and ``timeline`` become lines of JSON, none for an empty array; the transcript is the pieces,
    one after another, without a newline at its end; ``rendered`` gets one; ``meta`` is an indented record. Fields keep their order.
    """
    ship_by_value()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_content(r).encode() for r in rows], pa.binary())], names=["path", "content"])

    return trials.select(trial_path(F.col("artefact")).alias("path"), "artefact", "events", "timeline", "rendered", "meta").mapInArrow(run, "path string, content binary")
