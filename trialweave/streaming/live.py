"""What a trial has come to while its steps still arrive: firsts and counts as running aggregates, and a step function with state of its own."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trialweave.operators.tokens import is_text
from trialweave.session import shared_dir, ship_by_value

#: Keys over which a stream deals its trials where Python holds their state: a call for each key costs milliseconds, whatever its rows.
BUCKETS = 1024


def running_firsts(events: DataFrame, vocabulary: int) -> DataFrame:
    """For each trial of a stream of events (ts, user_id, event_type, props): its firsts so far, by time, and counts.

    The aggregates are the state: one row for each trial, whatever order events come in.
    """
    text = is_text(F.get_json_object("props", "$.k").cast("int"), vocabulary)
    return events.groupBy(F.col("user_id").alias("trial_id")).agg(
        F.min(F.when(F.col("event_type") != "error", F.col("ts"))).alias("first_audio_ts"),
        F.min(F.when(text, F.col("ts"))).alias("first_response_ts"),
        F.count_if(text).alias("n_text_tokens"),
        F.count(F.lit(1)).alias("n_outputs"),
    )


def _opened(spark: SparkSession, path: str, files_at_once: int) -> DataFrame:
    """The files of a folder, or one file, as a stream."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    one_file = there.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(there).isFile()
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_at_once)
    folder, _, name = path.rstrip("/").rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder) if one_file else reader.parquet(path)


def _run_out(stream: DataFrame, mode: str) -> DataFrame:
    """All rows that a stream gives until its files are read, with the ``batch`` they came in.

    Each micro-batch replaces what an earlier try at it wrote, and the query can be restarted from its checkpoint.
    """
    base = f"{shared_dir(stream.sparkSession)}/trialweave/live-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{base}/rows")


def live_first_steps(spark: SparkSession, path: str, vocabulary: int, files_at_once: int = 1) -> DataFrame:
    """What ``running_firsts`` has reached when all files of ``path`` (a folder or one file) are read, a few at a time.

    Each micro-batch gives the trials that it changed; a trial's last row counts.
    """
    changes = _run_out(running_firsts(_opened(spark, path, files_at_once), vocabulary), "update")
    columns = ("first_audio_ts", "first_response_ts", "n_text_tokens", "n_outputs")
    last = changes.groupBy("trial_id").agg(F.max_by(F.struct(*columns), "batch").alias("x")).select("trial_id", "x.*")
    shown = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c.replace("_ts", "_micros"))
    return last.select("trial_id", shown("first_audio_ts"), shown("first_response_ts"), "n_text_tokens", "n_outputs")


def live_answers(spark: SparkSession, path: str, seed: int, files_at_once: int = 1) -> DataFrame:
    """trial_id, step and text_id: a responder's answer to each event of a stream, as soon as it has come.

    The responder sums what its trial has heard so far and answers from the sum and the seed. Its
    state, the sum and the number of steps, lives from micro-batch to micro-batch; within one, events are taken in order of time.
    Trials are dealt over ``BUCKETS`` keys, and those of a key are answered together.
    """
    ship_by_value()

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, sums, steps = (np.array(x, np.int64) for x in (state.get if state.exists else ([], [], [])))
        rows = pd.concat(parts)
        rows = rows.iloc[np.lexsort((rows["event_id"], rows["ts"], rows["user_id"]))]
        trials, first, of, n = np.unique(rows["user_id"].to_numpy(np.int64), return_index=True, return_inverse=True, return_counts=True)
        every = np.union1d(known, trials)
        before = np.zeros((2, len(every)), np.int64)
        before[:, np.searchsorted(every, known)] = sums, steps
        here = np.searchsorted(every, trials)
        heard = rows["heard"].to_numpy(np.int64)
        running = np.cumsum(heard)
        sums = running - (running - heard)[first][of] + before[0, here][of]
        steps = np.arange(len(rows)) - first[of] + before[1, here][of]
        before[0, here], before[1, here] = sums[first + n - 1], steps[first + n - 1] + 1
        state.update((every.tolist(), *before.tolist()))
        yield pd.DataFrame({"trial_id": trials[of], "step": steps, "text_id": (sums + seed) % 97})

    heard = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0).cast("long"))
    bucket = F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)).alias("bucket")
    events = _opened(spark, path, files_at_once).where("user_id is not null").select(bucket, "user_id", "ts", "event_id", heard.alias("heard"))
    answers = events.groupBy("bucket").applyInPandasWithState(step, "trial_id long, step long, text_id long", "trials array<long>, heard array<long>, steps array<long>", "append", GroupStateTimeout.NoTimeout)
    return _run_out(answers, "append").drop("batch")


def live_windows(spark: SparkSession, path: str, vocabulary: int, frame: str, delay: str, files_at_once: int = 1) -> DataFrame:
    """trial_id, frame (its begin in microseconds), n_outputs and n_text_tokens of each frame of event time in which a trial has events.

    A frame is final, and given once, when event time has passed its end by ``delay``. An event that comes later
    than that is dropped: its frame stays as it was.
    """
    events = _opened(spark, path, files_at_once).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    text = is_text(F.get_json_object("props", "$.k").cast("int"), vocabulary)
    frames = events.groupBy(F.col("user_id").alias("trial_id"), F.window("ts", frame).alias("w")).agg(F.count(F.lit(1)).alias("n_outputs"), F.count_if(text).alias("n_text_tokens"))
    return _run_out(frames.select("trial_id", F.unix_micros("w.start").alias("frame"), "n_outputs", "n_text_tokens"), "append").drop("batch")
