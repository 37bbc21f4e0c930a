"""The conversation timeline of a trial: up to four events in order of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialweave.functions.text import clock, or_default, strip, timeline_line

#: The responder's name; it sorts before "user", so at equal times an answer comes first.
RESPONDER, USER = "assistant", "user"


def events(trials: DataFrame) -> DataFrame:
    """trial_id, time_sec, time, speaker, event and text of each event.

    ``trials`` has trial_id, input_name, prompt_text, duration_sec, transcript,
    first_response_latency_sec and audible_response_start_sec. All events of a trial come from its one row.
    """
    said = strip(F.coalesce("transcript", F.lit("")))
    latency, audible = F.col("first_response_latency_sec"), F.col("audible_response_start_sec")
    prompt = or_default(F.col("prompt_text"), F.concat(F.lit("(audio input: "), F.col("input_name"), F.lit(")")))

    def event(time, speaker, kind, text):
        return F.struct(time.cast("double").alias("time_sec"), F.lit(speaker).alias("speaker"), F.lit(kind).alias("event"), text.alias("text"))

    found = F.array(
        event(F.lit(0.0), USER, "speech_start", prompt),
        event(F.col("duration_sec"), USER, "speech_end", F.lit("")),
        F.when(audible.isNotNull(), event(audible, RESPONDER, "speech_start", F.lit("(audio starts)"))),
        F.when(latency.isNotNull() | (said != ""), event(latency, RESPONDER, "text_output", or_default(said, F.lit("(empty)")))),
    )
    rows = trials.select("trial_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("e")).select("trial_id", "e.*")
    return rows.withColumn("time", clock(F.col("time_sec")))


def ranked(rows: DataFrame) -> DataFrame:
    """``events`` with position: 1 and up by time (unknown last), speaker and event."""
    order = Window.partitionBy("trial_id").orderBy(F.col("time_sec").asc_nulls_last(), "speaker", "event")
    return rows.withColumn("position", F.row_number().over(order).cast("long"))


def rendered(positioned: DataFrame) -> DataFrame:
    """trial_id and timeline: a headline and a line for each event."""
    line = timeline_line(F.col("time"), F.col("speaker"), F.col("event"), F.col("text"))
    lines = F.array_sort(F.collect_list(F.struct("position", line.alias("line"))))
    joined = F.array_join(F.concat(F.array(F.lit("Conversation timeline:")), F.transform(lines, lambda x: x["line"])), "\n")
    return positioned.groupBy("trial_id").agg(joined.alias("timeline"))
