"""The given tables in the shape of an experiment's inputs and outputs.

There are no recordings among the tables, so events stand for a model's steps, documents for inputs
and prompts, and embeddings for short waveforms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialweave.functions.text import piece_text, strip
from trialweave.operators.tokens import is_text
from trialweave.plans.config import ExperimentConfig

CONFIG = ExperimentConfig()
VOCABULARY = 80
SEEDS = [0, 1, 2]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's steps: trial_id, step, ts, text_id, decodable, raw_piece and piece (null where there is no text)."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    text_id = F.get_json_object("props", "$.k").cast("int")
    raw = F.concat(F.lit("▁"), F.col("event_type"))
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("trial_id"), (F.row_number().over(order) - 1).cast("long").alias("step"), "ts", text_id.alias("text_id"), (F.col("event_type") != "error").alias("decodable"), raw.alias("raw_piece")
    )
    return rows.withColumn("piece", F.when(is_text(F.col("text_id"), VOCABULARY), piece_text(F.col("raw_piece"))))


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs: input_idx, input_stem, input_name, samples, duration_sec and prompt_text (only for labelled documents; stripped, null if blank)."""
    labelled = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("labelled", F.lit(True))
    docs = table(spark, sf_dir, "documents").join(labelled, "doc_id", "left")
    stem, samples = F.concat_ws("_", "lang", "source"), F.col("n_chars") * 160
    return docs.select(
        F.col("doc_id").alias("input_idx"), stem.alias("input_stem"), F.concat(stem, F.lit(".wav")).alias("input_name"), samples.alias("samples"),
        (samples / F.lit(float(CONFIG.sample_rate))).alias("duration_sec"), F.when(F.col("labelled"), F.nullif(strip(F.col("text")), F.lit(""))).alias("prompt_text"),
    )


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short waveforms: clip_id and pcm."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip_id"), F.col("embedding").alias("pcm"))
