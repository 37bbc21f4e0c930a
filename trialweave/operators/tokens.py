"""A model's output tokens: which text tokens and which audio frames count.

Rows are (trial_id, step, ...), one for each step that gave output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ids of padding and of the end-of-padding mark.
SILENT_IDS = (0, 3)


def text_id(tokens: Column) -> Column:
    """The first row of a model's output is its text token."""
    return F.element_at(tokens, 1)


def audio_tokens(tokens: Column) -> Column:
    """The other rows are audio tokens."""
    return F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))


def is_text(token: Column, vocabulary: int) -> Column:
    """Whether a text token stands for a piece of text."""
    return ~token.isin(*SILENT_IDS) & (token >= 0) & (token < vocabulary)


def is_decodable(tokens: Column) -> Column:
    """Whether no audio token is negative; null tokens count as decodable, and so does an empty frame."""
    return F.coalesce(F.forall(tokens, lambda x: x >= 0), F.lit(True))


def with_pieces(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``tokens`` with the piece of their text_id from ``vocabulary`` (text_id, piece); null for unknown ids."""
    return tokens.join(vocabulary, "text_id", "left")


def first_steps(tokens: DataFrame) -> DataFrame:
    """For each trial: first_audio_step, first_response_step, n_text_tokens and n_outputs.

    ``tokens`` has decodable (boolean) and piece (null where there is no text). Firsts are null if there are none.
    """
    return tokens.groupBy("trial_id").agg(
        F.min(F.when(F.col("decodable"), F.col("step"))).alias("first_audio_step"),
        F.min(F.when(F.col("piece").isNotNull(), F.col("step"))).alias("first_response_step"),
        F.count("piece").alias("n_text_tokens"),
        F.count(F.lit(1)).alias("n_outputs"),
    )


def transcripts(tokens: DataFrame, trials: DataFrame | None = None) -> DataFrame:
    """trial_id and transcript: the pieces by step, one after another; empty if there are none.

    With ``trials`` (trial_id), each of these has one, even without any output.
    """
    if trials is not None:
        return trials.select("trial_id").distinct().join(transcripts(tokens), "trial_id", "left").select("trial_id", F.coalesce("transcript", F.lit("")).alias("transcript"))
    pieces = F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("step", "piece"))))
    return tokens.groupBy("trial_id").agg(F.array_join(F.transform(pieces, lambda x: x["piece"]), "").alias("transcript"))


def after_delay(tokens: DataFrame, delay: int) -> DataFrame:
    """The decodable frames of each trial but its first ``delay``, numbered by frame_idx.

    A trial with no more frames than that has none left.
    """
    order = Window.partitionBy("trial_id").orderBy("step")
    return tokens.where("decodable").withColumn("frame_idx", F.row_number().over(order) - 1 - delay).where("frame_idx >= 0")
