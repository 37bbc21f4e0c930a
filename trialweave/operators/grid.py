"""Which trials an experiment has: seeds, inputs by seeds, and which of several with one name counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.functions.text import strip


def parsed_seeds(text: Column) -> Column:
    """The numbers of a comma-separated list; blank fields are dropped, others must be whole numbers."""
    return F.transform(F.filter(F.split(text, ","), lambda x: strip(x) != ""), lambda x: strip(x).cast("bigint"))


def chosen_seeds(seeds: Column, num_trials: Column) -> Column:
    """The listed seeds, even if there are none in the list; else 0 to ``num_trials`` - 1; else 0."""
    counted = F.when(num_trials > 0, F.sequence(F.lit(0).cast("bigint"), F.greatest(num_trials.cast("bigint") - 1, F.lit(0)))).otherwise(F.array().cast("array<bigint>"))
    return F.when(seeds.isNotNull(), parsed_seeds(seeds)).when(num_trials.isNotNull(), counted).otherwise(F.array(F.lit(0).cast("bigint")))


def seed_table(spark: SparkSession, seeds: list[int]) -> DataFrame:
    """seed_idx and seed; repeated seeds are trials of their own."""
    return spark.createDataFrame(list(enumerate(seeds)), "seed_idx bigint, seed bigint")


def trial_grid(inputs: DataFrame, seeds: list[int], input_number: str = "input_number") -> DataFrame:
    """Every input with every seed, and ``trial_idx``: 1 and up, input by input.

    ``inputs`` has its running number, 1 and up, in ``input_number``. The seeds are the experiment's
    configuration, a list on the driver, so they go to every task.
    """
    paired = inputs.crossJoin(F.broadcast(seed_table(inputs.sparkSession, seeds)))
    return paired.withColumn("trial_idx", (F.col(input_number) - 1) * len(seeds) + F.col("seed_idx") + 1)


def last_written(trials: DataFrame) -> DataFrame:
    """Of trials with one (input_stem, seed), whose files replace each other, the last by trial_idx."""
    latest = trials.groupBy("input_stem", "seed").agg(F.max("trial_idx").alias("trial_idx"))
    return trials.join(latest, ["input_stem", "seed", "trial_idx"])


def with_sidecars(inputs: DataFrame, sidecars: DataFrame) -> DataFrame:
    """``inputs`` with prompt_text: the stripped text under the same path without suffix, null if blank or missing."""
    texts = sidecars.select("path_no_ext", F.nullif(strip(F.col("text")), F.lit("")).alias("prompt_text"))
    return inputs.join(texts, "path_no_ext", "left")
