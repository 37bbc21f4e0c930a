"""Text prompts from several places, in one order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.functions.numbering import numbered
from trialweave.functions.text import strip


def inline_prompts(spark: SparkSession, texts: list[str]) -> DataFrame:
    """pos and text of given texts, as they are: blank ones too."""
    return spark.createDataFrame(list(enumerate(texts)), "pos bigint, text string")


def line_prompts(lines: DataFrame) -> DataFrame:
    """``lines`` (pos, text), stripped and without blank ones."""
    return lines.select("pos", strip(F.col("text")).alias("text")).where("text <> ''")


def file_prompts(spark: SparkSession, path: str) -> DataFrame:
    """The lines of one UTF-8 file; it is read whole, since lines in parts have no order."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("pos", "text"))
    return line_prompts(rows.select(F.col("pos").cast("long").alias("pos"), "text"))


def whole_prompt(spark: SparkSession, text: str) -> DataFrame:
    """One prompt of all of a text, or none if it is blank."""
    return line_prompts(inline_prompts(spark, [text]))


def union_prompts(**parts: DataFrame) -> DataFrame:
    """prompt_idx, source and text of all ``parts`` (pos, text), one after another; repeated texts stay."""
    rows = None
    for rank, (source, part) in enumerate(parts.items()):
        own = part.select(F.lit(rank).alias("rank"), F.lit(source).alias("source"), "pos", "text")
        rows = own if rows is None else rows.unionByName(own)
    return numbered(rows, "prompt_idx", "rank", "pos").select("prompt_idx", "source", "text")
