"""Files of an experiment: which inputs there are, and results as files by input and seed."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.functions.numbering import numbered
from trialweave.functions.text import stem_of, strip, without_suffix

logger = logging.getLogger(__name__)


def input_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """input_idx, path, input_stem and path_no_ext of the inputs under ``paths``.

    A folder stands for its own WAV files in order of path, not for those of
    folders in it; a file is taken whatever its suffix; what is missing is skipped with
    a warning. Paths keep their order, and one given twice counts twice. Spark lists no files of no bytes.
    """
    hadoop, given = spark._jsc.hadoopConfiguration(), []
    for pos, path in enumerate(paths):
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = there.getFileSystem(hadoop)
        if files.exists(there):
            given.append((pos, files.makeQualified(there).toString(), files.getFileStatus(there).isDirectory()))
        else:
            logger.warning("No such input, skipped: %s", path)
    if not given:
        return spark.createDataFrame([], "input_idx long, path string, input_stem string, path_no_ext string")
    # One listing for all of them; which of the given paths each file comes from is a join.
    files = spark.read.format("binaryFile").load(sorted({q for _, q, _ in given})).select("path").distinct()
    asked = spark.createDataFrame(given, "pos long, given string, folder boolean")
    of = F.when(F.col("folder"), (F.regexp_replace("path", "/[^/]*$", "") == F.col("given")) & F.col("path").endswith(".wav")).otherwise(F.col("path") == F.col("given"))
    found = files.join(F.broadcast(asked), of).select("pos", "path")  # the paths are a list on the driver
    return numbered(found, "input_idx", "pos", "path").select("input_idx", "path", stem_of(F.col("path")).alias("input_stem"), without_suffix(F.col("path")).alias("path_no_ext"))


def sidecar_files(spark: SparkSession, folder: str) -> DataFrame:
    """path_no_ext and stripped text of a folder's text files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    return files.select(without_suffix(F.col("path")).alias("path_no_ext"), strip(F.decode("content", "UTF-8")).alias("text"))


def write_lines(rows: DataFrame, path: str) -> None:
    """One text file of ``rows`` (input_stem, seed, position, line) for each input and seed, in order of position.

    A trial's lines meet in one task: they are as many as it has events. What an earlier run
    wrote for the same inputs and seeds is replaced, and everything else under ``path`` stays.
    """
    dealt = rows.repartition("input_stem", "seed").sortWithinPartitions("input_stem", "seed", "position")
    out = dealt.select("input_stem", "seed", "line").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("input_stem", "seed").text(path)


def write_records(rows: DataFrame, path: str) -> None:
    """``rows`` as JSON by input and seed, with their nulls."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").partitionBy("input_stem", "seed").json(path)
