"""Tables as streams: rows in files that come one after another, in order of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.session import new_folder

#: Rows of a file, more or less, where a slice has several.
ROWS = 100_000


def files_for(rows: DataFrame, slices: int) -> int:
    """Files over which ``arriving`` should deal each slice of ``rows``, so that as many tasks can write and read it."""
    return max(1, -(-rows.count() // (slices * ROWS)))


def arriving(rows: DataFrame, time: str, slices: int, files: int = 1, **heartbeat: object) -> str:
    """A folder with ``rows`` in at most ``slices`` slices by ``time``, each written after the one before.

    Each slice has exactly so many ``files``, some of them empty if it has few rows, so a stream that takes as many at once takes a slice. With values for a ``heartbeat`` a last row follows, a day after all others and null elsewhere, which lets event time pass what is open.
    """
    spark, order = rows.sparkSession, F.unix_micros(F.col(time).cast("timestamp"))
    folder, apart = new_folder(spark, "arriving"), new_folder(spark, "slices")
    first, last = rows.agg(F.min(order), F.max(order)).first()
    if first is None:
        rows.write.parquet(folder)
        return folder
    step = max(1, -(-(last - first + 1) // slices))
    rows.withColumn("_slice", F.coalesce(F.floor((order - first) / step), F.lit(0)).cast("int")).write.partitionBy("_slice").parquet(apart)
    table = spark.read.parquet(apart)
    written = 0
    for k in range(slices):
        own = table.where(F.col("_slice") == k).drop("_slice")
        if own.isEmpty():
            continue
        (own.coalesce(1) if files == 1 else own.repartition(files)).write.mode("append").parquet(folder)
        written += files
        if files > 1:  # Spark writes no file for a part without rows
            for _ in range(written - len(spark.read.parquet(folder).inputFiles())):
                own.limit(0).coalesce(1).write.mode("append").parquet(folder)
    if heartbeat:
        values = {time: F.timestamp_micros(F.lit(last + 86_400_000_000))} | {k: F.lit(v) for k, v in heartbeat.items()}
        beat = spark.range(0, 1, 1, 1).select(*(values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in table.drop("_slice").dtypes))
        beat.write.mode("append").parquet(folder)
    return folder
