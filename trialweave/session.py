"""Session helpers shared by every part of the library."""

from __future__ import annotations

import gc
import re
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def ship_by_value() -> None:
    """Pickle this package's functions by value, so that Python workers need no copy of it.

    Workers of a cluster started elsewhere have neither the driver's
    ``sys.path`` nor its files; functions handed to ``mapInArrow`` and friends
    then travel whole.
    """
    name = __name__.partition(".")[0]
    if name not in cloudpickle.list_registry_pickle_by_value():
        cloudpickle.register_pickle_by_value(sys.modules[name])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Without that setting, a session in one process (tests, a laptop) gets a temporary
    folder; on a cluster, where that would be another one on each machine, it is refused.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        there = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder where nothing is yet."""
    return f"{shared_dir(spark)}/trialweave/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: what follows reads files that outlive any executor.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.__dict__["_staged"] = path
    return table


def discard(table: DataFrame) -> None:
    """Remove the files of a ``staged`` table that nothing reads any more."""
    spark = table.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(table.__dict__["_staged"])
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps.

    Spark removes them once the driver's JVM has collected what refers to them, which
    a driver with little to do does rarely.
    """
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within this, Arrow functions that run get batches of at most so many rows: less memory where rows are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
