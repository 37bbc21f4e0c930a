"""Numbers for rows in a global order, without sorting them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.session import staged


def numbered(rows: DataFrame, name: str, *order: str | Column, key: str | None = None) -> DataFrame:
    """``rows`` with ``name``, 1 and up in the given order.

    Rows are dealt by range; each range is numbered on its own, and the ranges' sizes (a row
    each) give where it begins. Ties get their numbers in any order. With ``key``, a column that no two rows share and
    none has null, only it and the columns of the order are dealt and numbered, and the rows get their numbers by a join.
    """
    if key:
        columns = dict.fromkeys([key, *(x for x in order if isinstance(x, str))])
        return rows.join(numbered(rows.select(*columns), name, *order).select(key, name), key)
    dealt = staged(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "numbering")
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_inside", inside).join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_inside")).drop("_range", "_start", "_inside")
