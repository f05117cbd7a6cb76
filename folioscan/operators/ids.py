"""Consecutive numbers over an order without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(df: DataFrame, name: str, *order, start=0) -> DataFrame:
    """df with name = start + 1, start + 2, ... in the order given, which must be total.

    Rows are range-partitioned by the order and written to the shared folder, so that counting and numbering see the same ranges even if an executor is
    lost between; each partition numbers its rows and adds the count of those before it (one small row per partition).
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    held = saved(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    counts = held.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return held.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, F.lit(start) + F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def saved(df: DataFrame) -> DataFrame:
    """df with its lineage cut through the folder all executors share."""
    from ..sources.shared import work_folder

    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(work_folder(df.sparkSession))
    return df.checkpoint()
