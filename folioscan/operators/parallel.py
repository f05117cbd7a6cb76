"""Parallelism of scans."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Enough partitions for all cores where a scan yields fewer, as of one small file; no shuffle otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 > cores else df.repartition(cores * 2)
