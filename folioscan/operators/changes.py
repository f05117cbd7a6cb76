"""Differences between a scan and the index, and the state that a change log leads to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .filters import under

TOLERANCE = 0.001


def diff(scanned: DataFrame, indexed: DataFrame) -> DataFrame:
    """(path, change): new, changed (time or size), deleted or same. Both have path, mtime, file_size; a path given twice counts once."""
    a, b = (x.select("path", "mtime", "file_size").dropDuplicates(["path"]) for x in (scanned, indexed))
    j = a.alias("a").join(b.alias("b"), "path", "full_outer")
    other = (F.abs(F.col("a.mtime") - F.col("b.mtime")) > TOLERANCE) | (F.col("a.file_size") != F.col("b.file_size"))
    kind = F.when(F.col("b.mtime").isNull(), "new").when(F.col("a.mtime").isNull(), "deleted").when(other, "changed").otherwise("same")
    return j.select("path", kind.alias("change"))


def deletions(changes: DataFrame, preserved: list[str]) -> DataFrame:
    """Deleted paths that lie in none of the preserved (unavailable) folders; those are a handful, so they are literals."""
    out = changes.where(F.col("change") == "deleted")
    for p in preserved:
        out = out.where(~under("path", p))
    return out.select("path")


def log_state(log: DataFrame) -> DataFrame:
    """The last event of each document by event time, later seen and higher number first among equals; repeated rows count once."""
    latest = F.max_by(F.struct("change_id", "root_id", "path", "change_kind", "event_at", "seen_at", "file_size"), F.struct("event_at", "seen_at", "change_id"))
    return log.where("doc_id is not null").groupBy("doc_id").agg(latest.alias("x")).select("doc_id", "x.*")


def debounced(log: DataFrame, key: str = "path", at: str = "event_at", seconds: float = 0.35) -> DataFrame:
    """Bursts of events of a key with no pause over `seconds`, as one row: key, first, last, events."""
    w = W.partitionBy(key).orderBy(at)
    gap = F.coalesce(F.unix_micros(at) - F.unix_micros(F.lag(at).over(w)) > int(seconds * 1e6), F.lit(True))
    burst = log.where(F.col(key).isNotNull()).withColumn("_new", gap.cast("int")).withColumn("_burst", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return burst.groupBy(key, "_burst").agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("events")).drop("_burst")


def rooted(documents: DataFrame, roots: DataFrame) -> DataFrame:
    """documents with the root that holds them, by the natural key; null where it is unknown."""
    return documents.join(roots.select("root_id", "root_path", F.col("source").alias("root_source"), "include_subdirectories"), "root_id", "left")
