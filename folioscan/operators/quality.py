"""Statistics, extraction quality and document export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import is_problem


def index_stats(documents: DataFrame, segments: DataFrame) -> DataFrame:
    """One row: documents, searchable documents and bytes without error, segments, last time of indexing."""
    d = documents.agg(F.count("*").alias("documents"), F.count_if(F.col("error").isNull()).alias("documents_ok"), F.coalesce(F.sum(F.when(F.col("error").isNull(), F.col("file_size"))), F.lit(0)).alias("bytes_ok"), F.max("indexed_at").alias("last_indexed"))
    s = segments.agg(F.count("*").alias("segments"))
    return d.join(F.broadcast(s)).join(F.broadcast(searchable(documents, segments).agg(F.count("*").alias("searchable"))))  # one row each


def searchable(documents: DataFrame, segments: DataFrame) -> DataFrame:
    """Documents with a segment that is not blank."""
    some = segments.where(F.length(F.trim("content")) > 0).select("doc_id")
    return documents.join(some, "doc_id", "left_semi")


def quality_counts(documents: DataFrame) -> DataFrame:
    return documents.groupBy(F.coalesce("parse_status", F.lit("unknown")).alias("parse_status")).agg(F.count("*").alias("n"))


def problem_documents(documents: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    rows = documents.where(is_problem()).orderBy("doc_id")
    return rows if limit is None else rows.offset(offset).limit(limit)


def markdown(documents: DataFrame, segments: DataFrame) -> DataFrame:
    """(doc_id, markdown): title, facts, and the segments in order."""
    part = F.concat(F.lit("## "), "segment_type", F.lit(" "), "segment_id", F.lit("\n\n"), "content")
    body = segments.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("segment_row_id", part.alias("part")))).alias("parts"))
    head = F.concat(F.lit("# "), "filename", F.lit("\n\n- Path: "), "path", F.lit("\n- Type: "), "file_type", F.lit("\n- Size: "), F.col("file_size").cast("string"), F.lit(" bytes"))
    rest = F.coalesce(F.array_join(F.transform("parts", lambda p: F.concat(F.lit("\n\n"), p["part"])), ""), F.lit(""))
    return documents.join(body, "doc_id", "left").select("doc_id", F.concat(head, rest).alias("markdown"))


def iso_time(seconds: Column) -> Column:
    """Seconds since the epoch as ISO time of the session's zone; null for 0 and null."""
    return F.when(seconds != 0, F.date_format(F.timestamp_seconds(F.floor(seconds)), "yyyy-MM-dd'T'HH:mm:ss"))


def resource_uri(path: Column) -> Column:
    return F.concat(F.lit("folioscan://document/"), F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")))
