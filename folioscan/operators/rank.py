"""BM25 over segments and the ranking of documents by their best segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bm25_length
from .parallel import spread

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def statistics(counted: DataFrame, names: list[str]) -> DataFrame:
    """One row: segments, mean length, and for each term the segments that hold it. counted: length, tf_*."""
    return counted.agg(F.count("*").alias("n_all"), F.avg("length").alias("mean"), *(F.count_if(F.col(f"tf_{t}") > 0).alias(f"n_{t}") for t in names))


def score(tf: Column, length: Column, mean: Column, have: Column, total: Column) -> Column:
    """Negative, the least is best; a term in more than half of the segments scores next to nothing."""
    idf = F.greatest(F.log((total - have + 0.5) / (have + 0.5)), F.lit(LEAST_IDF))
    return -idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def bm25(segments: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """segments with rank: the least score over the terms, at most 0. patterns: a name and the Java pattern of the token phrase of each term.

    Two scans of the text and no shuffle: frequencies are counted by the JVM, and the statistics are one broadcast row.
    """
    names = list(patterns)
    counted = spread(segments).withColumns({f"tf_{n}": F.regexp_count("content", F.lit(p)) for n, p in patterns.items()})
    one = statistics(counted.withColumn("length", bm25_length("content")), names)
    # lengths of segments without any term are not needed any more
    length = F.when(F.greatest(F.lit(0), F.lit(0), *(F.col(f"tf_{n}") for n in names)) > 0, bm25_length("content"))
    joined = counted.join(F.broadcast(one)).withColumn("length", length)  # one row
    ranks = [F.when(F.col(f"tf_{n}") > 0, score(F.col(f"tf_{n}"), F.col("length"), F.col("mean"), F.col(f"n_{n}"), F.col("n_all"))).otherwise(0.0) for n in names]
    rank = F.least(F.lit(0.0), *ranks) if ranks else F.lit(0.0)
    return joined.withColumn("rank", rank).drop("length", "mean", "n_all", *(f"tf_{n}" for n in names), *(f"n_{n}" for n in names))


def documents_ranked(hits: DataFrame) -> DataFrame:
    """(doc_id, rank_score, segment_count) of segments that match; the best segment ranks the document."""
    return hits.groupBy("doc_id").agg(F.min("rank").alias("rank_score"), F.count("*").alias("segment_count"))


def page(ranked: DataFrame, limit: int, after: tuple[float, int] | None = None) -> DataFrame:
    """The next documents by (rank, doc_id); limits come after ranking, as one TakeOrdered."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    if after is not None:
        rank, doc = after
        ranked = ranked.where((F.col("rank_score") > rank) | ((F.col("rank_score") == rank) & (F.col("doc_id") > doc)))
    return ranked.orderBy("rank_score", "doc_id").limit(limit)


#: What a table of results is sorted by.
SORTS = {"type": F.lower, "name": F.lower, "hits": None, "size": None, "mtime": None, "path": F.lower}
COLUMNS = {"type": "file_type", "name": "filename", "size": "file_size"}


def sorted_results(df: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """Documents by type, name, hits, size, mtime or path, texts without regard to case, ties by doc_id."""
    if by not in SORTS:
        raise ValueError(f"sorted by one of {', '.join(SORTS)}")
    key = F.col(COLUMNS.get(by, by))
    key = SORTS[by](key) if SORTS[by] else key
    return df.orderBy(key.desc() if descending else key.asc(), "doc_id")
