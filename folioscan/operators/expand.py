"""Synonyms, one-edit variants and the fusion of exact and semantic ranks."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import literal
from .filters import under
from .ids import numbered
from .occurrences import occurrences
from .snippets import windows

MOST, SOURCES = 32, 32
RRF, EXPANSION, SEMANTIC_LEAST, SEMANTIC_MOST = 60, 1 / 1000, 0.65, 1000


def simple_query(query: str) -> bool:
    """Expansion takes plain words only."""
    return not re.search(r'["():]', query) and not re.search(r"(?i)\b(and|or|not)\b", query) and bool(query.strip())


def read_synonyms(path: str) -> tuple[dict[str, list[str]], list[dict]]:
    """(global groups, scopes with file_type, path and terms) of a JSON file."""
    data = json.loads(Path(path).read_text("utf-8"))
    terms, scopes = data.get("terms", {}), data.get("scopes", [])
    if not isinstance(terms, dict) or not all(isinstance(v, list) for v in terms.values()):
        raise ValueError("terms must map words to lists")
    return terms, scopes


def synonyms(query: str, groups: dict[str, list[str]], fold=str.casefold) -> list[str]:
    """The other words of the groups that hold the query, the first MOST."""
    want, out = fold(query.strip()), []
    for key, values in groups.items():
        group = [key, *values]
        if want in map(fold, group):
            out += [g for g in group if fold(g) != want and g not in out]
    return out[:MOST]


def vocabulary(segments: DataFrame) -> DataFrame:
    """(word, n): distinct lower-case words of four and more ASCII letters, and their occurrences."""
    words = F.regexp_extract_all(F.lower("content"), F.lit(r"(?<![\p{L}\p{N}])[a-z]{4,}(?![\p{L}\p{N}])"), F.lit(0))
    return segments.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def near_words(words: DataFrame, query: str) -> DataFrame:
    """Words exactly one edit away, in order, the first MOST; none for a query that is no plain word."""
    if not re.fullmatch("[a-zA-Z]{4,}", query):
        return words.select("word").where(F.lit(False))
    return words.select("word").where(F.levenshtein("word", F.lit(query.lower()), 1) == 1).orderBy("word").limit(MOST)


def fused(exact: DataFrame, expanded: DataFrame, semantic: DataFrame) -> DataFrame:
    """(doc_id, score, rank_score, matched_by): reciprocal ranks of exact hits and passages, a small sum for expansion hits; exact documents first.

    exact: doc_id, rank_score; expanded: doc_id, one row per hit; semantic: doc_id, passage, score, at most SEMANTIC_MOST rows.
    """
    first = numbered(exact, "r", "rank_score", "doc_id").select("doc_id", (1 / (RRF + F.col("r"))).alias("s"), F.lit("exact").alias("by"))
    second = expanded.groupBy("doc_id").agg((F.count("*") * EXPANSION).alias("s")).withColumn("by", F.lit("expanded"))
    # at most SEMANTIC_MOST rows
    third = semantic.withColumn("r", F.row_number().over(W.orderBy(F.desc("score"), "passage"))).select("doc_id", (1 / (RRF + F.col("r"))).alias("s"), F.lit("semantic").alias("by"))
    total = first.union(second).union(third).groupBy("doc_id").agg(F.sum("s").alias("score"), F.array_sort(F.collect_set("by")).alias("matched_by"))
    place = F.when(F.array_contains("matched_by", "exact"), -2.0).otherwise(0.0) - F.least(F.lit(1.0), F.col("score"))
    return total.withColumn("rank_score", place)


def expansion_hits(segments: DataFrame, terms: list[str], match_case: bool = False, whole_word: bool = False) -> DataFrame:
    """(doc_id, segment_row_id, term): segments that hold an expansion term; the terms are at most MOST, so they are literals of one scan."""
    if not terms:
        return segments.select("doc_id", "segment_row_id", F.lit("").alias("term")).where(F.lit(False))
    found = F.array_compact(F.array(*[F.when(F.col("content").rlike(literal(t, match_case, whole_word)), F.lit(t)) for t in terms[:MOST]]))
    return segments.select("doc_id", "segment_row_id", F.explode(found).alias("term"))


def in_scope(scope: dict):
    """Documents of the scope's file type and below its path; what is unset holds for all."""
    out = F.lit(True)
    if scope.get("file_type"):
        out = out & (F.col("file_type") == scope["file_type"].lower())
    return out & under("path", scope["path"]) if scope.get("path") else out


def passages(segments: DataFrame, terms: list[str], match_case: bool = False, whole_word: bool = False, around: int = 120, most: int = 3) -> DataFrame:
    """(doc_id, segment_row_id, start, end, text, sources): of each document the first `most` contexts of the terms, each with the sources it touches,
    SOURCES at most; contexts that begin inside an earlier one of the segment are left out. Only contexts leave the executors."""
    flags = 0 if match_case else int(re.IGNORECASE)
    any_ = F.lit(False)
    for t in terms[: MOST + 1]:
        any_ = any_ | F.col("content").rlike(literal(t, match_case, whole_word))
    shape = lambda t: rf"(?<!\w){re.escape(t)}(?!\w)" if whole_word else re.escape(t)
    kept = ["doc_id", "segment_row_id", "content"] + [c for c in segments.columns if c == "sources"]
    found = occurrences(segments.where(any_).select(*kept), [{"kind": "literal", "term": t, "pattern": shape(t), "flags": flags} for t in terms[: MOST + 1]])
    rows = found.select(*kept, F.explode(windows(F.col("content"), F.col("spans"), most, around)).alias("w"))
    first = rows.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("segment_row_id", "w.left"))).where(F.col("n") <= most)
    touching = F.slice(F.filter("sources", lambda s: (s["start"] < F.col("w.right")) & (s["end"] > F.col("w.left"))), 1, SOURCES) if "sources" in kept else F.lit(None)
    return first.select("doc_id", "segment_row_id", F.col("w.left").alias("start"), F.col("w.right").alias("end"), F.substring("content", F.col("w.left") + 1, F.col("w.right") - F.col("w.left")).alias("text"), touching.alias("sources"))
