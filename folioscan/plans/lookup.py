"""Terms of a query found through the stored index, in place of a scan of all texts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fold as folding
from ..functions.porter import stem
from ..functions.text import bm25_length, is_cjk, literal, query_grams
from ..operators import rank
from .index import TextIndex

FOUND = ("segment_row_id", "doc_id", "rank", "hit")


def words_in(text: str) -> list[str]:
    """The index tokens of a text, in order."""
    return re.findall(r"[^\W_]+", "".join(f" {c} " if is_cjk(c) else c for c in text.lower()))


def keys_of(text: str) -> list[str]:
    """The index terms of a folded text, in order."""
    return [stem(t) for t in words_in(text)]


class Lookup:
    """One index and the segments it was made of; find() gives the rows of one term."""

    def __init__(self, index: TextIndex, segments: DataFrame):
        self.index, self.segments, self.spark = index, segments, segments.sparkSession

    def find(self, text: str, match_case: bool = False, whole_word: bool = False) -> DataFrame | None:
        """FOUND of the segments that may hold the term: its rank, and whether the text has it. None where only a scan can tell: signs without letters
        or digits, and terms of one or two letters."""
        parts, exact = text.split(), match_case or whole_word
        plain = lambda w: w.isascii() and w.isalpha()
        if not exact and (plain(text) and len(text) > 2 or len(parts) > 1 and all(map(plain, parts))):
            return self.phrase(keys_of(text)).withColumn("hit", F.lit(True)).select(*FOUND)
        folded = folding.fold_text(text, self.spark)
        keys, pairs = keys_of(folded), query_grams(folded)
        body = folding.class_pattern(text, self.spark)
        if pairs:
            rows = self.index.postings(pairs).groupBy("segment_row_id").agg(F.count("*").alias("held")).where(F.col("held") == len(pairs)).withColumn("rank", F.lit(0.0))
        elif not keys or len(text) <= 2:
            return None
        else:
            rows = self.phrase(keys).select("segment_row_id", "rank")
        # the condition is read with a column of the index, so that only the texts of candidates are matched
        here = rows.join(self.segments.select("segment_row_id", "doc_id", "content"), "segment_row_id")
        check = F.when(F.col("rank").isNotNull(), F.col("content").rlike(literal(text, match_case, whole_word, body)))
        if not pairs:
            return here.select("segment_row_id", "doc_id", "rank", check.alias("hit"))
        shape = "(?iu)" + r"[^\p{L}\p{N}]*".join(folding.class_pattern(w, self.spark) for w in words_in(text))
        counted = here.select("segment_row_id", "doc_id", check.alias("hit"), F.when(F.col("rank").isNotNull(), F.regexp_count("content", F.lit(shape))).alias("tf"), bm25_length("content").alias("length"))
        return self.scored(counted).select(*FOUND)

    def phrase(self, keys: list[str]) -> DataFrame:
        """(segment_row_id, doc_id, rank) of the segments that hold the terms one after the other."""
        rows = self.index.postings(sorted(set(keys))).where("tf is not null")
        if len(keys) == 1:
            n = self.index.counts(keys)[keys[0]]
            return rows.withColumn("rank", self._score(F.lit(n))).select("segment_row_id", "doc_id", "rank")
        # the terms of one segment are at most as many as the phrase has
        places = [F.max(F.when(F.col("term") == k, F.col("positions"))).alias(f"p{i}") for i, k in enumerate(keys)]
        wide = rows.groupBy("segment_row_id", "doc_id").agg(F.first("length").alias("length"), *places)
        follows = F.filter("p0", lambda p: F.forall(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"p{i}").alias("p")) for i in range(1, len(keys))]), lambda x: F.array_contains(x["p"], p + x["i"])))
        held = wide.where(" and ".join(f"p{i} is not null" for i in range(len(keys)))).withColumn("tf", F.size(follows)).where("tf > 0")
        return self.scored(held).select("segment_row_id", "doc_id", "rank")

    def scored(self, rows: DataFrame) -> DataFrame:
        """rows (tf, length) with rank; the number of segments that hold the term is one broadcast row."""
        n = rows.agg(F.count_if(F.col("tf") > 0).alias("have"))
        return rows.join(F.broadcast(n)).withColumn("rank", F.when(F.col("tf") > 0, self._score(F.col("have"))).otherwise(0.0))

    def _score(self, have):
        return F.least(F.lit(0.0), rank.score(F.col("tf"), F.col("length"), F.lit(float(self.index.meta["mean"])), have, F.lit(self.index.meta["segments"])))
