"""The stored index of a segments table: postings of terms and of pairs of ideographs, counts of terms, and words with their stems.

Every table is cut into buckets by the key's checksum and sorted by key inside, so a lookup opens the files of its own buckets and skips row groups by
their bounds. Terms are stems of words as they are folded, so a search for a word is one lookup. An index belongs to one state of its table, told by the
fingerprint of the table's files, and is never changed; who needs the index of another state builds another.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fold as folding
from ..functions.porter import stem
from ..functions.text import CJK_RANGES, bm25_length, tokens
from ..operators.parallel import spread
from ..sources import shared

POSTINGS = "term string, segment_row_id long, doc_id long, tf int, length int, positions array<int>"
TERMS = "term string, segments long, occurrences long"
WORDS = "word string, stem string, n long"
LEAST_BUCKETS, MOST_BUCKETS, BUCKET_ROWS, SALTS = 16, 4096, 20_000, 2
IDEOGRAPH_RUN = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in CJK_RANGES) + "]{2,}")
_known: dict = {}


def pairs_in(text: str) -> set[str]:
    """The pairs of adjoining ideographs."""
    return {run[i : i + 2] for run in IDEOGRAPH_RUN.findall(text) for i in range(len(run) - 1)}


def posting_rows(segments: DataFrame) -> DataFrame:
    """POSTINGS of the segments: a row for each term with its places, and for each pair of ideographs with none. Null contents have no rows."""
    spark = segments.sparkSession
    folded = folding.fold("content", spark)
    listed = spread(segments.where("content is not null")).select("segment_row_id", "doc_id", tokens(folded).alias("t"), bm25_length("content").alias("n"), folded.alias("text"))

    def post(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            columns = (batch.column(i).to_pylist() for i in range(5))
            for segment, doc, words, n, text in zip(*columns):
                places: dict[str, list[int]] = {}
                for i, w in enumerate(words):
                    places.setdefault(stem(w), []).append(i)
                pairs = pairs_in(text)
                out[0] += [*places, *pairs]
                size = len(places) + len(pairs)
                out[1] += [segment] * size
                out[2] += [doc] * size
                out[3] += [*map(len, places.values()), *[None] * len(pairs)]
                out[4] += [n] * size
                out[5] += [*places.values(), *[None] * len(pairs)]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["term", "segment_row_id", "doc_id", "tf", "length", "positions"])

    return listed.mapInArrow(post, POSTINGS)


def word_rows(segments: DataFrame) -> DataFrame:
    """WORDS of the segments: the words of ASCII letters, lower-cased; stems are made of distinct words."""
    found = F.regexp_extract_all(F.lower("content"), F.lit(r"(?<![\p{L}\p{N}])[a-z]+(?![\p{L}\p{N}])"), F.lit(0))
    words = spread(segments.select("content")).select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n"))

    def add_stem(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([stem(w) for w in batch.column(0).to_pylist()], pa.string()), batch.column(1)], ["word", "stem", "n"])

    return words.mapInArrow(add_stem, WORDS)


def bucket_of(key: str, buckets: int) -> int:
    return zlib.crc32(key.encode()) % buckets


class TextIndex:
    """Reads an index; `build` makes it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.meta = json.loads(shared.read_text(spark, f"{folder}/meta.json"))
        self._counts: dict[str, int] = {}

    @classmethod
    def build(cls, segments: DataFrame, folder: str) -> TextIndex:
        """Write the index of the segments; a folder that is there already is complete and is kept."""
        spark = segments.sparkSession
        if shared.exists(spark, f"{folder}/meta.json"):
            return cls(spark, folder)
        part = f"{folder}.{uuid.uuid4().hex}"
        held = segments.agg(F.count("*").alias("n"), F.sum(F.when(F.col("content").isNotNull(), bm25_length("content")).otherwise(0)).alias("length")).first()
        buckets = max(LEAST_BUCKETS, min(MOST_BUCKETS, (held["n"] or 0) // BUCKET_ROWS))

        def write(df: DataFrame, name: str, key: str, salt=None) -> list[int]:
            b = F.pmod(F.crc32(key), F.lit(buckets)).cast("int")
            by = [F.col("bucket")] + ([salt] if salt is not None else [])
            df.withColumn("bucket", b).repartition(*by).sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(f"{part}/{name}")
            return sorted(int(x.partition("=")[2]) for x in shared.names(spark, f"{part}/{name}") if x.startswith("bucket="))

        # a term of many segments is dealt by segment, so that no task writes it alone
        have = {"postings": write(posting_rows(segments), "postings", "term", F.pmod("segment_row_id", F.lit(SALTS)))}
        posted = spark.read.schema(POSTINGS).parquet(f"{part}/postings").where("tf is not null")
        have["terms"] = write(posted.groupBy("term").agg(F.count("*").alias("segments"), F.sum("tf").alias("occurrences")), "terms", "term")
        have["words"] = write(word_rows(segments), "words", "stem")
        meta = {"segments": held["n"], "mean": (held["length"] or 0) / held["n"] if held["n"] else 0.0, "buckets": buckets, "have": have}
        shared.create(spark, f"{part}/meta.json", json.dumps(meta))
        if shared.exists(spark, folder) or not shared.rename(spark, part, folder):
            shared.remove(spark, part)  # another writer was first
        return cls(spark, folder)

    def _table(self, name: str, schema: str, keys: list[str] | None = None) -> DataFrame:
        """A table, or the rows of it that the keys' buckets hold."""
        have = self.meta["have"][name]
        wanted = have if keys is None else sorted({bucket_of(k, self.meta["buckets"]) for k in keys} & set(have))
        if not wanted:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.folder}/{name}"] if keys is None else [f"{self.folder}/{name}/bucket={b}" for b in wanted]
        return self.spark.read.schema(schema).parquet(*paths)

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        rows = self._table("postings", POSTINGS, terms)
        return rows if terms is None else rows.where(F.col("term").isin(terms))

    def terms(self) -> DataFrame:
        return self._table("terms", TERMS)

    def words(self) -> DataFrame:
        return self._table("words", WORDS)

    def counts(self, terms: list[str]) -> dict[str, int]:
        """Segments that hold each term; one row a term comes to the driver, and is remembered, for the index does not change."""
        new = [t for t in terms if t not in self._counts]
        if new:
            self._counts.update(dict.fromkeys(new, 0))
            self._counts.update({r[0]: r[1] for r in self._table("terms", TERMS, new).where(F.col("term").isin(new)).select("term", "segments").collect()})
        return {t: self._counts[t] for t in terms}

    @lru_cache(1024)  # noqa: B019
    def words_of(self, word: str) -> list[str]:
        """The corpus words with the stem of word, and the word itself."""
        root = stem(word)
        rows = self._table("words", WORDS, [root]).where(F.col("stem") == root).select("word").collect()
        return sorted({r[0] for r in rows} | {word.lower()})


def index_of(spark: SparkSession, path: str) -> TextIndex:
    """The index of the segments table at path as it is now: the stored one if the table's files are those it was made of, else a new one."""
    key = (spark.sparkContext.applicationId, shared.fingerprint(spark, path))
    if key not in _known:
        _known[key] = TextIndex.build(spark.read.parquet(path), f"{shared.work_folder(spark)}/folioscan-index/{key[1]}")
    return _known[key]
