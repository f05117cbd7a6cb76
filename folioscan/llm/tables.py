"""Reading inputs, pruning joins by a bounded bucket table, and cutting lineage."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of prune(): the broadcast side has at most 2**BUCKET_BITS rows of one long, whatever the input.
BUCKET_BITS = 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Enough partitions for all cores when a scan yields fewer: one file must not mean one task. No shuffle otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 > cores else df.repartition(cores * 2, *columns)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the folder all executors share (spark.checkpoint.dir). Where it is unset a local master gets a folder of this machine,
    a cluster an error."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint"))
    return df.checkpoint()


def prune(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key falls in a bucket of some wanted key: a superset of the semi-join, taken without moving df.

    The broadcast side is the set of occupied buckets, so its size is bounded by 2**BUCKET_BITS longs (8 MB), not by the data.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(1 << BUCKET_BITS))
    return df.withColumn("_bucket", bucket).join(F.broadcast(wanted.select(bucket.alias("_bucket")).distinct()), "_bucket", "left_semi").drop("_bucket")


def sampled(df: DataFrame, n: int, key: str, total: int | None = None) -> DataFrame:
    """The n rows with the least hashes of key, the same for the same rows; all but about 2n rows are dropped in the scan."""
    total = df.count() if total is None else total
    h = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    if total > 2 * n:
        df = df.where(h < int((1 << 40) * min(1.0, 2 * n / total)))
    return df.orderBy(h, key).limit(n)


#: Bits of a Sieve: 8 MB for a task, and at most 2**(SIEVE_BITS - 6) rows of two numbers to the driver, whatever the table.
SIEVE_BITS = 26


class Sieve:
    """A Bloom filter with two bits for each 64-bit hash: what passes is a superset of the hashes it was made of. A join decides; it only keeps rows from moving."""

    def __init__(self, hashes: DataFrame):
        column = hashes.columns[0]

        def mark(batches):
            bits = np.zeros(1 << SIEVE_BITS, bool)
            for batch in batches:
                for place in _places(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)):
                    bits[place] = True
            words = np.packbits(bits, bitorder="little").view(np.int64)
            some = np.flatnonzero(words)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(words[some])], ["word", "bits"])

        rows = hashes.where(F.col(column).isNotNull()).mapInArrow(mark, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
        words = np.zeros(1 << (SIEVE_BITS - 6), np.int64)
        got = rows.toArrow()
        words[got.column("word").to_numpy()] = got.column("bits").to_numpy()
        self.words = words

    def passes(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the hashes that pass."""
        data = self.words.view(np.uint8)
        one, two = _places(h)
        i = np.flatnonzero(data[one >> 3] >> (one & 7).astype(np.uint8) & 1)
        two = two[i]
        return i[(data[two >> 3] >> (two & 7).astype(np.uint8) & 1).astype(bool)]


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << SIEVE_BITS) - 1)
    return (h & mask).astype(np.int64), (h >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)
