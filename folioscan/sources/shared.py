"""Folders that driver and executors share, through Hadoop's file systems: small files, atomic renames and fingerprints of tables."""

from __future__ import annotations

import hashlib
import tempfile

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def filesystem(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = filesystem(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    fs, p = filesystem(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = filesystem(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> bool:
    """Write a small file; False if it is there and is not to be overwritten. The file systems decide between two writers."""
    fs, p = filesystem(spark, path)
    try:
        out = fs.create(p, overwrite)
    except Exception:
        if not overwrite and fs.exists(p):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def rename(spark: SparkSession, path: str, to: str) -> bool:
    fs, p = filesystem(spark, path)
    return bool(fs.rename(p, filesystem(spark, to)[1]))


def remove(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def fingerprint(spark: SparkSession, path: str) -> str:
    """Changes whenever a file of the table is added, removed or rewritten."""
    fs, p = filesystem(spark, path)
    files, rows = fs.listFiles(p, True), []
    while files.hasNext():
        f = files.next()
        rows.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(rows)).encode()).hexdigest()[:24]


def work_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; where it is unset a local master gets a folder of this machine, a cluster an error."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if sc.master.startswith("local[") or sc.master == "local":
        return _own.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="folioscan"))
    raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
