"""Directory scans and parsing as DataFrames."""

from __future__ import annotations

import fnmatch
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .parsers import REGISTERED, extensions, parse, version
from .store import PARSED_ROW

# Files no scan takes.
SKIPPED = ("thumbs.db", "desktop.ini")


def distinct_roots(roots: list[str]) -> list[str]:
    """Absolute roots without repeats and without those inside others."""
    out: list[str] = []
    for r in sorted({os.path.abspath(os.path.expanduser(x)) for x in roots}, key=lambda r: (len(r), r)):
        if not any(r == o or r.startswith(o.rstrip("/") + "/") for o in out):
            out.append(r)
    return out


def available(roots: list[str]) -> tuple[list[str], list[str]]:
    """(available, unavailable); what lies in unavailable ones is never deleted."""
    good, bad = [], []
    for r in roots:
        try:
            with os.scandir(r):
                good.append(r)
        except OSError:
            bad.append(r)
    return good, bad


def local_path(uri: Column) -> Column:
    return F.regexp_replace(uri, "^file:/{1,3}", "/")


def valid(path: Column) -> Column:
    """No temporary, hidden or system file, no hidden folder on the way, and an extension with a parser."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    ext = F.element_at(F.split(name, r"\."), -1)
    return ~F.startswith(name, F.lit("~$")) & ~F.startswith(name, F.lit(".")) & ~name.isin(*SKIPPED) & name.contains(".") & ext.isin(*extensions())


def not_excluded(path: Column, root: str, patterns: list[str]) -> Column:
    """Relative patterns fit a part, the name or the path below the root; absolute ones the whole path."""
    below = F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.length(path))
    out = F.lit(True)
    for p in patterns:
        rule = fnmatch.translate(p).replace(r"\Z", r"\z").replace("(?s:", "(?s:")
        if p.startswith("/"):
            out = out & ~path.rlike("^" + rule)
        else:
            out = out & ~F.array_contains(F.split(below, "/"), F.lit(p)) & ~F.element_at(F.split(path, "/"), -1).rlike("^" + rule) & ~below.rlike("^" + rule)
    return out


def scan(spark: SparkSession, roots: list[str], patterns: list[str] | None = None, subdirectories: bool = True, content: bool = False) -> DataFrame:
    """path, mtime, file_size (and content) of the files of available roots. Hidden folders are left out; the file source reads each file once."""
    frames = []
    for root in available(distinct_roots(roots))[0]:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(subdirectories).lower()).load(root)
        path = local_path(F.col("path"))
        hidden = F.substring(path, F.lit(len(root.rstrip("/")) + 1), F.length(path)).rlike(r"/\.")
        cols = [path.alias("path"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), F.col("length").alias("file_size"), *(["content"] if content else [])]
        frames.append(raw.where(valid(path) & ~hidden & not_excluded(path, root, patterns or [])).select(*cols))
    if not frames:
        return spark.createDataFrame([], "path string, mtime double, file_size long" + (", content binary" if content else ""))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.dropDuplicates(["path"]) if len(frames) > 1 else out


#: Paths that are opened one by one; for more the folders are read and joined, which gives the same rows.
NAMED = 10_000


def listed(spark: SparkSession, paths: list[str], roots: list[str], patterns: list[str] | None = None, content: bool = False) -> DataFrame:
    """As scan(), of the given paths only: those that are there, lie in a root and may be indexed. Nothing else is listed or read."""
    here = [p for p in dict.fromkeys(paths) if os.path.isfile(p)]
    schema = "path string, mtime double, file_size long" + (", content binary" if content else "")
    if not here:
        return spark.createDataFrame([], schema)
    raw = spark.read.format("binaryFile").load([_literal(p) for p in here])
    path, inside = local_path(F.col("path")), F.lit(False)
    for root in distinct_roots(roots):
        below = F.substring(path, F.lit(len(root.rstrip("/")) + 1), F.length(path))
        inside = inside | (F.startswith(path, F.lit(root.rstrip("/") + "/")) & ~below.rlike(r"/\.") & not_excluded(path, root, patterns or []))
    return raw.where(valid(path) & inside).select(path.alias("path"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), F.col("length").alias("file_size"), *(["content"] if content else []))


def _literal(path: str) -> str:
    """A path in which signs of file patterns stand for themselves."""
    return "".join("\\" + c if c in "*?[]{}\\" else c for c in path)


def contents(spark: SparkSession, wanted: DataFrame, roots: list[str], patterns: list[str] | None = None) -> DataFrame:
    """path, mtime, file_size and content of the wanted paths. Few are opened by name, so that a changed file does not cost a reading of its folder."""
    some = [r[0] for r in wanted.select("path").limit(NAMED + 1).collect()]
    if len(some) <= NAMED:
        return listed(spark, some, roots, patterns, content=True)
    return scan(spark, roots, patterns, content=True).join(wanted.select("path"), "path", "left_semi")


def parsed(files: DataFrame) -> DataFrame:
    """One row per file with its segments; a bad file is a row with an error, an unsupported one none. files: path, mtime, file_size, content."""
    own = dict(REGISTERED)

    def run(batches):
        for batch in batches:
            out = []
            for path, mtime, size, data in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("path", "mtime", "file_size", "content")), strict=True):
                name = path.rpartition("/")[2]
                ext = name.rpartition(".")[2].lower()
                p = parse(ext, data, own)
                if p.status == "unsupported":
                    continue
                keep = p.segments if p.error is None or p.status == "partial" else []
                out.append({"doc_id": None, "path": path, "filename": name, "file_type": ext, "file_size": size, "mtime": mtime, "total_segments": len(keep), "error": p.error, "parse_status": p.status, "warnings": p.warnings, "parser_version": version(ext), "segments": keep})
            yield pa.RecordBatch.from_pylist(out, schema)

    text, row = pa.string(), pa.struct
    span = row([("start", pa.int32()), ("end", pa.int32()), ("kind", text), ("location", text)])
    segment = row([("segment_id", text), ("segment_type", text), ("content", text), ("sources", pa.list_(span))])
    warning = row([("code", text), ("location", text), ("message", text)])
    schema = pa.schema([("doc_id", pa.int64()), ("path", text), ("filename", text), ("file_type", text), ("file_size", pa.int64()), ("mtime", pa.float64()), ("total_segments", pa.int32()), ("error", text), ("parse_status", text), ("warnings", pa.list_(warning)), ("parser_version", text), ("segments", pa.list_(segment))])
    return files.select("path", "mtime", "file_size", "content").mapInArrow(run, PARSED_ROW)
