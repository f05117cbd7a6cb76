"""The index on shared storage: every commit adds a part with its rows and the ids of documents that are gone, and a manifest that names the parts.

A revision is its manifest, written once and only if no other writer has it, so that a reader sees one revision whole, a failed write changes nothing, and
of two writers one is told to try again. A row counts if its document has not been put or deleted at a later revision than its own. One changed file
costs one small part; when the parts are many they are written together into one.
"""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ids import numbered, saved
from ..plans.index import TextIndex
from . import shared

FORMAT = 7
#: Parts of a revision beyond which a commit writes them together.
MOST_PARTS = 24
PARSED_ROW = "doc_id long, path string, filename string, file_type string, file_size long, mtime double, total_segments int, error string, parse_status string, warnings array<struct<code:string,location:string,message:string>>, parser_version string, segments array<struct<segment_id:string,segment_type:string,content:string,sources:array<struct<start:int,end:int,kind:string,location:string>>>>"
DOCUMENTS = "doc_id long, path string, filename string, file_type string, file_size long, mtime double, ctime double, indexed_at double, total_segments int, error string, parse_status string, warnings array<struct<code:string,location:string,message:string>>, parser_version string"
SEGMENTS = "segment_row_id long, doc_id long, segment_id string, segment_type string, content string, sources array<struct<start:int,end:int,kind:string,location:string>>"
CHUNKS = "chunk_id long, segment_row_id long, start int, end int, vector array<float>"
SCHEMAS = {"documents": DOCUMENTS, "segments": SEGMENTS, "chunks": CHUNKS, "gone": "doc_id long"}
EMPTY = {"doc": 0, "segment": 0, "chunk": 0, "model_id": None, "vector_revision": None}
_locks: dict[str, threading.Lock] = {}


class StoreError(RuntimeError):
    """code: locked, read_only, corrupt, too_new, conflict, migration."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(message or code)
        self.code = code


class Store:
    """Revision n is manifest n. Ids go on from the greatest ever given."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, str(root).rstrip("/")
        self.lock = _locks.setdefault(self.root, threading.Lock())
        if self._latest() is None:
            self._migrate() or self._manifest(0, {"parts": []} | EMPTY)

    # reading

    def _latest(self) -> int | None:
        found = [int(n[:-5]) for n in shared.names(self.spark, f"{self.root}/manifest") if n.endswith(".json") and n[:-5].isdigit()]
        return max(found, default=None)

    def manifest(self, revision: int | None = None) -> dict:
        try:
            state = json.loads(shared.read_text(self.spark, f"{self.root}/manifest/{self._latest() if revision is None else revision}.json"))
            made = state["format"]
        except (ValueError, KeyError, TypeError):
            raise StoreError("corrupt") from None
        if made > FORMAT:
            raise StoreError("too_new", f"format {made}")
        return state

    @property
    def state(self) -> dict:
        return self.manifest()

    @property
    def revision(self) -> int:
        return self.state["revision"]

    def table(self, name: str, revision: int | None = None) -> DataFrame:
        return self._live(name, self.manifest(revision)["parts"])

    def _live(self, name: str, parts: list[dict]) -> DataFrame:
        """The rows of the parts that count."""
        own = ", _doc long" if name == "chunks" else ""
        rows = self._read(name, SCHEMAS[name] + own, parts)
        gone = [p for p in parts if "gone" in p["have"]]
        plain = [c for c in rows.columns if not c.startswith("_")]
        if gone:
            doc = "_doc" if name == "chunks" else "doc_id"
            last = self._read("gone", SCHEMAS["gone"], gone).groupBy("doc_id").agg(F.max("_rev").alias("_gone")).withColumnRenamed("doc_id", doc)
            rows = rows.join(last, doc, "left").where("_gone is null or _rev >= _gone")
        return rows.select(*plain)

    def _read(self, name: str, schema: str, parts: list[dict]) -> DataFrame:
        """Rows with the revision of their part."""
        paths = [f"{self.root}/parts/{p['id']}/{name}" for p in parts if name in p["have"]]
        full = f"{schema}, _rev long"
        return self.spark.read.schema(full).parquet(*paths) if paths else self.spark.createDataFrame([], full)

    def segments_of(self, doc_id: int) -> DataFrame:
        return self.table("segments").where(F.col("doc_id") == doc_id).orderBy("segment_row_id")

    def by_path(self, path: str, legacy: str | None = None) -> DataFrame:
        """The document with this path; an older spelling counts if the first is not there."""
        rows = self.table("documents").where(F.col("path").isin(path, legacy or path))
        return rows.orderBy((F.col("path") == path).desc()).limit(1)

    def index(self, revision: int, build: bool = False) -> TextIndex | None:
        """The text index of a revision; None if it is not built and is not to be."""
        folder = f"{self.root}/index/{revision}"
        if not build and not shared.exists(self.spark, f"{folder}/meta.json"):
            return None
        return TextIndex.build(self.table("segments", revision), folder)

    # writing

    def _manifest(self, revision: int, state: dict) -> int:
        """Commit: the manifest is there whole or not at all, and once."""
        path = f"{self.root}/manifest/{revision}.json"
        part = f"{self.root}/manifest/.{uuid.uuid4().hex}"
        try:
            shared.create(self.spark, part, json.dumps({"format": FORMAT, "revision": revision} | state))
            free = not shared.exists(self.spark, path) and shared.rename(self.spark, part, path)
        except Exception as e:
            raise StoreError("read_only", str(e)[:300]) from None
        if not free:
            shared.remove(self.spark, part)
            raise StoreError("conflict", "another writer was first")
        return revision

    def _part(self, revision: int, tables: dict[str, DataFrame]) -> dict:
        name = uuid.uuid4().hex
        for table, df in tables.items():
            df.withColumn("_rev", F.lit(revision).cast("long")).write.parquet(f"{self.root}/parts/{name}/{table}")
        return {"id": name, "rev": revision, "have": sorted(tables)}

    def _commit(self, state: dict, tables: dict[str, DataFrame], ids: dict) -> int:
        revision = state["revision"] + 1
        parts = [*state["parts"], self._part(revision, tables)]
        if len(parts) > MOST_PARTS:
            parts = [self._together(parts, revision)]
        return self._manifest(revision, {k: state[k] for k in EMPTY} | ids | {"parts": parts})

    def _together(self, parts: list[dict], revision: int) -> dict:
        segments = self._live("segments", parts)
        chunks = self._live("chunks", parts).join(segments.select("segment_row_id", F.col("doc_id").alias("_doc")), "segment_row_id")
        return self._part(revision, {"documents": self._live("documents", parts), "segments": segments, "chunks": chunks.select("chunk_id", "segment_row_id", "start", "end", "vector", "_doc")})

    def compact(self) -> int:
        """All parts as one, in a new revision."""
        with self.lock:
            state = self.state
            if len(state["parts"]) < 2:
                return state["revision"]
            revision = state["revision"] + 1
            return self._manifest(revision, {k: state[k] for k in EMPTY} | {"parts": [self._together(state["parts"], revision)]})

    def upsert(self, parsed: DataFrame, now: float, delete: DataFrame | None = None) -> int:
        """Replace the documents of `parsed` (see files.parsed) by path and delete the paths of `delete`, in one revision; returns it.

        Paths that stay keep their doc_id, segments get new ids in the order of the file. Nothing to do leaves the revision. Only new rows are written.
        """
        with self.lock:
            state = self.state
            old = self._live("documents", state["parts"])
            known, known_columns = old.select("path", F.col("doc_id").alias("old_id")), old.columns
            rows = saved(parsed.drop("doc_id").join(known, "path", "left"))
            touched = rows.where("old_id is not null").select(F.col("old_id").alias("doc_id"))
            if delete is not None:
                touched = touched.union(known.join(delete.select("path"), "path", "left_semi").select(F.col("old_id").alias("doc_id")))
            touched = saved(touched.distinct())
            if not rows.limit(1).count() and not touched.limit(1).count():
                return state["revision"]
            fresh = numbered(rows.where("old_id is null").select("path"), "new_id", "path", start=state["doc"])
            rows = saved(rows.join(fresh, "path", "left").withColumn("doc_id", F.coalesce("old_id", "new_id")).withColumn("ctime", F.col("mtime")).withColumn("indexed_at", F.lit(now)))
            flat = rows.select("doc_id", F.posexplode("segments").alias("n", "s"))
            new = numbered(flat, "segment_row_id", "doc_id", "n", start=state["segment"]).select("segment_row_id", "doc_id", "s.segment_id", "s.segment_type", "s.content", "s.sources")
            most = rows.agg(F.max("doc_id"), F.coalesce(F.sum(F.size("segments")), F.lit(0))).first()
            documents = rows.select(*known_columns)
            ids = {"doc": max(state["doc"], most[0] or 0), "segment": state["segment"] + most[1]}
            return self._commit(state, {"documents": documents, "segments": new, "gone": touched}, ids)

    def delete(self, paths: DataFrame, now: float = 0.0) -> int:
        nothing = self.spark.createDataFrame([], PARSED_ROW)
        return self.upsert(nothing, now, paths)

    def clear(self) -> int:
        """No rows in a new revision; an empty index stays as it is. Ids are not given again."""
        with self.lock:
            state = self.state
            if not self._live("documents", state["parts"]).limit(1).count():
                return state["revision"]
            ids = {k: state[k] for k in ("doc", "segment", "chunk")} | {"model_id": None, "vector_revision": None}
            return self._manifest(state["revision"] + 1, ids | {"parts": []})

    def publish_vectors(self, chunks: DataFrame, model_id: str, snapshot: int) -> int:
        """Replace all vectors, if the revision is still the one they were made from."""
        with self.lock:
            state = self.state
            if state["revision"] != snapshot:
                raise StoreError("conflict", "the index changed since the snapshot")
            docs = self._live("segments", state["parts"]).select("segment_row_id", F.col("doc_id").alias("_doc"))
            rows = saved(chunks.select("chunk_id", "segment_row_id", "start", "end", "vector").join(docs, "segment_row_id", "left"))
            top = rows.agg(F.max("chunk_id")).first()[0] or 0
            parts = [{**p, "have": [t for t in p["have"] if t != "chunks"]} for p in state["parts"]]
            order = ("chunk_id", "segment_row_id", "start", "end", "vector", "_doc")
            return self._commit(state | {"parts": parts}, {"chunks": rows.select(*order)}, {"chunk": max(state["chunk"], top), "model_id": model_id, "vector_revision": snapshot + 1})

    def keep(self, last: int = 2) -> None:
        """Remove all but the last revisions and what only they name; older readers must be done."""
        now = self.revision
        named: set[str] = set()
        for n in shared.names(self.spark, f"{self.root}/manifest"):
            if n[:-5].isdigit() and int(n[:-5]) <= now - last:
                shared.remove(self.spark, f"{self.root}/manifest/{n}")
            elif n[:-5].isdigit():
                named |= {p["id"] for p in self.manifest(int(n[:-5]))["parts"]}
        for n in set(shared.names(self.spark, f"{self.root}/parts")) - named:
            shared.remove(self.spark, f"{self.root}/parts/{n}")
        for n in shared.names(self.spark, f"{self.root}/index"):
            if n.isdigit() and int(n) <= now - last:
                shared.remove(self.spark, f"{self.root}/index/{n}")

    def backup(self) -> str:
        """A copy of the current manifest that keep() leaves alone, together with its parts; restore() takes it up again."""
        name = f"{self.root}/backup-{self.revision}-{uuid.uuid4().hex[:8]}"
        state = self.state
        part = self._together(state["parts"], state["revision"])
        shared.rename(self.spark, f"{self.root}/parts/{part['id']}", f"{name}-rows")
        shared.create(self.spark, f"{name}.json", json.dumps(state | {"parts": [part]}))
        return f"{name}.json"

    def restore(self, backup: str) -> int:
        """The rows of a backup as a new revision."""
        with self.lock:
            state, now = json.loads(shared.read_text(self.spark, backup)), self.state
            folder, revision = backup.removesuffix(".json") + "-rows", now["revision"] + 1
            tables = {t: self.spark.read.schema(SCHEMAS[t] + (", _doc long" if t == "chunks" else "")).parquet(f"{folder}/{t}") for t in state["parts"][0]["have"]}
            ids = {k: max(now[k], state[k]) for k in ("doc", "segment", "chunk")} | {"model_id": state["model_id"], "vector_revision": revision}
            return self._manifest(revision, ids | {"parts": [self._part(revision, tables)]})

    def _migrate(self) -> bool:
        """Take over a store of format 6 (whole tables for each revision and a pointer); its folders stay as the backup."""
        if not shared.exists(self.spark, f"{self.root}/CURRENT"):
            return False
        try:
            old = json.loads(shared.read_text(self.spark, f"{self.root}/CURRENT"))
            if old["format"] > FORMAT:
                raise StoreError("too_new", f"format {old['format']}")
            v = f"{self.root}/v{old['revision']}"
            tables = {t: self.spark.read.schema(SCHEMAS[t]).parquet(f"{v}/{t}") for t in ("documents", "segments", "chunks")}
            tables["chunks"] = tables["chunks"].join(tables["segments"].select("segment_row_id", F.col("doc_id").alias("_doc")), "segment_row_id", "left")
            self._manifest(old["revision"], {k: old[k] for k in EMPTY} | {"parts": [self._part(old["revision"], tables)]})
        except (ValueError, KeyError):
            raise StoreError("migration", "the old store cannot be read") from None
        return True
