"""The engine as one object: index, search, read, watch."""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import asdict

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import changes, expand, quality, vectors
from .operators.chunks import chunked
from .operators.filters import has_warning, reprocess_eligible
from .operators.ids import numbered, saved
from .plans.querylang import QueryError
from .plans.search import Options, Page, Searcher
from .sources import files
from .sources.store import Store
from .streaming.live import Live, VectorUpkeep


class Engine:
    """Folders and one store. Searches read one revision; indexing runs one at a time."""

    def __init__(self, spark: SparkSession, root: str, directories: list[str] | None = None, exclude: list[str] | None = None, encoder=None):
        self.spark, self.store = spark, Store(spark, root)
        self.directories, self.exclude, self.encoder = files.distinct_roots(directories or []), exclude or [], encoder
        self._thread: threading.Thread | None = None
        self._last: dict = {}
        self._cancel, self._group = threading.Event(), f"folioscan-{uuid.uuid4().hex}"
        self.upkeep: VectorUpkeep | None = None
        self.live: Live | None = None

    # indexing

    def run(self, scope: list[str] | None = None, force: list[str] | DataFrame | None = None, backfill: str | None = None) -> dict:
        """Compare the folders (or those of scope) with the index; force: paths that are parsed again, without deletions; backfill: a warning code (ocr_disabled)
        whose files are parsed again along with the changed ones."""
        began = time.time()
        roots = files.distinct_roots(scope) if scope is not None else self.directories
        good, bad = files.available(roots)
        scanned = saved(files.scan(self.spark, good, self.exclude))
        indexed = self.store.table("documents")
        if force is not None:
            wanted = self.spark.createDataFrame([(p,) for p in force], "path string") if isinstance(force, list) else force.select("path")
            chosen = saved(scanned.join(wanted, "path", "left_semi").select("path"))
            n, asked = chosen.count(), wanted.distinct().count()
            self._upsert(chosen, good)
            return {"indexed": n, "deleted": 0, "reprocess_skipped": asked - n, "cancelled": self._cancel.is_set(), "elapsed": time.time() - began}
        if scope is not None:
            inside = F.lit(False)
            for r in roots:
                inside = inside | (F.col("path") == r) | F.startswith("path", F.lit(r.rstrip("/") + "/"))
            indexed = indexed.where(inside)
        change = saved(changes.diff(scanned, indexed))
        wanted = change.where(F.col("change").isin("new", "changed")).select("path")
        if backfill is not None:
            wanted = wanted.union(indexed.where(has_warning(backfill)).select("path")).distinct()
        gone = changes.deletions(change, bad)
        n = {r["change"]: r["count"] for r in change.groupBy("change").count().collect()}
        revision = self.store.revision if self._cancel.is_set() else self._upsert(wanted, good, gone)
        deleted = 0 if self._cancel.is_set() else gone.count()
        failed = self.store.table("documents", revision).where(F.col("error").isNotNull()).count()
        unreadable = [r[0] for r in self.store.table("documents", revision).where("parse_status = 'unreadable'").select("path").limit(1000).collect()]
        return {"indexed": n.get("new", 0) + n.get("changed", 0), "deleted": deleted, "failed": failed, "cancelled": self._cancel.is_set(), "skipped": n.get("same", 0), "scanned": sum(v for k, v in n.items() if k != "deleted"), "unavailable_directories": bad, "scan_error_paths": unreadable, "elapsed": time.time() - began}

    def _upsert(self, wanted: DataFrame, roots: list[str], gone: DataFrame | None = None) -> int:
        """Parse and commit the wanted paths, then bring the text index to the new revision. A cancelled run ends its jobs and commits nothing."""
        before = self.store.revision
        rows = files.parsed(files.contents(self.spark, wanted, roots, self.exclude))
        revision = self.store.upsert(rows, time.time(), gone)
        if revision != before:
            self.store.index(revision, build=True)
        return revision

    def cancel(self) -> None:
        """End the run in the background: its jobs are cancelled, and what is not committed by then is not."""
        self._cancel.set()
        self.spark.sparkContext.cancelJobGroup(self._group)

    def start_reindex(self, folder: str | None = None) -> bool:
        """In the background; False if one is running. folder must lie in a configured folder."""
        if folder is not None and not any(folder == d or folder.startswith(d.rstrip("/") + "/") for d in self.directories):
            raise ValueError("the folder is not in a configured one")
        if self._thread is not None and self._thread.is_alive():
            return False

        def work():
            self._cancel.clear()
            self.spark.sparkContext.setJobGroup(self._group, "indexing", interruptOnCancel=True)
            try:
                self._last = self.run(None if folder is None else [folder])
            except Exception as e:
                self._last = {"cancelled": True} if self._cancel.is_set() else {"error": str(e)}

        self._thread = InheritableThread(target=work, daemon=True)
        self._thread.start()
        return True

    def start_reprocess(self, paths: list[str] | None = None) -> dict:
        """Parse again the given paths, or all that another parser version made."""
        if paths is None:
            paths = self.store.table("documents").where(reprocess_eligible()).select("path")
        return self.run(force=paths)

    def wait_for_reindex(self, seconds: float | None = None) -> dict:
        if self._thread is not None:
            self._thread.join(seconds)
        return self._last

    def start_watching(self, events: DataFrame, checkpoint: str, every: str | None = "350 milliseconds"):
        self.live = Live(self.spark, self.store, self.directories, self.exclude)
        if self.encoder is not None and every:
            self.upkeep = VectorUpkeep(self.store, self.build_vectors)
            self.upkeep.start()
        return self.live.start(events, checkpoint, every)

    def close(self) -> None:
        for part in (self.live, self.upkeep):
            if part:
                part.stop()

    # vectors

    def build_vectors(self) -> int:
        """Encode the segments that have no vectors yet, keep the others, and publish if nothing changed meanwhile."""
        if self.encoder is None:
            raise ValueError("no encoder")
        state, segments = self.store.state, self.store.table("segments")
        old = self.store.table("chunks") if state["model_id"] == self.encoder.model_id else self.store.table("chunks").where(F.lit(False))
        todo = segments.join(old.select("segment_row_id"), "segment_row_id", "left_anti")
        pieces = chunked(todo, encoder=self.encoder).withColumn("piece", F.concat_ws(":", "segment_row_id", "start", "end"))
        made = vectors.encode(pieces, "piece", "text", self.encoder).withColumn("p", F.split("piece", ":"))
        new = made.select(F.col("p")[0].cast("long").alias("segment_row_id"), F.col("p")[1].cast("int").alias("start"), F.col("p")[2].cast("int").alias("end"), "vector")
        new = numbered(new, "chunk_id", "segment_row_id", "start", start=state["chunk"])
        return self.store.publish_vectors(old.unionByName(new.select("chunk_id", "segment_row_id", "start", "end", "vector")), self.encoder.model_id, state["revision"])

    # reading

    def searcher(self) -> Searcher:
        revision = self.store.revision
        return Searcher(self.store.table("documents", revision), self.store.table("segments", revision), revision, self.store.index(revision))

    def search_page(self, query: str, options: Options | None = None, cursor: str | None = None, mode: str = "literal", synonyms: dict[str, list[str]] | None = None, scopes: list[dict] | None = None) -> Page:
        """mode: literal, expanded (synonyms, one-edit variants) or hybrid (and vectors)."""
        s, options = self.searcher(), options or Options()
        if mode == "literal":
            return s.page(query, options, cursor)
        if options.regex or not expand.simple_query(query):
            raise ValueError("expanded and hybrid searches take plain words")
        exact = s.ranked(query, options)
        terms = expand.synonyms(query, synonyms or {})
        if not (options.match_case or options.whole_word):
            terms += [r[0] for r in expand.near_words(expand.vocabulary(s.segments), query).collect()]
        chosen = s.documents.where(options.condition()).select("doc_id")
        hits = expand.expansion_hits(s.segments, terms, options.match_case, options.whole_word).join(chosen, "doc_id", "left_semi")
        for scope in scopes or []:
            words = expand.synonyms(query, scope.get("terms", {}))
            if words:
                inside = s.documents.where(expand.in_scope(scope)).select("doc_id")
                hits = hits.union(expand.expansion_hits(s.segments, words, options.match_case, options.whole_word).join(chosen, "doc_id", "left_semi").join(inside, "doc_id", "left_semi"))
                terms += [w for w in words if w not in terms]
        state = self.store.state
        ready = self.encoder is not None and state["model_id"] == self.encoder.model_id and state["vector_revision"] == state["revision"]
        passages = s.segments.select("doc_id", F.lit(0).cast("long").alias("passage"), F.lit(0.0).alias("score")).where(F.lit(False))
        if mode == "hybrid" and ready:
            q = self.encoder.encode(["query: " + query])[0]
            best = vectors.nearest(self.store.table("chunks"), "chunk_id", "vector", q, expand.SEMANTIC_MOST, expand.SEMANTIC_LEAST)
            passages = best.join(self.store.table("chunks"), "chunk_id").join(s.segments, "segment_row_id").join(chosen, "doc_id", "left_semi").select("doc_id", F.col("chunk_id").alias("passage"), "score")
        fused = expand.fused(exact.select("doc_id", "rank_score"), hits, passages)
        page = s.page(query, options, cursor, mode, fused)
        ids = [i["doc_id"] for i in page.items]
        by = {r["doc_id"]: r["matched_by"] for r in fused.where(F.col("doc_id").isin(ids)).select("doc_id", "matched_by").collect()}
        shown: dict[int, list[dict]] = {}
        if ids:  # of the page only
            for r in expand.passages(s.segments.where(F.col("doc_id").isin(ids)), [query, *terms], options.match_case, options.whole_word).orderBy("doc_id", "segment_row_id", "start").collect():
                shown.setdefault(r["doc_id"], []).append({k: v for k, v in r.asDict(recursive=True).items() if k != "doc_id"})
        for item in page.items:
            item["matched_by"], item["passages"] = by.get(item["doc_id"], []), shown.get(item["doc_id"], [])
        page.semantic_ready, page.semantic_candidate_limit = ready, expand.SEMANTIC_MOST if mode == "hybrid" else None
        return page

    def search(self, query: str, formats: list[str] | str | None = None, limit: int = 20, **more) -> dict:
        """A page as plain data."""
        if not query.strip():
            raise ValueError("the query is empty")
        if not 1 <= limit <= 100:
            raise ValueError("limit 1..100")
        cursor, mode, synonyms = more.pop("cursor", None), more.pop("search_mode", "literal"), more.pop("synonyms", None)
        scopes = more.pop("synonym_scopes", None)
        page = self.search_page(query, Options(type_filter=formats, limit=limit, **more), cursor, mode, synonyms, scopes)
        return {"query": query, "result_count": len(page.items), "results": page.items} | {k: v for k, v in asdict(page).items() if k != "items"}

    def match_locations(self, query: str, doc_id: int, **more) -> dict:
        return self.searcher().match_locations(query, doc_id, **more)

    def match_context(self, segment_row_id: int, start: int, end: int, **more) -> dict | None:
        return self.searcher().match_context(segment_row_id, start, end, **more)

    def index_status(self) -> dict:
        d, s = self.store.table("documents"), self.store.table("segments")
        stats = quality.index_stats(d, s).first().asDict()
        return stats | {"quality": {r["parse_status"]: r["n"] for r in quality.quality_counts(d).collect()}, "revision": self.store.revision, "indexing": bool(self._thread and self._thread.is_alive()), "directories": self.directories}

    def problem_documents(self, offset: int = 0, limit: int = 50) -> dict:
        rows = quality.problem_documents(self.store.table("documents"), offset, limit + 1).select("doc_id", "path", "parse_status", "warnings", "error").collect()
        return {"documents": [r.asDict(recursive=True) for r in rows[:limit]], "next_offset": offset + limit if len(rows) > limit else None}

    def document_text(self, path: str) -> str | None:
        doc = self.store.by_path(path)
        row = quality.markdown(doc, self.store.table("segments").join(doc.select("doc_id"), "doc_id", "left_semi")).first()
        return None if row is None else row["markdown"]


__all__ = ["Engine", "Options", "Page", "QueryError"]
