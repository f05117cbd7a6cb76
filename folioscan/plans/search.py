"""Search over documents and segments: a query tree compiled to columns, ranked pages with stable cursors, occurrences of the page only."""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
import threading
import uuid
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import fold as folding
from ..functions.porter import stem
from ..functions.text import is_cjk, literal, phrase_set, query_grams, quoted, word_set
from ..operators import filters, rank, snippets
from ..operators.occurrences import occurrences, with_sources
from .index import TextIndex
from .lookup import FOUND, Lookup
from .querylang import Node, QueryError, filename_term, negative_term, parse


# Fixed value: the segment type of a hit in a file's name.
FILENAME = "檔名"
#: Time that the ranking of a regular expression may take.
REGEX_SECONDS = 10.0


@dataclass
class Options:
    """What a search may be told besides its text."""

    type_filter: str | list[str] | None = None
    limit: int = 200
    modified_after: float | None = None
    modified_before: float | None = None
    min_size: int | None = None
    max_size: int | None = None
    date_field: str = "mtime"
    include_paths: list[str] = field(default_factory=list)
    exclude_patterns: list[str] = field(default_factory=list)
    search_roots: list[str] = field(default_factory=list)
    match_case: bool = False
    whole_word: bool = False
    regex: bool = False

    def unfiltered(self) -> bool:
        """Whether all documents may come out."""
        unset = (None, None, None, None, None, [], [])
        return (self.type_filter, self.modified_after, self.modified_before, self.min_size, self.max_size, self.include_paths, self.exclude_patterns) == unset

    def condition(self) -> Column:
        if self.date_field not in ("mtime", "ctime"):
            raise ValueError("date_field is mtime or ctime")
        return (
            filters.type_group(self.type_filter)
            & filters.time_range(self.modified_after, self.modified_before, self.date_field)
            & filters.size_range(self.min_size, self.max_size)
            & filters.include_paths(self.include_paths)
            & filters.exclude(self.exclude_patterns, roots=self.search_roots)
        )


@dataclass
class Page:
    items: list[dict]
    next_cursor: str | None
    has_more: bool
    total_documents: int
    complete: bool
    revision: int
    retrieval_mode: str = "literal"
    semantic_ready: bool = False
    semantic_candidate_limit: int | None = None


def stem_words(segments: DataFrame, word: str) -> list[str]:
    """The corpus words with the stem of word, where there is no index: the distinct words that begin as it does are read by the JVM and stemmed by the
    executors; only those of the stem come to the driver."""
    root = stem(word)
    shared = os.path.commonprefix([word.lower(), root]) or word[:2].lower()
    pattern = rf"(?i)(?<![\p{{L}}\p{{N}}]){quoted(shared)}[A-Za-z]*(?![\p{{L}}\p{{N}}])"
    found = segments.select(F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).alias("w")).select(F.lower("w").alias("w")).distinct()

    def same(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for w in batch.column(0).to_pylist() if stem(w) == root], pa.string())], ["w"])

    return sorted({r[0] for r in found.mapInArrow(same, "w string").collect()} | {word.lower()})


class Term:
    """How one term is found, ranked and counted."""

    def __init__(self, text: str, options: Options, segments: DataFrame, words=stem_words):
        self.text, spark = text, segments.sparkSession
        exact = options.match_case or options.whole_word
        parts = text.split()
        ascii_word = lambda w: w.isascii() and w.isalpha()
        tokens_ = re.findall(r"[^\W_]+", "".join(f" {c} " if is_cjk(c) else c for c in text))
        flags = 0 if options.match_case else re.IGNORECASE
        body = folding.class_pattern(text, spark)
        wrapped = rf"(?<!\w){body}(?!\w)" if options.whole_word else body
        self.hit = {"kind": "literal", "term": text, "pattern": wrapped, "flags": int(flags)}
        check = F.col("content").rlike(literal(text, options.match_case, options.whole_word, body))
        # the token phrase, by which a term is a candidate and is ranked; each token stands for the corpus words with its stem
        sets = [words(segments, t) if ascii_word(t) and len(t) > 2 else [t] for t in tokens_ if not is_cjk(t[0])]
        self.pattern = None
        if tokens_ and not any(is_cjk(t[0]) for t in tokens_):
            self.pattern = phrase_set(sets) if len(sets) > 1 else word_set(sets[0])
        elif tokens_:
            self.pattern = "(?iu)" + r"[^\p{L}\p{N}]*".join(folding.class_pattern(t, spark) for t in tokens_)
        pairs = query_grams(text)
        if pairs:
            candidate = F.lit(True)  # grams and verification agree: the literal holds all of its pairs
        elif not tokens_ or len(text) <= 2:
            candidate = F.lit(True)
        else:
            candidate = F.col("content").rlike(self.pattern)
        if not exact and ascii_word(text) and len(text) > 2:
            self.condition = candidate
            self.hit = {"kind": "stem", "term": text}
        elif not exact and len(parts) > 1 and all(map(ascii_word, parts)):
            self.condition = F.col("content").rlike(phrase_set([words(segments, p) if len(p) > 2 else [p.lower()] for p in parts]))
            self.hit = {"kind": "phrase", "term": text}
        else:
            self.condition = candidate & check


class Searcher:
    """Searches two tables. With an index of the segments, terms are looked up in it and only candidates' texts are read; without one, and for terms only a
    scan can tell, the texts are scanned and nothing is shuffled before matching. Documents are ranked by one aggregation of the matching segments."""

    def __init__(self, documents: DataFrame, segments: DataFrame, revision: int = 0, index: TextIndex | None = None):
        self.documents, self.segments, self.revision, self.index = documents, segments, revision, index
        self.spark: SparkSession = documents.sparkSession
        self.words = stem_words if index is None else lambda _, word: index.words_of(word)

    @staticmethod
    def fold(tree: Node, conditions: dict[str, Column]) -> tuple[Column, Column]:
        """(matches, contributing terms): a term counts where its path in the tree is true; the right side of NOT never does."""
        empty = F.array().cast("array<string>")

        def leaf(t: str):
            c = conditions[t]
            return c, F.when(c, F.array(F.lit(t))).otherwise(empty)

        def both(op: str, a, b):
            if op == "or":
                return a[0] | b[0], F.array_union(a[1], b[1])
            truth = a[0] & b[0] if op == "and" else a[0] & ~b[0]
            some = F.array_union(a[1], b[1]) if op == "and" else a[1]
            return truth, F.when(truth, some).otherwise(empty)

        return tree.fold(leaf, both)

    def compile(self, tree: Node, options: Options) -> tuple[Column, Column, dict[str, Term]]:
        """(matches, contributing terms, terms) on texts."""
        terms = {t: Term(t, options, self.segments, self.words) for t in tree.terms()}
        return (*self.fold(tree, {t: x.condition for t, x in terms.items()}), terms)

    def hits(self, query: str, options: Options | None = None) -> DataFrame:
        """Matching segments: doc_id, segment_row_id, rank, positive."""
        options = options or Options()
        if options.regex:
            flags = "" if options.match_case else "(?iu)"
            body = rf"(?<!\w)(?:{query})(?!\w)" if options.whole_word else query
            self._valid(body)
            found = self.segments.where(F.col("content").rlike(f"{flags}(?U){body}"))
            return self._filtered(found.withColumn("rank", F.lit(0.0)).withColumn("positive", F.array(F.lit(query))), options)
        tree = parse(query)
        if tree is None:
            return self._filtered(self.segments.where(F.lit(False)).withColumn("rank", F.lit(0.0)).withColumn("positive", F.array().cast("array<string>")), options)
        found = None if self.index is None else self._looked_up(tree, options)
        if found is not None:
            return self._filtered(found, options)
        truth, some, terms = self.compile(tree, options)
        patterns = {str(i): t.pattern for i, t in enumerate(terms.values()) if t.pattern}
        ranked = rank.bm25(self.segments, patterns) if patterns else self.segments.withColumn("rank", F.lit(0.0))
        return self._filtered(ranked.where(truth).withColumn("positive", some), options)

    def _looked_up(self, tree: Node, options: Options) -> DataFrame | None:
        """The hits by the index; None if a term needs a scan. What a tree matches holds at least one of its terms."""
        lookup = Lookup(self.index, self.segments)
        found = {t: lookup.find(t, options.match_case, options.whole_word) for t in tree.terms()}
        if any(f is None for f in found.values()):
            return None
        if len(found) == 1:
            ((only, rows),) = found.items()
            return rows.where("hit").select("doc_id", "segment_row_id", "rank", F.array(F.lit(only)).alias("positive"))
        every = None
        for t, rows in found.items():
            rows = rows.select(*FOUND, F.lit(t).alias("term"))
            every = rows if every is None else every.union(rows)
        # at most one row for each term of the query in a group
        joined = every.groupBy("segment_row_id", "doc_id").agg(F.min("rank").alias("rank"), F.collect_set(F.when(F.col("hit"), F.col("term"))).alias("held"))
        truth, some = self.fold(tree, {t: F.array_contains("held", t) for t in found})
        return joined.where(truth).select("doc_id", "segment_row_id", "rank", some.alias("positive"))

    def _filtered(self, found: DataFrame, options: Options) -> DataFrame:
        found = found.select("doc_id", "segment_row_id", "rank", "positive")
        if options.unfiltered():
            return found  # every segment has its document
        return found.join(self.documents.where(options.condition()).select("doc_id"), "doc_id", "left_semi")

    @staticmethod
    def _valid(pattern: str) -> None:
        try:
            import regex

            regex.compile(pattern)
        except Exception as e:
            raise QueryError("regex_syntax", str(e)) from None

    def filenames(self, name: str, options: Options | None = None) -> DataFrame:
        """Documents whose folded filename holds the folded name."""
        options = options or Options()
        wanted = F.lower(folding.fold("filename", self.spark)).contains(folding.fold_text(name, self.spark).lower())
        check = F.col("filename").rlike(literal(name, options.match_case, options.whole_word, folding.class_pattern(name, self.spark)))
        return self.documents.where(options.condition() & wanted & check)

    def fallback(self, keywords: list[str]) -> DataFrame:
        """Segments whose folded text holds all keywords as they are; a search without index, language and ranking."""
        text, out = F.lower(folding.fold("content", self.spark)), F.lit(True)
        for k in keywords:
            out = out & F.contains(text, F.lit(folding.fold_text(k, self.spark).lower()))
        return self.segments.where(out)

    def _in_time(self, options: Options, run):
        """run(), of regular expressions within REGEX_SECONDS: beyond, its jobs are cancelled and the search ends with an error."""
        if not options.regex:
            return run()
        sc, group, late = self.spark.sparkContext, f"regex-{uuid.uuid4().hex}", threading.Event()

        def end():
            late.set()
            sc.cancelJobGroup(group)

        sc.setJobGroup(group, "regular expression", interruptOnCancel=True)
        timer = threading.Timer(REGEX_SECONDS, end)
        timer.start()
        try:
            out = run()
        except Exception:
            if late.is_set():
                raise QueryError("regex_timeout") from None
            raise
        finally:
            timer.cancel()
            sc.setLocalProperty("spark.jobGroup.id", None)
        if late.is_set():
            raise QueryError("regex_timeout")
        return out

    def without(self, term: str, options: Options | None = None) -> DataFrame:
        """Documents no segment of which matches, those without segments too."""
        options = options or Options()
        known = None if self.index is None else Lookup(self.index, self.segments).find(term, options.match_case, options.whole_word)
        bad = self.segments.where(Term(term, options, self.segments, self.words).condition).select("doc_id") if known is None else known.where("hit").select("doc_id")
        return self.documents.where(options.condition()).join(bad, "doc_id", "left_anti")

    def ranked(self, query: str, options: Options | None = None) -> DataFrame:
        """(doc_id, rank_score, segment_count) of all matching documents."""
        options = options or Options()
        if not options.regex:
            name, none = filename_term(query), negative_term(query)
            if name is not None:
                return self.filenames(name, options).select("doc_id", F.lit(-1000.0).alias("rank_score"), F.lit(0).cast("long").alias("segment_count"))
            if none is not None:
                return self.without(none, options).select("doc_id", F.lit(0.0).alias("rank_score"), F.lit(0).cast("long").alias("segment_count"))
        return rank.documents_ranked(self.hits(query, options))

    # cursors

    def _fingerprint(self, query: str, options: Options, mode: str) -> str:
        return hashlib.sha256(json.dumps([query, asdict(options), mode], sort_keys=True, default=str).encode()).hexdigest()

    def _cursor(self, query: str, options: Options, mode: str, rank_: float, doc: int) -> str:
        return base64.urlsafe_b64encode(json.dumps([self.revision, self._fingerprint(query, options, mode), [rank_, doc]]).encode()).decode()

    def _after(self, cursor: str | None, query: str, options: Options, mode: str) -> tuple[float, int] | None:
        if cursor is None:
            return None
        try:
            revision, print_, (rank_, doc) = json.loads(base64.urlsafe_b64decode(cursor))
        except Exception:
            raise QueryError("stale_cursor") from None
        if revision != self.revision or print_ != self._fingerprint(query, options, mode):
            raise QueryError("stale_cursor")
        return rank_, doc

    def page(self, query: str, options: Options | None = None, cursor: str | None = None, mode: str = "literal", ranked: DataFrame | None = None) -> Page:
        """One page: ids first, texts and snippets only for its documents."""
        options = options or Options()
        after = self._after(cursor, query, options, mode)
        # all matching documents are counted as they pass to the page, in the same job
        total = Observation()
        ranked = (self.ranked(query, options) if ranked is None else ranked).observe(total, F.count(F.lit(1)).alias("n"))
        rows = self._in_time(options, rank.page(ranked, options.limit + 1, after).collect)  # at most limit + 1 rows
        shown, more = rows[: options.limit], len(rows) > options.limit
        items = self._items(shown, query, options)
        last = shown[-1] if more else None
        return Page(items, self._cursor(query, options, mode, last["rank_score"], last["doc_id"]) if last else None, more, total.get["n"], True, self.revision, mode)

    def _items(self, rows: list, query: str, options: Options) -> list[dict]:
        ids = [r["doc_id"] for r in rows]
        if not ids:
            return []
        meta = {r["doc_id"]: r.asDict(recursive=True) for r in self.documents.where(F.col("doc_id").isin(ids)).collect()}
        name = None if options.regex else filename_term(query)
        special = not options.regex and (name is not None or negative_term(query) is not None)
        parts: dict[int, list[dict]] = {}
        if not special:
            found = self.located(query, options, ids).where(F.size("spans") > 0)
            for r in found.select("doc_id", "segment_row_id", "segment_type", "segment_id", F.size("spans").alias("n"), snippets.snippets("content", "spans").alias("shown")).collect():
                parts.setdefault(r["doc_id"], []).append({"segment_row_id": r["segment_row_id"], "location_type": r["segment_type"], "location": r["segment_id"], "match_count": r["n"], "snippets": r["shown"]})
        out = []
        for r in rows:
            m = meta[r["doc_id"]]
            found = sorted(parts.get(r["doc_id"], []), key=lambda x: x["segment_row_id"])
            if name is not None:
                found = [self._named(m["filename"], name, options)]
            out.append({k: m.get(k) for k in ("doc_id", "path", "filename", "file_type", "file_size", "mtime", "ctime", "parse_status", "warnings")} | {"rank_score": r["rank_score"], "segments": found, "total_matches": sum(x["match_count"] for x in found), "segment_count": len(found), "snippet_count": sum(len(x["snippets"]) for x in found), "count_complete": True})
        return out

    def _named(self, filename: str, name: str, options: Options) -> dict:
        """A hit in the name of a file, as one more segment."""
        spans = [m.span() for m in re.finditer(folding.class_pattern(name, self.spark), filename, 0 if options.match_case else re.IGNORECASE)]
        return {"segment_row_id": None, "location_type": FILENAME, "location": filename, "match_count": len(spans), "snippets": snippets.named(filename, spans)}

    def located(self, query: str, options: Options | None = None, ids: list[int] | None = None) -> DataFrame:
        """Matching segments with their texts and merged spans; of the given documents only, if given."""
        options = options or Options()
        segments = self.segments if ids is None else self.segments.where(F.col("doc_id").isin(ids))
        if options.regex:
            hits = Searcher(self.documents, segments, self.revision).hits(query, options).select("segment_row_id", "positive")
            body = rf"(?<!\w)(?:{query})(?!\w)" if options.whole_word else query
            terms = [{"kind": "regex", "term": query, "pattern": body, "flags": 0 if options.match_case else int(re.IGNORECASE)}]
            return occurrences(segments.join(hits, "segment_row_id"), terms, seconds=10)
        tree = parse(query)
        if tree is None:
            return occurrences(segments.where(F.lit(False)), [])
        truth, some, terms = self.compile(tree, options)
        chosen = self.documents.where(options.condition()).select("doc_id")
        rows = segments.where(truth).withColumn("positive", some).join(chosen, "doc_id", "left_semi")
        return occurrences(rows, [t.hit for t in terms.values()], "positive")

    def match_locations(self, query: str, doc_id: int, options: Options | None = None, offset: int = 0, limit: int = 100, revision: int | None = None) -> dict:
        """Locations of one document by their ordinal; the total is exact."""
        if offset < 0 or not 1 <= limit <= 1000:
            raise ValueError("offset at least 0, limit 1..1000")
        if revision is not None and revision != self.revision:
            raise QueryError("stale_cursor")
        rows = with_sources(self.located(query, options, [doc_id]))
        total = rows.count()
        page = rows.where(F.col("ordinal").between(offset + 1, offset + limit)).orderBy("ordinal").collect()
        return {"total": total, "offset": offset, "locations": [r.asDict() for r in page], "has_more": offset + len(page) < total, "revision": self.revision}

    def match_context(self, segment_row_id: int, start: int, end: int, context: int = 120, full: bool = False, offset: int = 0, limit: int = 2048) -> dict | None:
        row = self.segments.where(F.col("segment_row_id") == segment_row_id).select("content").first()
        return None if row is None else snippets.context_of(row["content"], start, end, context, full, offset, limit)
