"""A small folder of files of every kind, and what reading, indexing, searching and updating it must give: queries whose SQL states the expected rows.

The folder and its store are made once for a session, in the folder that driver and executors share.
"""

from __future__ import annotations

import io
import json
import os
import re
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cli import listing
from ..facade import Engine
from ..operators import expand, filters
from ..operators.vectors import HashEncoder
from ..sources import files, shared
from ..streaming.live import EVENT, Live
from .querylang import QueryError
from .search import Options

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), text)
    return out.getvalue()


def _pdf(*pages: str) -> bytes:
    kids = " ".join(f"{10 + i} 0 R" for i in range(len(pages)))
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Kids [{kids}] >>".encode(), 3: b"<< /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding >>"}
    for i, p in enumerate(pages):
        shown = "".join(f"1 0 0 1 72 {700 - 20 * n} Tm ({line}) Tj " for n, line in enumerate(p.split("\n")))
        packed = zlib.compress(f"BT /F 12 Tf {shown}ET".encode("cp1252"))
        objects[10 + i] = f"<< /Type /Page /Contents {50 + i} 0 R /Resources << /Font << /F 3 0 R >> >> >>".encode()
        objects[50 + i] = b"<< /Filter /FlateDecode /Length %d >>\nstream\n%b\nendstream" % (len(packed), packed)
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%b\nendobj\n" % x for x in objects.items()) + b"trailer\n<< /Root 1 0 R >>\n"


_W, _P = 'xmlns:w="w"', 'xmlns:p="p" xmlns:a="a"'
_TEXT = "<a:p><a:r><a:t>{}</a:t></a:r></a:p>"
TREE: dict[str, bytes] = {
    "notes.txt": b"Annual budget\nweekly budget review",
    "wide.txt": "plain wide text".encode("utf-16-le"),
    "marked.txt": "﻿marked text".encode(),
    "old.md": "會議記錄".encode("big5"),
    "table.csv": b"a,b\n1,2",
    "blank.txt": b"  \n ",
    "letter.docx": _zip({"word/document.xml": f"<w:document {_W}><w:body><w:p><w:r><w:t>Dear budget office</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell one</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>", "word/header1.xml": f"<w:hdr {_W}><w:p><w:r><w:t>Head</w:t></w:r></w:p></w:hdr>"}),
    "deck.pptx": _zip({"ppt/slides/slide1.xml": f'<p:sld {_P}><p:cSld><p:spTree><p:sp><p:nvSpPr><p:cNvPr id="2"/></p:nvSpPr>{_TEXT.format("Title")}</p:sp><p:grpSp><p:nvGrpSpPr><p:cNvPr id="3"/></p:nvGrpSpPr><p:sp><p:nvSpPr><p:cNvPr id="4"/></p:nvSpPr>{_TEXT.format("inside")}</p:sp></p:grpSp></p:spTree></p:cSld></p:sld>', "ppt/notesSlides/notesSlide1.xml": f"<p:notes {_P}>{_TEXT.format('say this')}</p:notes>"}),
    "book.xlsx": _zip({"xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="Summary" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<R><x Id="r1" Target="worksheets/sheet1.xml"/></R>', "xl/sharedStrings.xml": "<sst><si><t>shared</t></si></sst>", "xl/worksheets/sheet1.xml": '<w><row><c r="A1" t="s"><v>0</v></c><c r="B1"><f>A1+1</f></c></row><row><c r="A2"><v>7</v></c></row></w>'}),
    "page.pdf": _pdf("First page\nsecond line", "Last page"),
    "secret.pdf": _pdf("x").replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R"),
    "image.png": b"\x89PNG",
    "broken.docx": b"PK\x03\x04 no zip",
    "sub/inner.txt": b"inner budget",
    "drafts/left.txt": b"left out",
    ".hidden.txt": b"no",
    "~$lock.docx": b"no",
    "thumbs.db": b"no",
    "program.exe": b"no",
    "sub/.git/x.txt": b"no",
}
SEEN = ("blank.txt", "book.xlsx", "broken.docx", "deck.pptx", "image.png", "letter.docx", "marked.txt", "notes.txt", "old.md", "page.pdf", "secret.pdf", "sub/inner.txt", "table.csv", "wide.txt")
_states: dict = {}


def values(columns: str, rows: list[tuple]) -> str:
    """SQL of fixed rows. columns: names and types."""
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else repr(v) if isinstance(v, int | float) else "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    names, types = zip(*(c.split() for c in columns.split(", ")))
    cast = {"string": "VARCHAR", "long": "BIGINT", "int": "INT", "boolean": "BOOLEAN", "double": "DOUBLE"}
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"SELECT {', '.join(f'CAST({n} AS {cast[t]}) AS {n}' for n, t in zip(names, types))} FROM (VALUES {body}) AS t({', '.join(names)})"


class State:
    """The folder, its store, and the steps taken on them: read, index, search, change, index again, live batches."""

    def __init__(self, spark: SparkSession):
        self.spark, base = spark, f"{re.sub('^file:/+', '/', shared.work_folder(spark))}/folioscan-sample-{uuid.uuid4().hex[:8]}"
        self.root, self.rows = f"{base}/tree", {}
        for name, data in TREE.items():
            self.put(name, data)
        self.engine = Engine(spark, f"{base}/store", [self.root], ["drafts"], HashEncoder())
        self.steps = [self._read, self._index, self._search, self._update, lambda: self._live(f"{base}/live")]

    def of(self, name: str) -> list[tuple]:
        """The rows of a name; steps are taken as far as they are needed."""
        while name not in self.rows:
            self.steps.pop(0)()
        return self.rows[name]

    def put(self, name: str, data: bytes, at: float = 1.6e9) -> None:
        path = f"{self.root}/{name}"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)
        os.utime(path, (at, at))

    def name(self, path: str) -> str:
        return path.removeprefix(self.root + "/")

    def documents(self) -> list:
        return sorted(self.engine.store.table("documents").collect(), key=lambda r: r["path"])

    def segments(self) -> list[tuple]:
        names = {r["doc_id"]: self.name(r["path"]) for r in self.documents()}
        return sorted((names[r["doc_id"]], r["segment_row_id"], r["content"]) for r in self.engine.store.table("segments").collect())

    def _read(self) -> None:
        found = files.scan(self.spark, [self.root, f"{self.root}/sub"], ["drafts"], content=True)
        rows = files.parsed(found).collect()
        self.rows["src_scan"] = [(self.name(r["path"]), r["file_size"], r["mtime"]) for r in found.collect()]
        self.rows["src_documents"] = [(self.name(r["path"]), r["file_type"], r["parse_status"], r["total_segments"], r["parser_version"]) for r in rows]
        self.rows["src_segments"] = [(self.name(r["path"]), s["segment_id"], s["segment_type"], s["content"]) for r in rows for s in r["segments"]]
        self.rows["src_spans"] = [(self.name(r["path"]), s["segment_id"], x["start"], x["end"], x["kind"], x["location"]) for r in rows for s in r["segments"] for x in s["sources"]]
        self.rows["src_warnings"] = [(self.name(r["path"]), w["code"], w["location"]) for r in rows for w in r["warnings"] or []]
        roots = ["/a/b", "/a", "/a/bc/", "/c"]
        good, bad = files.available([self.root, f"{self.root}/none"])
        self.rows["src_roots"] = [("distinct", r) for r in files.distinct_roots(roots)] + [("available", "tree" if r == self.root else r) for r in good] + [("unavailable", self.name(r)) for r in bad]
        path = f"{self.root}/../synonyms.json"
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"terms": {"budget": ["預算", "estimate"]}, "scopes": [{"file_type": "docx", "terms": {"budget": ["office"]}}]}, f)
        self.terms, self.scopes = expand.read_synonyms(path)
        self.rows["src_synonyms"] = [(q, w) for q in ("budget", "ESTIMATE", "none") for w in expand.synonyms(q, self.terms)]

    def _index(self) -> None:
        report = self.engine.run()
        again = self.engine.run()
        keys = ("indexed", "deleted", "failed", "skipped", "scanned")
        self.rows["run_report"] = [(n, k, int(r[k])) for n, r in (("first", report), ("again", again)) for k in keys]
        self.rows["store_documents"] = [(r["doc_id"], self.name(r["path"]), r["parse_status"], r["total_segments"], r["error"] is not None) for r in self.documents()]
        status = self.engine.index_status()
        self.rows["status_counts"] = [(k, v) for k, v in status["quality"].items()] + [("documents", status["documents"]), ("revision", status["revision"])]
        one = self.engine.problem_documents(0, 2)
        two = self.engine.problem_documents(one["next_offset"], 10)
        self.rows["problem_pages"] = [(n, self.name(d["path"]), d["parse_status"]) for n, p in (("first", one), ("rest", two)) for d in p["documents"]]
        self.rows["path_lookup"] = [(p, self.engine.store.by_path(f"{self.root}/{p}", f"{self.root}/{q}").count()) for p, q in (("notes.txt", "x"), ("gone.txt", "old.md"), ("gone.txt", "x"))]
        doc = self.engine.store.by_path(f"{self.root}/page.pdf").first()["doc_id"]
        self.rows["segments_of"] = [(s["segment_id"], s["content"]) for s in self.engine.store.segments_of(doc).collect()]

    def _search(self) -> None:
        e, out, cursor = self.engine, [], None
        for n in range(1, 4):
            page = e.search("budget", limit=1, cursor=cursor)
            out += [(n, self.name(r["path"]), r["total_matches"], r["segment_count"], r["segments"][0]["snippets"][0], page["total_documents"], page["has_more"]) for r in page["results"]]
            cursor = page["next_cursor"]
        self.rows["search_pages"] = out
        self.rows["search_orders"] = [(q, i, self.name(r["path"])) for q, more in (("NOT budget", {}), ("b.dget", {"regex": True}), ("filename:TXT", {}), ("budget", {"formats": "word"})) for i, r in enumerate(e.search(q, limit=50, **more)["results"], 1)]
        doc = {self.name(r["path"]): r["doc_id"] for r in self.documents()}
        got = e.match_locations("budget", doc["notes.txt"], offset=1, limit=5)
        self.rows["search_locations"] = [(x["ordinal"], x["start"], x["end"], x["source_kind"], x["location"], got["total"], got["has_more"]) for x in got["locations"]]
        segment = e.store.segments_of(doc["notes.txt"]).first()["segment_row_id"]
        self.rows["search_contexts"] = [(n, c["start"], c["end"], c["html"], c["has_more"]) for n, c in (("around", e.match_context(segment, 7, 13, context=3)), ("full", e.match_context(segment, 7, 13, full=True, limit=9)), ("caret", e.match_context(segment, 6, 6, context=2)))]
        page = e.search("budget", search_mode="expanded", synonyms={"budget": ["marked"]}, synonym_scopes=self.scopes)
        self.rows["search_expanded"] = [(i, self.name(r["path"]), ",".join(r["matched_by"]), len(r["passages"]), r["passages"][0]["text"]) for i, r in enumerate(page["results"], 1)]
        self.rows["page_json"] = [(k, type(v).__name__) for k, v in json.loads(json.dumps(e.search("budget", limit=1))).items()]
        self.rows["page_listing"] = [(i, self.name(x) if x.startswith("/") else x) for i, x in enumerate(listing(e.search("inner", limit=1)).splitlines(), 1)]
        self.rows["search_errors"] = [(n, self._error(f)) for n, f in (
            ("operator", lambda: e.search("a AND")), ("bracket", lambda: e.search("(a")), ("cursor", lambda: e.search("weekly", limit=1, cursor=cursor_of(e))), ("regex", lambda: e.search("(", regex=True)),
            ("empty", lambda: e.search(" ")), ("limit", lambda: e.search("a", limit=101)), ("expanded", lambda: e.search("a AND b", search_mode="expanded")), ("locations", lambda: e.match_locations("a", 1, limit=0)), ("sizes", lambda: filters.custom_size(3, 2, "MB")), ("date", lambda: Options(date_field="x").condition()),
        )]

    @staticmethod
    def _error(f) -> str:
        try:
            f()
        except QueryError as x:
            return x.code
        except ValueError:
            return "value"
        return "none"

    def _update(self) -> None:
        e = self.engine
        e.build_vectors()
        before = {r["chunk_id"] for r in e.store.table("chunks").collect()}
        ready = [e.search("budget", search_mode="hybrid")["semantic_ready"]]
        self.put("notes.txt", b"nothing is left of it", 1.7e9)
        self.put("new.txt", b"fresh text", 1.7e9)
        os.remove(f"{self.root}/sub/inner.txt")
        report = e.run()
        self.rows["update_report"] = [(k, int(report[k])) for k in ("indexed", "deleted", "failed", "skipped", "scanned")]
        self.rows["update_segments"] = self.segments()
        self.rows["update_ids"] = [(self.name(r["path"]), r["doc_id"]) for r in self.documents()]
        ready.append(e.search("budget", search_mode="hybrid")["semantic_ready"])
        e.build_vectors()
        after = {r["chunk_id"] for r in e.store.table("chunks").collect()}
        ready.append(e.search("budget", search_mode="hybrid")["semantic_ready"])
        self.rows["vectors_upkeep"] = [("kept", len(before & after)), ("dropped", len(before - after)), ("made", len(after - before)), *((f"ready {i}", int(r)) for i, r in enumerate(ready))]
        force = e.run(force=[f"{self.root}/new.txt", f"{self.root}/none.txt"])
        back = e.run(backfill="ocr_disabled")
        inside = e.run(scope=[f"{self.root}/sub"])
        part = [("forced", force["indexed"]), ("skipped", force["reprocess_skipped"]), ("backfill changed", back["indexed"]), ("scope", inside["scanned"])]
        gone = e.store.delete(self.spark.createDataFrame([(f"{self.root}/table.csv",)], "path string"))
        part += [("deleted", int(gone == e.store.revision)), ("left", e.store.table("documents").count())]
        os.rename(self.root, self.root + "-away")
        away = e.run()
        part += [("unavailable", len(away["unavailable_directories"])), ("preserved", e.store.table("documents").count())]
        os.rename(self.root + "-away", self.root)
        cleared = e.store.clear()
        part += [("cleared", e.store.table("documents").count()), ("cleared again", int(e.store.clear() == cleared))]
        e.run()
        part += [("next id", min(r["doc_id"] for r in self.documents()))]
        self.rows["index_steps"] = part

    def _live(self, folder: str) -> None:
        store, seen = Engine(self.spark, folder).store, []
        live = Live(self.spark, store, [self.root], ["drafts"], reconcile=0, changed=seen.append)
        names = lambda: ",".join(sorted(self.name(r["path"]) for r in store.table("documents").collect()))
        batch = lambda *rows: self.spark.createDataFrame([(f"{self.root}/{p}", k, None) for p, k in rows], EVENT)
        out = []
        live.apply(batch(("notes.txt", "created"), ("notes.txt", "modified"), ("drafts/left.txt", "created"), ("gone.txt", "created"), (".hidden.txt", "created")))
        out.append(("named", live.generation, names()))
        live.apply(batch(("wide.txt", "modified"), ("new.txt", "modified")))
        out.append(("more", live.generation, names()))
        os.remove(f"{self.root}/new.txt")
        live.apply(batch(("new.txt", "deleted")))
        out.append(("deleted", live.generation, names()))
        live.apply(batch())
        out.append(("nothing", live.generation, names()))
        live.configure([f"{self.root}/sub"])
        live.apply(batch(("wide.txt", "modified")))
        out.append(("other scope", live.generation, names()))
        self.rows["live_batches"] = out


def cursor_of(e: Engine) -> str:
    return e.search("budget", limit=1)["next_cursor"]


def state(spark: SparkSession) -> State:
    key = spark.sparkContext.applicationId
    if key not in _states:
        _states[key] = State(spark)
    return _states[key]


def expected(name: str, columns: str, rows: list[tuple]) -> None:
    """A query of the State's rows, and the rows that must come out."""
    QUERIES[name] = lambda spark, _dir: spark.createDataFrame(state(spark).of(name), columns)
    SQL[name] = values(columns, rows)


expected(
    "src_scan",
    "name string, file_size long, mtime double",
    [
        ('blank.txt', 4, 1600000000.0),
        ('book.xlsx', 766, 1600000000.0),
        ('broken.docx', 11, 1600000000.0),
        ('deck.pptx', 681, 1600000000.0),
        ('image.png', 4, 1600000000.0),
        ('letter.docx', 491, 1600000000.0),
        ('marked.txt', 14, 1600000000.0),
        ('notes.txt', 34, 1600000000.0),
        ('old.md', 8, 1600000000.0),
        ('page.pdf', 662, 1600000000.0),
        ('secret.pdf', 430, 1600000000.0),
        ('sub/inner.txt', 12, 1600000000.0),
        ('table.csv', 7, 1600000000.0),
        ('wide.txt', 30, 1600000000.0),
    ],
)
expected(
    "src_documents",
    "name string, file_type string, parse_status string, total_segments int, parser_version string",
    [
        ('blank.txt', 'txt', 'empty', 0, '1'),
        ('book.xlsx', 'xlsx', 'partial', 1, '3'),
        ('broken.docx', 'docx', 'corrupt', 0, '2'),
        ('deck.pptx', 'pptx', 'success', 1, '3'),
        ('image.png', 'png', 'empty', 0, '1'),
        ('letter.docx', 'docx', 'success', 2, '2'),
        ('marked.txt', 'txt', 'success', 1, '1'),
        ('notes.txt', 'txt', 'success', 1, '1'),
        ('old.md', 'md', 'success', 1, '1'),
        ('page.pdf', 'pdf', 'success', 2, '3'),
        ('secret.pdf', 'pdf', 'encrypted', 0, '3'),
        ('sub/inner.txt', 'txt', 'success', 1, '1'),
        ('table.csv', 'csv', 'success', 1, '1'),
        ('wide.txt', 'txt', 'success', 1, '1'),
    ],
)
expected(
    "src_segments",
    "name string, segment_id string, segment_type string, content string",
    [
        ('book.xlsx', 'Summary', 'sheet', 'shared | =A1+1\n7'),
        ('deck.pptx', '1', 'slide', 'Title\ninside\n[Note] say this'),
        ('letter.docx', '1', 'section', 'Dear budget office\ncell one'),
        ('letter.docx', '2', 'section', 'Head'),
        ('marked.txt', '1', 'section', 'marked text'),
        ('notes.txt', '1', 'section', 'Annual budget\nweekly budget review'),
        ('old.md', '1', 'section', '會議記錄'),
        ('page.pdf', '1', 'page', 'First page\nsecond line'),
        ('page.pdf', '2', 'page', 'Last page'),
        ('sub/inner.txt', '1', 'section', 'inner budget'),
        ('table.csv', '1', 'section', 'a,b\n1,2'),
        ('wide.txt', '1', 'section', 'plain wide text'),
    ],
)
expected(
    "src_spans",
    "name string, segment_id string, span_start int, span_end int, kind string, location string",
    [
        ('book.xlsx', 'Summary', 0, 6, 'cell', 'Summary!A1'),
        ('book.xlsx', 'Summary', 15, 16, 'cell', 'Summary!A2'),
        ('book.xlsx', 'Summary', 9, 14, 'formula', 'Summary!B1'),
        ('deck.pptx', '1', 0, 5, 'shape', 'slide 1 slide shape 2'),
        ('deck.pptx', '1', 13, 28, 'notes', 'slide 1 notes'),
        ('deck.pptx', '1', 6, 12, 'shape', 'slide 1 slide shape 3/4'),
        ('letter.docx', '1', 0, 18, 'section', 'body'),
        ('letter.docx', '1', 19, 27, 'section', 'table r1c1'),
        ('letter.docx', '2', 0, 4, 'section', 'header'),
        ('marked.txt', '1', 0, 11, 'section', 'body'),
        ('notes.txt', '1', 0, 34, 'section', 'body'),
        ('old.md', '1', 0, 4, 'section', 'body'),
        ('page.pdf', '1', 0, 22, 'native', 'page 1'),
        ('page.pdf', '2', 0, 9, 'native', 'page 2'),
        ('sub/inner.txt', '1', 0, 12, 'section', 'body'),
        ('table.csv', '1', 0, 7, 'section', 'body'),
        ('wide.txt', '1', 0, 15, 'section', 'body'),
    ],
)
expected(
    "src_warnings",
    "name string, code string, location string",
    [
        ('book.xlsx', 'missing_cached_result', 'Summary!B1'),
        ('image.png', 'ocr_disabled', 'image'),
    ],
)
expected(
    "src_roots",
    "kind string, root string",
    [
        ('distinct', '/a'),
        ('distinct', '/c'),
        ('available', 'tree'),
        ('unavailable', 'none'),
    ],
)
expected(
    "src_synonyms",
    "query string, word string",
    [
        ('budget', '預算'),
        ('budget', 'estimate'),
        ('ESTIMATE', 'budget'),
        ('ESTIMATE', '預算'),
    ],
)
expected(
    "run_report",
    "run string, what string, n int",
    [
        ('first', 'indexed', 14),
        ('first', 'deleted', 0),
        ('first', 'failed', 2),
        ('first', 'skipped', 0),
        ('first', 'scanned', 14),
        ('again', 'indexed', 0),
        ('again', 'deleted', 0),
        ('again', 'failed', 2),
        ('again', 'skipped', 14),
        ('again', 'scanned', 14),
    ],
)
expected(
    "store_documents",
    "doc_id long, name string, parse_status string, total_segments int, failed boolean",
    [
        (1, 'blank.txt', 'empty', 0, False),
        (2, 'book.xlsx', 'partial', 1, False),
        (3, 'broken.docx', 'corrupt', 0, True),
        (4, 'deck.pptx', 'success', 1, False),
        (5, 'image.png', 'empty', 0, False),
        (6, 'letter.docx', 'success', 2, False),
        (7, 'marked.txt', 'success', 1, False),
        (8, 'notes.txt', 'success', 1, False),
        (9, 'old.md', 'success', 1, False),
        (10, 'page.pdf', 'success', 2, False),
        (11, 'secret.pdf', 'encrypted', 0, True),
        (12, 'sub/inner.txt', 'success', 1, False),
        (13, 'table.csv', 'success', 1, False),
        (14, 'wide.txt', 'success', 1, False),
    ],
)
expected(
    "status_counts",
    "what string, n long",
    [
        ('corrupt', 1),
        ('documents', 14),
        ('empty', 2),
        ('encrypted', 1),
        ('partial', 1),
        ('revision', 1),
        ('success', 9),
    ],
)
expected(
    "problem_pages",
    "page string, name string, parse_status string",
    [
        ('first', 'blank.txt', 'empty'),
        ('first', 'book.xlsx', 'partial'),
        ('rest', 'broken.docx', 'corrupt'),
        ('rest', 'image.png', 'empty'),
        ('rest', 'secret.pdf', 'encrypted'),
    ],
)
expected(
    "path_lookup",
    "name string, n int",
    [
        ('notes.txt', 1),
        ('gone.txt', 1),
        ('gone.txt', 0),
    ],
)
expected(
    "segments_of",
    "segment_id string, content string",
    [
        ('1', 'First page\nsecond line'),
        ('2', 'Last page'),
    ],
)
expected(
    "search_pages",
    "page int, name string, matches int, segments int, snippet string, total int, more boolean",
    [
        (1, 'notes.txt', 2, 1, 'Annual <mark>budget</mark>\nweekly <mark>budget</mark> review', 3, True),
        (2, 'sub/inner.txt', 1, 1, 'inner <mark>budget</mark>', 3, True),
        (3, 'letter.docx', 1, 1, 'Dear <mark>budget</mark> office\ncell one', 3, False),
    ],
)
expected(
    "search_orders",
    "query string, place int, name string",
    [
        ('NOT budget', 1, 'blank.txt'),
        ('NOT budget', 2, 'book.xlsx'),
        ('NOT budget', 3, 'broken.docx'),
        ('NOT budget', 4, 'deck.pptx'),
        ('NOT budget', 5, 'image.png'),
        ('NOT budget', 6, 'marked.txt'),
        ('NOT budget', 7, 'old.md'),
        ('NOT budget', 8, 'page.pdf'),
        ('NOT budget', 9, 'secret.pdf'),
        ('NOT budget', 10, 'table.csv'),
        ('NOT budget', 11, 'wide.txt'),
        ('b.dget', 1, 'letter.docx'),
        ('b.dget', 2, 'notes.txt'),
        ('b.dget', 3, 'sub/inner.txt'),
        ('filename:TXT', 1, 'blank.txt'),
        ('filename:TXT', 2, 'marked.txt'),
        ('filename:TXT', 3, 'notes.txt'),
        ('filename:TXT', 4, 'sub/inner.txt'),
        ('filename:TXT', 5, 'wide.txt'),
        ('budget', 1, 'letter.docx'),
    ],
)
expected(
    "search_locations",
    "ordinal int, span_start int, span_end int, kind string, location string, total int, more boolean",
    [
        (2, 21, 27, 'section', 'body', 2, False),
    ],
)
expected(
    "search_contexts",
    "what string, span_start int, span_end int, html string, more boolean",
    [
        ('around', 4, 16, '...al <mark>budget</mark>\nwe...', True),
        ('full', 0, 9, 'Annual <mark>bu</mark>...', True),
        ('caret', 4, 8, '...al<span class="zero-width">│</span> b...', True),
    ],
)
expected(
    "search_expanded",
    "place int, name string, matched_by string, passages int, passage string",
    [
        (1, 'letter.docx', 'exact,expanded', 1, 'Dear budget office\ncell one'),
        (2, 'notes.txt', 'exact', 1, 'Annual budget\nweekly budget review'),
        (3, 'sub/inner.txt', 'exact', 1, 'inner budget'),
        (4, 'marked.txt', 'expanded', 1, 'marked text'),
    ],
)
expected(
    "page_json",
    "what string, kind string",
    [
        ('query', 'str'),
        ('result_count', 'int'),
        ('results', 'list'),
        ('next_cursor', 'str'),
        ('has_more', 'bool'),
        ('total_documents', 'int'),
        ('complete', 'bool'),
        ('revision', 'int'),
        ('retrieval_mode', 'str'),
        ('semantic_ready', 'bool'),
        ('semantic_candidate_limit', 'NoneType'),
    ],
)
expected(
    "page_listing",
    "line int, text string",
    [
        (1, 'sub/inner.txt  (1)'),
        (2, '    inner budget'),
    ],
)
expected(
    "search_errors",
    "what string, code string",
    [
        ('operator', 'operator_position'),
        ('bracket', 'none'),
        ('cursor', 'stale_cursor'),
        ('regex', 'regex_syntax'),
        ('empty', 'value'),
        ('limit', 'value'),
        ('expanded', 'value'),
        ('locations', 'value'),
        ('sizes', 'value'),
        ('date', 'value'),
    ],
)
expected(
    "update_report",
    "what string, n int",
    [
        ('indexed', 2),
        ('deleted', 1),
        ('failed', 2),
        ('skipped', 12),
        ('scanned', 14),
    ],
)
expected(
    "update_segments",
    "name string, segment_row_id long, content string",
    [
        ('book.xlsx', 1, 'shared | =A1+1\n7'),
        ('deck.pptx', 2, 'Title\ninside\n[Note] say this'),
        ('letter.docx', 3, 'Dear budget office\ncell one'),
        ('letter.docx', 4, 'Head'),
        ('marked.txt', 5, 'marked text'),
        ('new.txt', 14, 'fresh text'),
        ('notes.txt', 13, 'nothing is left of it'),
        ('old.md', 7, '會議記錄'),
        ('page.pdf', 8, 'First page\nsecond line'),
        ('page.pdf', 9, 'Last page'),
        ('table.csv', 11, 'a,b\n1,2'),
        ('wide.txt', 12, 'plain wide text'),
    ],
)
expected(
    "update_ids",
    "name string, doc_id long",
    [
        ('blank.txt', 1),
        ('book.xlsx', 2),
        ('broken.docx', 3),
        ('deck.pptx', 4),
        ('image.png', 5),
        ('letter.docx', 6),
        ('marked.txt', 7),
        ('new.txt', 15),
        ('notes.txt', 8),
        ('old.md', 9),
        ('page.pdf', 10),
        ('secret.pdf', 11),
        ('table.csv', 13),
        ('wide.txt', 14),
    ],
)
expected(
    "vectors_upkeep",
    "what string, n int",
    [
        ('kept', 10),
        ('dropped', 2),
        ('made', 2),
        ('ready 0', 1),
        ('ready 1', 0),
        ('ready 2', 1),
    ],
)
expected(
    "index_steps",
    "what string, n long",
    [
        ('forced', 1),
        ('skipped', 1),
        ('backfill changed', 0),
        ('scope', 0),
        ('deleted', 1),
        ('left', 13),
        ('unavailable', 1),
        ('preserved', 13),
        ('cleared', 0),
        ('cleared again', 1),
        ('next id', 16),
    ],
)
expected(
    "live_batches",
    "what string, generation int, names string",
    [
        ('named', 1, 'notes.txt'),
        ('more', 2, 'new.txt,notes.txt,wide.txt'),
        ('deleted', 3, 'notes.txt,wide.txt'),
        ('nothing', 3, 'notes.txt,wide.txt'),
        ('other scope', 4, ''),
    ],
)
