import io
import json
import os
import struct
import time
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from folioscan import mcp
from folioscan.config import Settings
from folioscan.facade import Engine
from folioscan.operators.changes import debounced, diff, log_state
from folioscan.operators.vectors import HashEncoder, OnnxEncoder, model_id
from folioscan.sources import files, ocr, parsers
from folioscan.sources.decode import decode
from folioscan.sources import store as store_module
from folioscan.sources.store import Store, StoreError
from folioscan.streaming.live import EVENT, Live, Stopped, VectorUpkeep, bursts, change_rates, event_log


@pytest.mark.parametrize("encoding", ["utf-8-sig", "utf-16", "utf-32", "utf-8", "big5", "utf-16-le"])
def test_decode(encoding):
    text = "會議記錄 plain text of some length" if encoding != "utf-16-le" else "plain text of some length"
    assert decode(text.encode(encoding)) == text


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="w"'
DOCX = zipped({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>Hello</w:t></w:r><w:r><w:t> world</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>", "word/header1.xml": f"<w:hdr {W}><w:p><w:r><w:t>Head</w:t></w:r></w:p></w:hdr>"})
PPTX = zipped({"ppt/slides/slide2.xml": '<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>Two</a:t></a:r></a:p></p:sld>', "ppt/slides/slide1.xml": '<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>One</a:t></a:r></a:p></p:sld>', "ppt/notesSlides/notesSlide1.xml": '<p:n xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>say</a:t></a:r></a:p></p:n>'})
XLSX = zipped({"xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="Summary" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<R><x Id="r1" Target="worksheets/sheet1.xml"/></R>', "xl/sharedStrings.xml": "<sst><si><t>shared</t></si></sst>", "xl/worksheets/sheet1.xml": '<w><row><c r="A1" t="s"><v>0</v></c><c r="B1"><f>A1+1</f></c></row></w>'})


def test_parsers():
    d = parsers.parse("docx", DOCX)
    assert d.status == "success" and d.segments[0]["content"] == "Hello world\ncell" and d.segments[0]["sources"][1]["location"] == "table r1c1" and d.segments[1]["content"] == "Head"
    p = parsers.parse("pptx", PPTX)
    assert [s["content"] for s in p.segments] == ["One\n[Note] say", "Two"]
    x = parsers.parse("xlsx", XLSX)
    assert x.segments[0]["content"] == "shared | =A1+1" and x.warnings[0]["code"] == "missing_cached_result" and x.status == "partial"
    assert parsers.parse("docx", DOCX[:60]).status == "corrupt" and parsers.parse("docx", parsers.OLE).status == "encrypted"
    assert parsers.parse("pdf", b"x").status == "corrupt" and parsers.parse("xls", b"x").status == "corrupt" and parsers.parse("exe", b"x").status == "unsupported" and parsers.parse("txt", None).status == "unreadable"
    assert parsers.parse("txt", b"  ").status == "empty" and parsers.parse("png", b"x").warnings[0]["code"] == "ocr_disabled"
    for s in d.segments + x.segments:
        assert all(0 <= a["start"] < a["end"] <= len(s["content"]) for a in s["sources"])


def compound(streams):
    """A compound file of streams of 4,096 bytes and more."""
    size, fat, body, heads = 512, [], b"", []
    for name, data in streams.items():
        data = data.ljust(4096, b"\0")
        n = -(-len(data) // size)
        heads.append((name, len(fat), len(data)))
        fat += [*range(len(fat) + 1, len(fat) + n), 0xFFFFFFFE]
        body += data.ljust(n * size, b"\0")
    entry = lambda name, kind, first, length: name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<IQ", first, length)
    nodes = entry("Root Entry", 5, 0xFFFFFFFE, 0) + b"".join(entry(n, 2, f, x) for n, f, x in heads)
    nodes = nodes.ljust(-(-len(nodes) // size) * size, b"\0")
    first = len(fat)
    fat += [*range(first + 1, first + len(nodes) // size), 0xFFFFFFFE]
    table = len(fat)
    fat += [0xFFFFFFFD]
    assert len(fat) <= 128
    head = parsers.OLE + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIII", 0, 1, first, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    head += struct.pack("<109I", table, *[0xFFFFFFFF] * 108)
    return head + body + nodes + struct.pack("<128I", *fat, *[0xFFFFFFFF] * (128 - len(fat)))


def biff(kind, data=b""):
    return struct.pack("<HH", kind, len(data)) + data


def workbook(extra=b""):
    sst = biff(0xFC, struct.pack("<II", 2, 2) + struct.pack("<HB", 5, 0) + b"hello" + struct.pack("<HB", 4, 1) + "會議".encode("utf-16-le")) + biff(0x3C, b"\x01" + "記錄".encode("utf-16-le"))
    first = biff(0x809, b"\0" * 16) + extra
    name = struct.pack("<BB", 5, 0) + b"Sheet"
    start = len(first) + 4 + 6 + len(name) + len(sst) + 4
    cells = biff(0x809, b"\0" * 16) + biff(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)) + biff(0xFD, struct.pack("<HHHI", 0, 27, 0, 1)) + biff(0x203, struct.pack("<HHHd", 1, 0, 0, 2.5)) + biff(0x27E, struct.pack("<HHHI", 1, 1, 0, 7 << 2 | 2))
    cells += biff(0xBD, struct.pack("<HHHIHIH", 2, 0, 0, 100 << 2 | 3, 0, 3 << 2 | 2, 1)) + biff(0x06, struct.pack("<HHH", 3, 0, 0) + b"\0" * 6 + b"\xff\xff" + b"\0" * 6) + biff(0x207, struct.pack("<HB", 3, 0) + b"abc") + biff(0x0A)
    return first + biff(0x85, struct.pack("<IH", start, 0) + name) + sst + biff(0x0A) + cells


def test_old_office():
    x = parsers.parse("xls", compound({"Workbook": workbook()}))
    assert x.status == "success" and x.segments[0]["segment_id"] == "Sheet" and x.segments[0]["content"] == "hello | 會議記錄\n2.5 | 7.0\n1.0 | 3.0\nabc"
    assert x.segments[0]["sources"][1]["location"] == "Sheet!AB1"
    assert parsers.parse("xls", compound({"Workbook": workbook(biff(0x2F, b"\0" * 6))})).status == "encrypted"
    word = "Minutes of the board".encode("utf-16-le") + b"\0\1\2" + "會議記錄內容".encode("utf-16-le")
    d = parsers.parse("doc", compound({"WordDocument": word, "Other": b"noise that is not read"}))
    assert d.status == "success" and d.segments[0]["content"].split("\n")[0] == "Minutes of the board" and "會議記錄內容" in d.segments[0]["content"] and "noise" not in d.segments[0]["content"]
    assert "all streams" in parsers.parse("doc", compound({"Other": b"all streams are read"})).segments[0]["content"]
    assert "just text" in parsers.parse("doc", b"{\\rtf1 just text}").segments[0]["content"]
    p = parsers.parse("ppt", compound({"PowerPoint Document": "Slide text".encode("utf-16-le") + b"\0\1" + "Arial".encode("utf-16-le")}))
    assert p.segments[0]["content"] == "Slide text" and p.segments[0]["segment_type"] == "slide" and parsers.parse("ppt", b"x").status == "corrupt"


def pdf_of(objects, extra=b""):
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%b\nendobj\n" % x for x in objects.items()) + b"trailer\n<< /Root 1 0 R " + extra + b">>\n"


def packed(data, more=b""):
    z = zlib.compress(data)
    return b"<< /Filter /FlateDecode /Length %d %b >>\nstream\n%b\nendstream" % (len(z), more, z)


def test_pdf():
    cmap = b"1 beginbfchar <0001> <6703> endbfchar 1 beginbfrange <0002> <0003> <8B70> endbfrange"
    shown = b"BT /F1 12 Tf 72 700 Td (Hello \\(PDF\\) \\351t\\351) Tj 0 -20 Td [(wor) -20 (ld) -300 (x)] TJ ET q 1 0 0 1 0 20 cm BT /F2 12 Tf 1 0 0 1 72 700 Tm <00010002> Tj ET Q BT /F1 12 Tf 1 0 0 1 300 700 Tm (right) Tj ET /X Do"
    inside = b"4 0 3 60 << /Type /Pages /Kids [10 0 R 11 0 R 12 0 R] >> << /Subtype /Type0 /ToUnicode 8 0 R >>"
    heads = b"2 0 4 %d " % (inside.index(b"<< /Subtype") - inside.index(b"<< /Type"))
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        9: packed(heads + inside[inside.index(b"<< /Type") :], b"/Type /ObjStm /N 2 /First %d" % len(heads)),
        5: b"<< /Subtype /Type1 /Encoding /WinAnsiEncoding >>", 8: packed(cmap), 7: packed(shown),
        6: packed(b"BT /F1 12 Tf 72 600 Td (in a form) Tj ET", b"/Subtype /Form"),
        10: b"<< /Type /Page /Contents [7 0 R] /Resources << /Font << /F1 5 0 R /F2 4 0 R >> /XObject << /X 6 0 R >> >> >>",
        11: b"<< /Type /Page /Contents 20 0 R >>", 12: b"<< /Type /Page /Resources << /XObject << /I 13 0 R >> >> >>",
        13: b"<< /Subtype /Image /Length 1 >>\nstream\nx\nendstream", 20: b"<< /Filter /FlateDecode /Length 3 >>\nstream\nbad\nendstream",
    }
    r = parsers.parse("pdf", pdf_of(objects))
    assert r.segments[0]["content"] == "會議\nHello (PDF) été right\nworld x\nin a form" and len(r.segments) == 1 and r.status == "partial"
    assert [(w["code"], w["location"]) for w in r.warnings] == [("page_failed", "page 2"), ("ocr_disabled", "page 3")]
    assert parsers.parse("pdf", pdf_of(objects, b"/Encrypt 9 0 R ")).status == "encrypted" and parsers.parse("pdf", b"").status == "corrupt"


def test_slides_inherit_decorations():
    shape = lambda i, t, ph="": f'<p:sp><p:nvSpPr><p:cNvPr id="{i}"/><p:nvPr>{ph}</p:nvPr></p:nvSpPr><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:sp>'
    part = lambda tag, *s, more="": f'<p:{tag} xmlns:p="p" xmlns:a="a" {more}><p:cSld><p:spTree>{"".join(s)}</p:spTree></p:cSld></p:{tag}>'
    links = lambda kind, to: f'<R><r Type="x/{kind}" Target="{to}"/></R>'
    table = '<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="9"/></p:nvGraphicFramePr><a:tbl><a:tr><a:tc><a:p><a:r><a:t>c1</a:t></a:r></a:p></a:tc><a:tc><a:p><a:r><a:t>c2</a:t></a:r></a:p></a:tc></a:tr></a:tbl></p:graphicFrame>'
    parts = {"ppt/slides/slide1.xml": part("sld", shape(2, "Title"), table), "ppt/slides/_rels/slide1.xml.rels": links("slideLayout", "../slideLayouts/l.xml"), "ppt/slideLayouts/l.xml": part("sldLayout", shape(3, "Prompt", "<p:ph/>"), shape(4, "Logo")), "ppt/slideLayouts/_rels/l.xml.rels": links("slideMaster", "../slideMasters/m.xml"), "ppt/slideMasters/m.xml": part("sldMaster", shape(5, "Footer"))}
    r = parsers.parse("pptx", zipped(parts))
    assert r.segments[0]["content"] == "Title | c1 | c2\nLogo\nFooter" and r.segments[0]["sources"][2]["location"] == "slide 1 slide shape 9 r1c2"
    parts["ppt/slides/slide1.xml"] = part("sld", shape(2, "Title"), more='showMasterSp="0"')
    assert parsers.parse("pptx", zipped(parts)).segments[0]["content"] == "Title\nLogo"


def test_recognition(tmp_path):
    program = tmp_path / "recognise"
    program.write_text("#!/bin/sh\nprintf 'level\\tpage_num\\tblock_num\\tpar_num\\tline_num\\tword_num\\tleft\\ttop\\twidth\\theight\\tconf\\ttext\\n5\\t1\\t1\\t1\\t1\\t1\\t0\\t0\\t10\\t10\\t90\\tHello\\n5\\t1\\t1\\t1\\t1\\t2\\t20\\t0\\t10\\t10\\t90\\tscan\\n5\\t2\\t1\\t1\\t1\\t1\\t0\\t0\\t10\\t10\\t90\\tframe\\n'")
    program.chmod(0o755)
    r = ocr.Recogniser(str(program)).parse(b"image")
    assert [(s["segment_id"], s["content"]) for s in r.segments] == [("1", "Hello scan"), ("2", "frame")] and r.status == "success"
    program.write_text("#!/bin/sh\nsleep 5")
    assert ocr.Recogniser(str(program), seconds=0).parse(b"x").warnings[0]["code"] == "ocr_failed"
    assert ocr.Recogniser("/none").seconds == 30 and ocr.Recogniser(seconds=900).seconds == 120
    words = ocr.Recogniser(str(tmp_path / "x")) and [{"left": 0, "top": 0, "width": 10, "height": 10}, {"left": 50, "top": 0, "width": 10, "height": 10}]
    assert ocr.overlapping(words, [(0, 0, 6, 10)]) == words[1:] and ocr.overlapping(words, [(0, 0, 2, 10)]) == words


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "docs"
    (root / "sub").mkdir(parents=True)
    (root / ".git").mkdir()
    (root / "a.txt").write_text("the annual budget")
    (root / "sub" / "b.md").write_text("weekly 會議 budget review")
    (root / "c.docx").write_bytes(DOCX)
    (root / "bad.docx").write_bytes(DOCX[:50])
    for name in ("~$t.docx", ".hidden.txt", "x.exe", ".git/y.txt"):
        (root / name).write_text("no")
    return root


def test_index_search_update(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), [str(tree)], ["skip"], HashEncoder())
    r = e.run()
    assert (r["indexed"], r["deleted"], r["failed"]) == (4, 0, 1) and e.store.revision == 1
    assert e.run()["skipped"] == 4 and e.store.revision == 1
    assert {os.path.basename(x["path"]) for x in e.search("budget")["results"]} == {"a.txt", "b.md"}
    ids = {r["path"]: r["doc_id"] for r in e.store.table("documents").collect()}
    (tree / "a.txt").write_text("nothing here, a longer text")
    (tree / "sub" / "b.md").unlink()
    r = e.run()
    assert (r["indexed"], r["deleted"]) == (1, 1) and e.search("budget")["results"] == []
    after = {r["path"]: r["doc_id"] for r in e.store.table("documents").collect()}
    assert all(ids[p] == i for p, i in after.items()) and len(after) == 3
    assert e.store.table("segments").agg(F.max("segment_row_id")).first()[0] > 3
    status = e.index_status()
    assert status["documents"] == 3 and status["quality"]["corrupt"] == 1
    assert e.problem_documents()["documents"][0]["parse_status"] == "corrupt"
    assert "longer text" in e.document_text(str(tree / "a.txt"))
    assert e.build_vectors() == e.store.revision and e.search("text", search_mode="hybrid")["semantic_ready"]
    page = e.search("committee", search_mode="expanded", synonyms={"committee": ["longer"]}, synonym_scopes=[{"file_type": "docx", "terms": {"committee": ["hello"]}}])
    assert [(os.path.basename(r["path"]), r["matched_by"]) for r in page["results"]] == [("a.txt", ["expanded"]), ("c.docx", ["expanded"])] and page["results"][0]["passages"]
    n = e.store.table("chunks").count()
    assert n == e.store.table("chunks").select("chunk_id").distinct().count() >= 3
    with pytest.raises(StoreError):
        e.store.publish_vectors(e.store.table("chunks"), "m", 0)
    assert e.run(force=[str(tree / "a.txt"), "/none"])["reprocess_skipped"] == 1
    e.store.clear()
    assert e.store.table("documents").count() == 0 and e.store.clear() == e.store.revision


def test_unavailable_roots_are_preserved(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), [str(tree)])
    e.run()
    tree.rename(tmp_path / "away")
    r = e.run()
    assert r["deleted"] == 0 and r["unavailable_directories"] and e.store.table("documents").count() == 4


def test_scan_rules(spark, tree):
    get = lambda **k: sorted(os.path.basename(r["path"]) for r in files.scan(spark, [str(tree), str(tree / "sub")], **k).collect())
    assert get() == ["a.txt", "b.md", "bad.docx", "c.docx"] and get(patterns=["sub"]) == ["a.txt", "bad.docx", "c.docx"] and get(patterns=["*.docx"]) == ["a.txt", "b.md"]
    assert get(subdirectories=False) == ["a.txt", "bad.docx", "c.docx"] and files.distinct_roots(["/a", "/a/b", "/a"]) == ["/a"]


def test_newer_store_is_refused(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    (tmp_path / "s" / "manifest" / "1.json").write_text(json.dumps({"format": 99, "revision": 1}))
    with pytest.raises(StoreError) as e:
        s.revision  # noqa: B018
    assert e.value.code == "too_new"


def test_live(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    seen = []
    live = Live(spark, store, [str(tree)], changed=seen.append)
    events = tmp_path / "events"
    events.mkdir()
    write = lambda n, rows: (events / n).write_text("\n".join(json.dumps({"path": str(p), "kind": k, "at": "2024-01-01 00:00:00"}) for p, k in rows))
    write("1.json", [(tree / "a.txt", "created"), (tree / "a.txt", "modified"), (tree / "gone.txt", "created")])
    live.start(event_log(spark, str(events)), str(tmp_path / "cp"), None).awaitTermination()
    assert [r["filename"] for r in store.table("documents").collect()] == ["a.txt"] and live.generation == 1
    (tree / "a.txt").unlink()
    write("2.json", [(tree / "a.txt", "deleted")])
    live.start(event_log(spark, str(events)), str(tmp_path / "cp"), None).awaitTermination()
    assert store.table("documents").count() == 0 and live.generation == 2 and seen == [1, 2]
    assert live.reconcile()["indexed"] == 3
    live.stop()
    before = store.revision
    with pytest.raises(Stopped):  # not acknowledged, so not lost
        live.apply(spark.createDataFrame([(str(tree / "c.docx"), "modified", None)], EVENT))
    assert store.revision == before and live.status()["state"] == "stopped"


def test_live_loop(spark, tree, tmp_path):
    """Pause keeps events, a changed scope and a folder event compare everything, vectors follow."""
    engine = Engine(spark, str(tmp_path / "store"), [str(tree)], encoder=HashEncoder())
    events = tmp_path / "events"
    events.mkdir()
    write = lambda n, *paths: (events / n).write_text("\n".join(json.dumps({"path": str(p), "kind": "modified", "at": "2024-01-01 00:00:00"}) for p in paths))
    live = Live(spark, engine.store, [str(tree)], reconcile=0)
    live.start(event_log(spark, str(events)), str(tmp_path / "cp"), "100 milliseconds")
    live.pause()
    write("1.json", tree / "a.txt")
    assert live.status()["state"] == "paused" and not live.query.isActive and engine.store.revision == 0
    query = live.resume()
    query.processAllAvailable()
    assert engine.store.table("documents").count() == 1 and live.status()["pending"] == 0
    write("2.json", tree / "sub")
    query.processAllAvailable()
    assert engine.store.table("documents").count() == 4
    live.configure([str(tree / "sub")])
    write("3.json", tree / "a.txt")
    query.processAllAvailable()
    live.stop()
    assert [r["filename"] for r in engine.store.table("documents").collect()] == ["b.md"] and not query.isActive
    upkeep = VectorUpkeep(engine.store, engine.build_vectors)
    assert upkeep.once() and not upkeep.once() and engine.store.state["vector_revision"] == engine.store.revision


def test_registered_parsers_reach_executors(spark, tree):
    def upper(data):
        return parsers.Parsed(segments=[{"segment_id": "1", "segment_type": "section", "content": data.decode().upper(), "sources": []}])

    (tree / "x.log").write_text("hello")
    parsers.register("log", upper)
    try:
        rows = {r["filename"]: r for r in files.parsed(files.scan(spark, [str(tree)], content=True)).collect()}
    finally:
        del parsers.REGISTERED["log"]
    assert rows["x.log"]["segments"][0]["content"] == "HELLO" and "a.txt" in rows


def test_store_parts(spark, tree, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "MOST_PARTS", 3)
    e = Engine(spark, str(tmp_path / "store"), [str(tree)])
    e.run()
    first = e.store.state["parts"]
    (tree / "a.txt").write_text("changed once and for all")
    e.run()
    parts = e.store.state["parts"]
    assert parts[: len(first)] == first and len(parts) == 2  # the old part is not written again
    assert e.search("changed")["result_count"] == 1 and e.search("annual")["result_count"] == 0
    saved = e.store.backup()
    for i in range(3):
        (tree / "a.txt").write_text("x" * (30 + i))
        e.run()
    assert len(e.store.state["parts"]) <= 3 and e.store.table("documents").count() == 4
    e.store.keep(1)
    assert e.store.table("documents").count() == 4
    e.store.restore(saved)
    assert e.store.table("segments").where("content like 'changed%'").count() == 1
    other = Store(spark, str(tmp_path / "store"))
    state = other.state
    other.clear()
    with pytest.raises(StoreError) as error:
        e.store._manifest(state["revision"] + 1, state)
    assert error.value.code == "conflict"


def test_older_store_is_taken_over(spark, tmp_path):
    root = tmp_path / "old"
    docs = spark.createDataFrame([(3, "/a.txt", "a.txt", "txt", 1, 1.0, 1.0, 1.0, 1, None, "success", None, "1")], store_module.DOCUMENTS)
    for name, df in (("documents", docs), ("segments", spark.createDataFrame([(7, 3, "1", "section", "alpha", None)], store_module.SEGMENTS)), ("chunks", spark.createDataFrame([(1, 7, 0, 5, [1.0])], store_module.CHUNKS))):
        df.write.parquet(str(root / "v5" / name))
    (root / "CURRENT").write_text(json.dumps({"format": 6, "revision": 5, "doc": 3, "segment": 7, "chunk": 1, "model_id": None, "vector_revision": None}))
    s = Store(spark, str(root))
    assert s.revision == 5 and s.table("documents").first()["doc_id"] == 3 and s.table("chunks").count() == 1 and (root / "v5").exists()


def test_stream_windows(spark, tmp_path):
    folder = tmp_path / "e"
    folder.mkdir()
    rows = [("a", "created", "2024-01-01 00:00:00"), ("a", "modified", "2024-01-01 00:00:00.5"), ("a", "modified", "2024-01-01 00:10:00"), ("b", "deleted", "2024-01-02 05:00:00")]
    (folder / "1.json").write_text("\n".join(json.dumps(dict(zip(("path", "kind", "at"), r))) for r in rows))
    for name, make, n in (("s", bursts, 2), ("w", change_rates, 2)):
        q = make(event_log(spark, str(folder))).writeStream.format("memory").queryName(f"out_{name}").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(f"out_{name}").count() == n


def test_log(spark):
    rows = [(1, 1, 1, "p", "created", 10, 11, 5), (2, 1, 1, "p", "deleted", 30, 31, 5), (3, 1, 1, "q", "modified", 20, 99, 6), (3, 1, 1, "q", "modified", 20, 99, 6), (4, None, 1, None, "created", 1, 1, None)]
    log = spark.createDataFrame(rows, "change_id long, doc_id long, root_id long, path string, change_kind string, e long, s long, file_size long").withColumn("event_at", F.timestamp_seconds("e")).withColumn("seen_at", F.timestamp_seconds("s"))
    assert [(r["doc_id"], r["change_kind"]) for r in log_state(log).collect()] == [(1, "deleted")]
    assert sorted((r["path"], r["events"]) for r in debounced(log, seconds=15).collect()) == [("p", 1), ("p", 1), ("q", 2)]
    a = spark.createDataFrame([("x", 1.0, 1), ("y", 1.0005, 1), ("z", 1.0, 2)], "path string, mtime double, file_size long")
    b = spark.createDataFrame([("y", 1.0, 1), ("z", 1.0, 1), ("w", 1.0, 1)], "path string, mtime double, file_size long")
    assert {r[0]: r[1] for r in diff(a, b).collect()} == {"x": "new", "y": "same", "z": "changed", "w": "deleted"}


def test_settings(tmp_path):
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"directories": ["/a"], "ocr_enabled": "yes", "later": 1}))
    s = Settings.load(str(p))
    assert s.directories == ["/a"] and s.ocr_enabled is False and s.extra == {"later": 1}
    s.save(str(p))
    assert json.loads(p.read_text())["later"] == 1
    p.write_text("{")
    assert Settings.load(str(p)) == Settings() and (tmp_path / "s.json.corrupt").exists()


def test_command_line(spark, tree, tmp_path, capsys):
    from folioscan.cli import main

    store = ["--store", str(tmp_path / "st")]
    assert main([*store, "--dir", str(tree), "--search", "budget", "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["result_count"] == 2
    assert main([*store, "--search", "a AND"], spark) == 2 and main([*store, "--dir", "/none"], spark) == 1 and main(["--bad"], spark) == 2
    assert main([*store, "--self-check"], spark) == 0
    (tree / "new.txt").write_text("another budget")
    capsys.readouterr()
    assert main([*store, "--dir", str(tree), "--search", "another", "--watch", "0.1", "--rounds", "1", "--ocr"], spark) == 0
    assert "new.txt" in capsys.readouterr().out
    began = time.time()
    assert main([*store, "--quality"], spark) == 0 and time.time() - began < 120


def test_tools(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path / "st"), [str(tree)])
    e.run()
    out = io.StringIO()
    ask = lambda n, method, **params: json.dumps({"jsonrpc": "2.0", "id": n, "method": method, "params": params})
    call = lambda n, name, **given: ask(n, "tools/call", name=name, arguments=given)
    lines = [ask(1, "initialize"), json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}), ask(2, "tools/list"), call(3, "search_documents", query="budget"), call(4, "search_documents", query="a AND"), call(5, "search_documents"), call(6, "none"), "{", ask(7, "resources/read", uri=f"folioscan://document/{tree}/a.txt"), ask(8, "resources/read", uri="x"), call(9, "get_index_status"), call(10, "get_problem_documents", limit=5), ask(11, "other")]
    mcp.serve(e, lines, out)
    said = [json.loads(x) for x in out.getvalue().splitlines()]
    by = {x["id"]: x for x in said}
    data = lambda n: json.loads(by[n]["result"]["content"][0]["text"])
    assert len(said) == 12 and by[1]["result"]["serverInfo"]["name"] == "folioscan" and len(by[2]["result"]["tools"]) == 7
    assert data(3)["result_count"] == 2 and data(4)["error"] == "operator_position" and data(5)["error"] == "arguments" and by[6]["result"]["isError"] and by[None]["error"]["code"] == -32700
    assert "annual budget" in by[7]["result"]["contents"][0]["text"] and "error" in by[8] and data(9)["documents"] == 4 and len(data(10)["documents"]) == 1 and by[11]["error"]["code"] == -32601


def test_model_identity(tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "model.onnx").write_bytes(b"1")
    one = model_id(str(tmp_path / "m"))
    assert one == model_id(str(tmp_path / "m"))
    (tmp_path / "m" / "model.onnx").write_bytes(b"22")
    assert one != model_id(str(tmp_path / "m"))
    with pytest.raises(ValueError):
        OnnxEncoder(str(tmp_path / "m"))
