"""Files as segments with source spans; formats of zip and XML by the standard library, others report what is missing.

A parser takes bytes and returns Parsed; it raises nothing: what goes wrong becomes a status.
"""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from .decode import decode
from .ole import SIGNATURE as OLE
from .ole import Compound, Encrypted, Workbook, readable
from .pdf import Document, has_images, page_text

VERSIONS = {"xlsx": "3", "pdf": "3", "pptx": "3", "docx": "2"}
IMAGES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp")
# Names of fonts and parts that old slide files hold among their texts.
FONTS = ("Arial", "Calibri", "Times New Roman", "Wingdings", "Default Design")


@dataclass
class Parsed:
    """status: success, partial, empty, unsupported, unreadable, encrypted, corrupt or dependency_missing."""

    status: str = "success"
    error: str | None = None
    segments: list[dict] = field(default_factory=list)
    warnings: list[dict] = field(default_factory=list)


class Spans:
    """Text put together from sources; offsets count code points."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[dict] = []

    def add(self, text: str, kind: str, location: str, separator: str = "") -> None:
        if not text:
            return
        if self.size and separator:
            self.parts.append(separator)
            self.size += len(separator)
        last = self.spans[-1] if self.spans else None
        if last and not separator and last["end"] == self.size and (last["kind"], last["location"]) == (kind, location):
            last["end"] += len(text)
        else:
            self.spans.append({"start": self.size, "end": self.size + len(text), "kind": kind, "location": location})
        self.parts.append(text)
        self.size += len(text)

    def segment(self, name: str, kind: str) -> dict | None:
        text = "".join(self.parts)
        return {"segment_id": name, "segment_type": kind, "content": text, "sources": self.spans} if text.strip() else None


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _xml(archive: zipfile.ZipFile, name: str) -> ET.Element | None:
    return ET.fromstring(archive.read(name)) if name in archive.namelist() else None


def _children(node: ET.Element | None) -> list[ET.Element]:
    return [] if node is None else list(node)


def _numbered(archive: zipfile.ZipFile, pattern: str) -> list[tuple[int, str]]:
    return sorted((int(m[1]), n) for n in archive.namelist() if (m := re.fullmatch(pattern, n)))


def text_file(data: bytes) -> Parsed:
    spans = Spans()
    spans.add(decode(data), "section", "body")
    one = spans.segment("1", "section")
    return Parsed("success" if one else "empty", segments=[one] if one else [])


def _runs(node: ET.Element) -> Iterable[str]:
    """Text of a paragraph; of alternatives the first branch only."""
    for child in node:
        name = _local(child.tag)
        if name == "AlternateContent":
            branch = next(iter(child), None)
            if branch is not None:
                yield from _runs(branch)
        elif name == "t":
            yield child.text or ""
        elif name in ("tab", "br", "cr"):
            yield "\t" if name == "tab" else "\n"
        elif name != "p":
            yield from _runs(child)


def _paragraphs(node: ET.Element, place: str) -> Iterable[tuple[str, str]]:
    """(text, location) in document order; tables and text boxes name their place."""
    for child in node:
        name = _local(child.tag)
        if name == "p":
            yield "".join(_runs(child)), place
            for box in (x for x in child.iter() if _local(x.tag) == "txbxContent"):
                yield from _paragraphs(box, "textbox")
        elif name == "tbl":
            for r, row in enumerate((x for x in child if _local(x.tag) == "tr"), 1):
                for c, cell in enumerate((x for x in row if _local(x.tag) == "tc"), 1):
                    yield from _paragraphs(cell, f"table r{r}c{c}")
        elif name in ("sdt", "sdtContent", "body", "hdr", "ftr"):
            yield from _paragraphs(child, place)


def docx(data: bytes) -> Parsed:
    out = Parsed()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts = [("word/document.xml", "body"), *((n, "header") for _, n in _numbered(z, r"word/header(\d+)\.xml")), *((n, "footer") for _, n in _numbered(z, r"word/footer(\d+)\.xml"))]
        for i, (name, place) in enumerate(parts, 1):
            root = _xml(z, name)
            if root is None:
                return Parsed("corrupt", f"{name} is missing")
            spans = Spans()
            for text, where in _paragraphs(root, place):
                spans.add(text, "section", where, "\n")
            if one := spans.segment(str(i), "section"):
                out.segments.append(one)
        if any("embeddings/" in n for n in z.namelist()):
            out.warnings.append({"code": "unsupported_object", "location": "body", "message": "embedded object"})
    return _finished(out)


def _shapes(node: ET.Element, place: str, inherited: bool = False, prefix: str = "") -> Iterable[tuple[str, str, str, str]]:
    """(text, kind, location, separator) of the shapes of a slide, its layout or its master; groups name their members."""
    for shape in node:
        name = _local(shape.tag)
        if name not in ("sp", "graphicFrame", "grpSp"):
            continue
        number = prefix + next((x.get("id", "") for x in shape.iter() if _local(x.tag) == "cNvPr"), "")
        if inherited and any(_local(x.tag) == "ph" for x in shape.iter()):
            continue  # what a placeholder of the layout says is no text of the slide
        where = f"{place} shape {number}"
        if name == "grpSp":
            yield from _shapes(shape, place, inherited, number + "/")
        elif name == "graphicFrame":
            for r, row in enumerate((x for x in shape.iter() if _local(x.tag) == "tr"), 1):
                for c, cell in enumerate((x for x in row if _local(x.tag) == "tc"), 1):
                    text = "\n".join(_lines(cell))
                    if text.strip():
                        yield text, "table_cell", f"{where} r{r}c{c}", " | "
        else:
            for text in _lines(shape):
                if text.strip():
                    yield text, "shape", where, "\n"


def _lines(node: ET.Element) -> list[str]:
    return ["".join(t.text or "" for t in p.iter() if _local(t.tag) == "t") for p in node.iter() if _local(p.tag) == "p"]


def _related(z: zipfile.ZipFile, name: str, kind: str) -> str | None:
    """The part of a kind that another part refers to."""
    folder, _, file = name.rpartition("/")
    for r in _children(_xml(z, f"{folder}/_rels/{file}.rels")):
        if r.get("Type", "").endswith("/" + kind):
            target = r.get("Target", "")
            return target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"{folder}/{target}")
    return None


def pptx(data: bytes) -> Parsed:
    out = Parsed()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for n, name in _numbered(z, r"ppt/slides/slide(\d+)\.xml"):
            spans, root = Spans(), _xml(z, name)
            layout = _related(z, name, "slideLayout")
            master = _related(z, layout, "slideMaster") if layout else None
            parts = [(root, f"slide {n} slide", False), (layout and _xml(z, layout), f"slide {n} layout", True)]
            if not any(x is not None and x.get("showMasterSp") in ("0", "false") for x in (root, parts[1][0])):
                parts.append((master and _xml(z, master), f"slide {n} master", True))
            for part, place, inherited in parts:
                tree = next((x for x in part.iter() if _local(x.tag) == "spTree"), None) if part is not None else None
                if tree is not None:
                    for text, kind, where, separator in _shapes(tree, place, inherited):
                        spans.add(text, kind, where, separator)
                elif part is root:
                    for text in _lines(root):
                        spans.add(text, "shape", place, "\n")
            if any(_local(x.tag) == "oleObj" or _local(x.tag) == "graphicData" and x.get("uri", "").endswith(("/diagram", "/chart")) for x in root.iter()):
                out.warnings.append({"code": "unsupported_embedded_object", "location": f"slide {n}", "message": "chart or embedded object"})
            notes = _xml(z, _related(z, name, "notesSlide") or f"ppt/notesSlides/notesSlide{n}.xml")
            text = "\n".join(filter(None, _lines(notes))).strip() if notes is not None else ""
            if text:
                spans.add("[Note] " + text, "notes", f"slide {n} notes", "\n")
            if one := spans.segment(str(n), "slide"):
                out.segments.append(one)
    return _finished(out)


def _shared(z: zipfile.ZipFile) -> list[str]:
    root = _xml(z, "xl/sharedStrings.xml")
    return [] if root is None else ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in root if _local(si.tag) == "si"]


def xlsx(data: bytes) -> Parsed:
    out = Parsed()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = _xml(z, "xl/workbook.xml")
        if book is None:
            return Parsed("corrupt", "xl/workbook.xml is missing")
        links = {r.get("Id"): r.get("Target", "") for r in _children(_xml(z, "xl/_rels/workbook.xml.rels"))}
        strings = _shared(z)
        for sheet in (x for x in book.iter() if _local(x.tag) == "sheet"):
            title = sheet.get("name", "")
            target = links.get(next((v for k, v in sheet.attrib.items() if _local(k) == "id"), ""), "")
            path = target.lstrip("/") if target.startswith("/") else "xl/" + target
            root = _xml(z, path)
            if root is None:
                continue
            spans = Spans()
            for row in (x for x in root.iter() if _local(x.tag) == "row"):
                fresh = "\n"
                for cell in (c for c in row if _local(c.tag) == "c"):
                    place = f"{title}!{cell.get('r', '')}"
                    got = {_local(x.tag): x for x in cell}
                    formula = got["f"].text if "f" in got else None
                    value = got["v"].text if "v" in got else None
                    if cell.get("t") == "s" and value is not None:
                        value = strings[int(value)] if int(value) < len(strings) else ""
                    elif cell.get("t") == "inlineStr" and "is" in got:
                        value = "".join(t.text or "" for t in got["is"].iter() if _local(t.tag) == "t")
                    if formula:
                        spans.add("=" + formula, "formula", place, fresh)
                        fresh = " | "
                        if value is None:
                            out.warnings.append({"code": "missing_cached_result", "location": place, "message": "no cached value"})
                    if value:
                        spans.add(value, "cell", place, fresh)
                        fresh = " | "
            relations = path.rpartition("/")[0] + "/_rels/" + path.rpartition("/")[2] + ".rels"
            for r in _children(_xml(z, relations)):
                if r.get("Type", "").endswith("/comments"):
                    notes = _xml(z, "xl/" + r.get("Target", "").replace("../", ""))
                    for c in (x for x in (notes.iter() if notes is not None else ()) if _local(x.tag) == "comment"):
                        spans.add("".join(t.text or "" for t in c.iter() if _local(t.tag) == "t"), "comment", f"{title}!{c.get('ref', '')}", "\n")
                elif "threadedComment" in r.get("Type", ""):
                    out.warnings.append({"code": "unsupported_threaded_comments", "location": title, "message": "threaded comments"})
            if one := spans.segment(title, "sheet"):
                out.segments.append(one)
    return _finished(out)


def _finished(out: Parsed) -> Parsed:
    out.status = "partial" if out.warnings and out.segments else "success" if out.segments else "empty"
    return out


def old_office(kind: str, wanted: tuple[str, ...], loose: bool, noise: tuple[str, ...] = ()) -> Callable[[bytes], Parsed]:
    """Readable runs of the streams that hold the text, or of all if these have none; loose: files of another kind under the name are read as they are."""

    def parse(data: bytes) -> Parsed:
        if data.startswith(OLE):
            streams = Compound(data).streams()
            lines = readable(b"".join(streams.get(w, b"") for w in wanted))
            if not lines and (loose or not any(w in streams for w in wanted)):
                lines = list(dict.fromkeys(x for s in streams.values() for x in readable(s)))
        elif loose:
            lines = readable(data)
        else:
            return Parsed("corrupt", "not an OLE file")
        if not lines and not data.startswith(OLE):
            return Parsed("corrupt", "not an OLE file and nothing readable")
        spans = Spans()
        for line in lines:
            if line not in noise:
                spans.add(line, kind, "stream", "\n")
        one = spans.segment("1", kind)
        return Parsed("success" if one else "empty", segments=[one] if one else [])

    return parse


def xls(data: bytes) -> Parsed:
    streams = Compound(data).streams() if data.startswith(OLE) else {}
    stream = streams.get("Workbook", streams.get("Book"))
    if stream is None:
        return Parsed("encrypted", "the file is protected") if "EncryptedPackage" in streams else Parsed("corrupt", "no workbook in the file")
    out = Parsed()
    try:
        book = Workbook(stream)
    except Encrypted as e:
        return Parsed("encrypted", str(e))
    for start, title in book.sheets:
        spans = Spans()
        for r, cells in sorted(book.rows(start).items()):
            fresh = "\n"
            for c, text in sorted(cells.items()):
                if text.strip():
                    spans.add(text.strip(), "cell", f"{title}!{column_name(c)}{r + 1}", fresh)
                    fresh = " | "
        if one := spans.segment(title, "sheet"):
            out.segments.append(one)
    return _finished(out)


def column_name(n: int) -> str:
    out = ""
    while n >= 0:
        n, r = divmod(n, 26)
        out, n = chr(65 + r) + out, n - 1
    return out


def pdf(data: bytes) -> Parsed:
    """A segment for each page with native text; a page that cannot be read is a warning."""
    doc = Document(data)
    if doc.encrypted:
        return Parsed("encrypted", "the document is protected")
    out = Parsed()
    for n, page in enumerate(doc.pages(), 1):
        place, spans = f"page {n}", Spans()
        try:
            spans.add(page_text(doc, page), "native", place)
            if has_images(doc, page):
                out.warnings.append({"code": "ocr_disabled", "location": place, "message": "text in images was not recognised"})
            elif not spans.size:
                out.warnings.append({"code": "no_native_text", "location": place, "message": "the page has no native text"})
        except Exception as e:
            out.warnings.append({"code": "page_failed", "location": place, "message": f"{type(e).__name__}: {e}"[:300]})
        if one := spans.segment(str(n), "page"):
            out.segments.append(one)
    return _finished(out)


def image(data: bytes) -> Parsed:
    return Parsed("empty", warnings=[{"code": "ocr_disabled", "location": "image", "message": "no recognition"}])


#: Parsers by extension. Executors import this table; what register() adds on the driver is shipped to them with each parse (see files.parsed).
REGISTERED: dict[str, Callable[[bytes], Parsed]] = {}
PARSERS: dict[str, Callable[[bytes], Parsed]] = {
    "txt": text_file, "md": text_file, "csv": text_file, "docx": docx, "pptx": pptx, "xlsx": xlsx,
    "doc": old_office("section", ("WordDocument", "1Table", "0Table"), True), "ppt": old_office("slide", ("PowerPoint Document",), False, FONTS), "pdf": pdf, "xls": xls,
    **dict.fromkeys(IMAGES, image),
}


def register(extension: str, parser: Callable[[bytes], Parsed]) -> None:
    """Read files with this extension by parser, which must be picklable; it takes the place of a built-in one."""
    REGISTERED[extension.lower()] = parser


def version(file_type: str) -> str:
    return VERSIONS.get(file_type, "1")


def extensions() -> list[str]:
    return sorted(PARSERS.keys() | REGISTERED.keys())


def parse(file_type: str, data: bytes | None, registered: dict[str, Callable[[bytes], Parsed]] | None = None) -> Parsed:
    """registered: parsers besides the built-in ones; by default those of this process."""
    parser = (REGISTERED if registered is None else registered).get(file_type.lower()) or PARSERS.get(file_type.lower())
    if parser is None:
        return Parsed("unsupported", f"no parser for {file_type}")
    if data is None:
        return Parsed("unreadable", "the file could not be read")
    try:
        if file_type in ("docx", "xlsx", "pptx") and data.startswith(OLE):
            return Parsed("encrypted", "the file is protected")
        return parser(data)
    except Exception as e:  # one bad file is one bad row
        return Parsed("corrupt", f"{type(e).__name__}: {e}"[:500])
