"""Recognition of text in images by an external program (Tesseract's command line), where one is installed on the executors."""

from __future__ import annotations

import csv
import io
import os
import shutil
import subprocess
import tempfile

from .parsers import IMAGES, Parsed, Spans

# The bounds of the time a file may take.
LEAST_SECONDS, MOST_SECONDS = 1.0, 120.0


class Recogniser:
    """Settings, shipped to the executors; the program is looked up there."""

    def __init__(self, executable: str | None = None, languages: str = "chi_tra+chi_sim+eng", seconds: float = 30.0):
        self.executable, self.languages, self.seconds = executable, languages, max(LEAST_SECONDS, min(MOST_SECONDS, seconds))

    @classmethod
    def from_environment(cls) -> Recogniser:
        e = os.environ
        return cls(e.get("FOLIOSCAN_OCR_PROGRAM"), e.get("FOLIOSCAN_OCR_LANGUAGES", "chi_tra+chi_sim+eng"), float(e.get("FOLIOSCAN_OCR_SECONDS", "30")))

    def words(self, data: bytes) -> list[dict]:
        """Words with page, block, par, line and place. The program is ended when the time is over."""
        program = self.executable or shutil.which("tesseract")
        if not program:
            raise RuntimeError("no recognition program is installed")
        with tempfile.NamedTemporaryFile(suffix=".img") as image:  # of this task only
            image.write(data)
            image.flush()
            try:
                done = subprocess.run([program, image.name, "stdout", "-l", self.languages, "--psm", "3", "tsv"], capture_output=True, timeout=self.seconds, check=False)
            except subprocess.TimeoutExpired:
                raise RuntimeError(f"recognition took more than {self.seconds:g} seconds") from None
        if done.returncode:
            raise RuntimeError("recognition failed: " + done.stderr.decode("utf-8", "replace")[-300:])
        rows = csv.DictReader(io.StringIO(done.stdout.decode("utf-8", "replace")), delimiter="\t", quoting=csv.QUOTE_NONE)
        return [r for r in rows if r.get("level") == "5" and (r.get("text") or "").strip()]

    def parse(self, data: bytes) -> Parsed:
        """A segment for each frame of an image."""
        out = Parsed()
        try:
            words = self.words(data)
        except RuntimeError as e:
            return Parsed("partial", warnings=[{"code": "ocr_failed", "location": "image", "message": str(e)}])
        pages: dict[str, dict[tuple, list[str]]] = {}
        for w in words:
            pages.setdefault(w["page_num"], {}).setdefault((w["block_num"], w["par_num"], w["line_num"]), []).append(w["text"].strip())
        for n in sorted(pages, key=int):
            spans = Spans()
            for line in pages[n].values():
                spans.add(" ".join(line), "ocr", f"image {n}", "\n")
            if one := spans.segment(n, "image"):
                out.segments.append(one)
        if not out.segments:
            out.warnings.append({"code": "ocr_no_text", "location": "image 1", "message": "no text was recognised"})
        out.status = "success" if out.segments else "empty"
        return out


def enable(recogniser: Recogniser | None = None) -> None:
    """Read image files by recognition from now on."""
    from .parsers import register

    for extension in IMAGES:
        register(extension, (recogniser or Recogniser.from_environment()).parse)


def overlapping(words: list[dict], native: list[tuple[float, float, float, float]], share: float = 0.25) -> list[dict]:
    """Recognised words without those of which more than `share` lies under a native word (left, top, right, bottom)."""

    def hidden(w: dict) -> bool:
        a, b = float(w["left"]), float(w["top"])
        c, d = a + float(w["width"]), b + float(w["height"])
        area = max((c - a) * (d - b), 1e-9)
        return any(max(0.0, min(c, z) - max(a, x)) * max(0.0, min(d, u) - max(b, y)) > share * area for x, y, z, u in native)

    return [w for w in words if not hidden(w)]
