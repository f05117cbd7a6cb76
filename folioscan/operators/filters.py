"""Metadata predicates as columns; all reach the scan or run in whole-stage code."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of file-type groups and their extensions.
GROUPS = {"pdf": ("pdf",), "word": ("docx", "doc"), "doc": ("docx", "doc"), "excel": ("xlsx", "xls"), "xls": ("xlsx", "xls"), "ppt": ("pptx", "ppt"), "powerpoint": ("pptx", "ppt"), "text": ("txt", "md", "csv")}
DAY = 86400.0
PRESET_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}
MIB = 1 << 20
PRESET_SIZES = {"small": (None, MIB - 1), "medium": (MIB, 10 * MIB - 1), "large": (10 * MIB, 100 * MIB), "huge": (100 * MIB + 1, None)}
UNITS = {"KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30}


def type_group(kinds: str | list[str] | None, column: str = "file_type") -> Column:
    """Any of the groups; unknown names and 'all' filter nothing."""
    names = [kinds] if isinstance(kinds, str) else list(kinds or [])
    wanted = list(dict.fromkeys(e for n in names for e in GROUPS.get(n.lower(), ())))
    if not wanted or any(n.lower() == "all" for n in names):
        return F.lit(True)
    return F.col(column).isin(wanted)


def time_range(after: float | None = None, before: float | None = None, field: str = "mtime") -> Column:
    """after <= time < before."""
    out = F.lit(True)
    if after is not None:
        out = out & (F.col(field) >= after)
    return out if before is None else out & (F.col(field) < before)


def size_range(least: int | None = None, most: int | None = None) -> Column:
    """Both ends inclusive."""
    out = F.lit(True)
    if least is not None:
        out = out & (F.col("file_size") >= least)
    return out if most is None else out & (F.col("file_size") <= most)


def preset_time(name: str, now: float) -> tuple[float, None]:
    return now - PRESET_DAYS[name] * DAY, None


def custom_days(first: str, last: str) -> tuple[float, float]:
    """From local midnight of the first day to the midnight after the last."""
    a, b = datetime.fromisoformat(first), datetime.fromisoformat(last)
    if a > b:
        raise ValueError("the first day is after the last")
    return a.timestamp(), (b + timedelta(days=1)).timestamp()


def custom_size(least: float | None, most: float | None, unit: str) -> tuple[int | None, int | None]:
    if least is not None and most is not None and least > most:
        raise ValueError("the least size is above the most")
    scale = lambda x: None if x is None else round(x * UNITS[unit])
    return scale(least), scale(most)


def ascii_lower(column) -> Column:
    """Lower case of ASCII letters only, as path comparison wants it."""
    column = F.col(column) if isinstance(column, str) else column
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _lower(text: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in text)


def under(path, root: str) -> Column:
    """path is root or lies below it; no character of root is a wildcard."""
    root = _lower(root.rstrip("/"))
    low = ascii_lower(path)
    return (low == root) | F.startswith(low, F.lit(root + "/"))


def include_paths(roots: list[str], path: str = "path") -> Column:
    out = F.lit(not roots)
    for r in roots:
        out = out | under(path, r)
    return out


def relative(path: str, roots: list[str]) -> Column:
    """The path below the longest root that holds it, from the separator on; other paths as they are."""
    out, column = None, F.col(path)
    for root in sorted({r.rstrip("/") for r in roots}, key=len, reverse=True):
        rest = F.substring(column, F.lit(len(root) + 1), F.length(column))
        out = F.when(under(path, root), rest) if out is None else out.when(under(path, root), rest)
    return column if out is None else out.otherwise(column)


def glob_pattern(pattern: str) -> str:
    """The Java pattern of an exclusion: absolute is a prefix, a bare word a whole path part, others match anywhere; * and ? are wildcards."""
    pattern = _lower(pattern.replace("\\", "/"))
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    if pattern.startswith("/"):
        return f"(?s)^{body}"
    if not re.search(r"[/*?]", pattern):
        return f"(?s)/{body}/"
    return f"(?s){body}"


def exclude(patterns: list[str], path: str = "path", roots: list[str] | None = None) -> Column:
    """No pattern fits the path; patterns that are not absolute see it below the search roots."""
    out = F.lit(True)
    below = ascii_lower(relative(path, roots or []))
    for p in patterns:
        target = ascii_lower(path) if p.startswith("/") else below
        out = out & ~target.rlike(glob_pattern(p))
    return out


def has_warning(code: str) -> Column:
    return F.coalesce(F.exists("warnings", lambda w: w["code"] == code), F.lit(False))


def is_problem() -> Column:
    return (F.coalesce("parse_status", F.lit("unknown")) != "success") | (F.coalesce(F.size("warnings"), F.lit(0)) > 0)


def reprocess_eligible() -> Column:
    """Never parsed with a known outcome, or by another version of the parser than the current one."""
    current = F.when(F.col("file_type").isin("xlsx", "pdf", "pptx"), "3").when(F.col("file_type") == "docx", "2").otherwise("1")
    return (F.coalesce("parse_status", F.lit("unknown")) == "unknown") | ~F.col("parser_version").eqNullSafe(current)
