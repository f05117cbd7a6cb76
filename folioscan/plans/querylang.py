"""The query language: terms, phrases, AND, OR, NOT; implicit AND binds tightest, then NOT (binary), AND, OR."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any


class QueryError(ValueError):
    """code: unpaired_phrase, operator_position, repeated_operator, filename_empty, filename_quotes, regex_syntax, regex_timeout, cancelled, stale_cursor."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(message or code)
        self.code = code


@dataclass(frozen=True)
class Node:
    operator: str  # term, and, or, not
    term: str = ""
    left: Node | None = None
    right: Node | None = None

    def terms(self) -> list[str]:
        """Distinct terms in order of appearance."""
        if self.operator == "term":
            return [self.term]
        return list(dict.fromkeys([*self.left.terms(), *self.right.terms()]))

    def fold(self, leaf: Callable[[str], Any], both: Callable[[str, Any, Any], Any]) -> Any:
        if self.operator == "term":
            return leaf(self.term)
        return both(self.operator, self.left.fold(leaf, both), self.right.fold(leaf, both))


LEVELS = ("implicit", "not", "and", "or")


def parse(text: str) -> Node | None:
    """The tree of a query; None if it has no term. A repeated or misplaced operator is an error."""
    if text.count('"') % 2:
        raise QueryError("unpaired_phrase")
    items: list[tuple[str, Any]] = []
    for raw in re.findall(r'"[^"]*"|\S+', text):
        bare = raw.lower()
        if bare in ("and", "or", "not"):
            if not items:
                raise QueryError("operator_position")
            if items[-1][0] == "op":
                raise QueryError("repeated_operator")
            items.append(("op", bare))
            continue
        term = raw[1:-1].strip() if raw.startswith('"') and raw.endswith('"') and len(raw) > 1 else raw
        if not term:
            continue
        if items and items[-1][0] == "tree":
            items.append(("op", "implicit"))
        items.append(("tree", Node("term", term)))
    if not items:
        return None
    if items[-1][0] == "op":
        raise QueryError("operator_position")
    for level in LEVELS:
        out: list[tuple[str, Any]] = []
        i = 0
        while i < len(items):
            if items[i] == ("op", level):
                left = out.pop()[1]
                out.append(("tree", Node("and" if level == "implicit" else level, left=left, right=items[i + 1][1])))
                i += 2
            else:
                out.append(items[i])
                i += 1
        items = out
    return items[0][1]


def negative_term(text: str) -> str | None:
    """The term of a query that is wholly NOT term or NOT "phrase"."""
    m = re.fullmatch(r'\s*not\s+(?:"([^"]+)"|([^\s"]+))\s*', text, re.IGNORECASE)
    return (m[1] or m[2]) if m else None


def filename_term(text: str) -> str | None:
    """The name asked for by filename:name; None for other queries."""
    m = re.match(r"\s*(?:filename|檔名)\s*[:：]", text, re.IGNORECASE)
    if not m:
        return None
    name = text[m.end() :].strip()
    if name.count('"') % 2:
        raise QueryError("filename_quotes")
    name = name.strip('"').strip()
    if not name:
        raise QueryError("filename_empty")
    return name
