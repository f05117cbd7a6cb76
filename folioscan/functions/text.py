"""Text expressions: tokens, grams, literal patterns and escaping, all as JVM columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ideographs that are indexed by grams.
CJK = "\\u3400-\\u9fff\\uf900-\\ufaff\\x{20000}-\\x{323af}"
#: A character of a token that is no ideograph; ideographs are tokens of their own.
PART = rf"[\p{{L}}\p{{N}}&&[^{CJK}]]"
CJK_RANGES = ((0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))


def is_cjk(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in CJK_RANGES)


def tokens(text) -> Column:
    """Index tokens in order: runs of other letters and digits, lower-cased, and each ideograph on its own."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), f"([{CJK}])", " $1 "), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def token_count(text) -> Column:
    """The number of tokens(), counted in one pass without making them."""
    return F.regexp_count(text, F.lit(f"[\\p{{L}}\\p{{N}}&&[{CJK}]]|[\\p{{L}}\\p{{N}}&&[^{CJK}]]+"))


def bm25_length(text) -> Column:
    """The length that BM25 takes: the words of the text, a run of ideographs being one, and its tokens()."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+")) + token_count(text)


def grams(text) -> Column:
    """The distinct pairs of adjoining ideographs."""
    text = F.col(text) if isinstance(text, str) else text
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
    return F.array_distinct(F.filter(pairs, lambda p: p.rlike(f"^[{CJK}]{{2}}$")))


def query_grams(term: str) -> list[str]:
    """The pairs of a query term, or its single ideographs if it has no pair."""
    two = [a + b for a, b in zip(term, term[1:]) if is_cjk(a) and is_cjk(b)]
    return sorted(set(two)) or sorted({c for c in term if is_cjk(c)})


def quoted(text: str) -> str:
    """text as a literal in a Java pattern."""
    return re.sub(r"([\\.^$|?*+()\[\]{}\-&~#])", r"\\\1", text)


def literal(term: str, match_case: bool = False, whole_word: bool = False, pattern: str | None = None) -> str:
    """The Java pattern of a literal; case and word characters follow Unicode."""
    body = pattern if pattern is not None else quoted(term)
    if whole_word:
        body = rf"(?<!\w){body}(?!\w)"
    return f"(?U){body}" if match_case else f"(?iuU){body}"


def _any_of(words: list[str]) -> str:
    """A pattern of whole words that begins with what they share, so that most places are left after one comparison."""
    words = sorted(set(words))
    shared = words[0]
    for w in words:
        while not w.startswith(shared):
            shared = shared[:-1]
    ends = "(?:" + "|".join(quoted(w[len(shared) :]) for w in sorted(words, key=len, reverse=True)) + ")" if len(words) > 1 else ""
    edge = rf"(?<!{PART}{quoted(shared)})"
    return (quoted(shared) + edge if shared else edge) + ends


def _flags(words: list[str]) -> str:
    return "(?i)" if all(w.isascii() for w in words) else "(?iu)"


def word_set(words: list[str]) -> str:
    """A pattern of whole index tokens: any of the words, without regard to case."""
    return _flags(words) + _any_of(words) + rf"(?!{PART})"


def phrase_set(words: list[list[str]]) -> str:
    """A pattern of consecutive words, each any of its list, with no letter or digit between."""
    return _flags([w for ws in words for w in ws]) + r"[^\p{L}\p{N}]+".join(_any_of(w) for w in words) + rf"(?!{PART})"


def html_escape(column: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        column = F.replace(column, F.lit(a), F.lit(b))
    return column


def plain_marks(column: Column) -> Column:
    """Marked HTML as Markdown: marks are bold, other tags go, entities are plain."""
    out = F.regexp_replace(F.regexp_replace(column, r"(?s)<mark[^>]*>(.*?)</mark>", "**$1**"), r"<[^>]+>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
