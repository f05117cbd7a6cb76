"""Problem 6: visually identical text with different characters.

Arrow text is copied to one code-point array per batch; a table gather gives each character its class and its usual form, cumulative expansion offsets
place characters that become several (ligatures) or none (zero-width), and accents are composed with their letters by one search in a sorted table of
pairs. Letters of another script are judged by their word: they count as look-alikes where the word also has Latin letters, or consists of look-alikes
alone and no neighbouring word is really of that script. No string function is called per row.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import points as P
from .tables import read, spread

CASE, JOINER, ALIKE, LATIN, FOREIGN, EMOJI, ACCENT = 1, 2, 4, 8, 16, 32, 64
# Letters that look like Latin ones, and those Latin ones, in the same order.
CYRILLIC, CYRILLIC_LATIN = "асеорхуіјѕԁһԛԝАВСЕНІЈКМОРЅТХУ", "aceopxyijsdhqwABCEHIJKMOPSTXY"
GREEK, GREEK_LATIN = "ονΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovABEZHIKMNOPTYX"
JOINER_POINT = 0x200D
ZERO_WIDTH = (0x00AD, 0x180E, 0x200B, 0x200C, 0x2060, 0xFEFF)
EMOJI_RANGES = ((0x2600, 0x27BF), (0xFE0F, 0xFE0F), (0x1F000, 0x1FAFF))
#: The longest usual form of one character in these tables.
WIDE = 4


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point: class bits, number of code points of the usual form, and those (WIDE columns)."""
    n = 0x110000
    bits = np.zeros(n, np.uint8)
    size = np.ones(n, np.uint8)
    form = np.zeros((n, WIDE), np.uint32)
    form[:, 0] = np.arange(n)

    def set_form(i: int, text: str) -> None:
        size[i] = len(text)
        form[i, : len(text)] = [ord(c) for c in text]

    for i in (*range(0x80, 0x20000), *range(0x2F800, 0x2FA20)):
        c = chr(i)
        kind = unicodedata.category(c)
        if kind == "Cn":
            continue
        if kind[0] == "L" and i < 0x2000 or 0xA720 <= i < 0xA7FF:
            name = unicodedata.name(c, "")
            bits[i] |= LATIN if name.startswith("LATIN") else FOREIGN if name.startswith(("CYRILLIC", "GREEK")) else 0
        if kind == "Zs":
            bits[i] |= CASE
            set_form(i, " ")
        elif kind in ("Mn", "Me") and (0x300 <= i <= 0x36F or 0x1AB0 <= i <= 0x1AFF or 0x1DC0 <= i <= 0x1DFF or 0x20D0 <= i <= 0x20FF or 0xFE20 <= i <= 0xFE2F):
            bits[i] |= CASE | ACCENT
        else:
            tag = unicodedata.decomposition(c).partition(" ")[0]
            usual = unicodedata.normalize("NFKC", c)
            radical = 0x2E80 <= i <= 0x2FDF
            letter = kind[0] == "L" or kind == "Nd"
            if usual != c and len(usual) <= WIDE and (radical or letter and (tag in ("<font>", "<wide>", "<narrow>") or tag == "<compat>" and i >= 0x2000 or 0xF900 <= i <= 0xFAFF or i >= 0x2F800)):
                bits[i] |= CASE
                set_form(i, usual)
    for i in ZERO_WIDTH:
        bits[i] |= CASE
        size[i] = 0
    bits[JOINER_POINT] = JOINER
    for text, latin in ((CYRILLIC, CYRILLIC_LATIN), (GREEK, GREEK_LATIN)):
        for c, x in zip(text, latin, strict=True):
            bits[ord(c)] = ALIKE
            form[ord(c), 0] = ord(x)
    for a, b in EMOJI_RANGES:
        bits[a : b + 1] = EMOJI
    for i in (*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)):
        bits[i] |= LATIN
    return bits, size, form


@cache
def pairs() -> tuple[np.ndarray, np.ndarray]:
    """Sorted (letter << 21 | accent) and the composed letters."""
    found = []
    for i in range(0xC0, 0x3000):
        parts = unicodedata.decomposition(chr(i)).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", chr(i)) == chr(i):
            found.append((int(parts[0], 16) << 21 | int(parts[1], 16), i))
    found.sort()
    return np.array([k for k, _ in found], np.int64), np.array([v for _, v in found], np.uint32)


def judge(cp: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which characters are cases."""
    bits = tables()[0]
    b = bits[cp]
    case = (b & CASE) > 0
    first = np.zeros(len(cp) + 1, bool)
    first[off] = True
    joiner = np.flatnonzero(b & JOINER)
    after = (joiner > 0) & ~first[joiner]
    case[joiner] = ~(after & ((b[np.maximum(joiner - 1, 0)] & EMOJI) > 0))
    if (b & ALIKE).any():
        letter = (b & (ALIKE | LATIN | FOREIGN | ACCENT)) > 0
        edge = first[:-1].copy()
        edge[1:] |= letter[1:] != letter[:-1]
        start = np.flatnonzero(edge)
        kinds = np.bitwise_or.reduceat(b, start)
        word = letter[start]
        alike, latin, foreign = word & ((kinds & ALIKE) > 0), (kinds & LATIN) > 0, word & ((kinds & FOREIGN) > 0)
        # the neighbouring words of the row: two stretches away, over one stretch of other characters
        row = np.searchsorted(off, start, "right")
        before = np.r_[False, False, (foreign[:-2] & (row[:-2] == row[2:]))] if len(start) > 2 else np.zeros(len(start), bool)
        behind = np.r_[(foreign[2:] & (row[:-2] == row[2:])), False, False] if len(start) > 2 else np.zeros(len(start), bool)
        wrong = alike & (latin | ~foreign & ~before & ~behind)
        at = np.repeat(wrong, np.diff(np.r_[start, len(cp)]))
        case |= at & ((b & ALIKE) > 0)
    return case


def usual(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text in its one consistent form: (code points, offsets). A second application changes nothing."""
    bits, size, form = tables()
    case = judge(cp, off)
    if not case.any():
        return cp, off
    joiner = case & (cp == JOINER_POINT)
    width = np.where(case, np.where(joiner, 0, size[cp]), 1).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(width)])
    source = np.repeat(np.arange(len(cp)), width)
    column = np.arange(at[-1]) - at[source]
    out = np.where(case[source], form[cp[source], column], cp[source]).astype(np.uint32)
    off = at[off]
    keys, composed = pairs()
    # an accent joins the letter before it; again while there are several accents on one letter
    while len(out) > 1:
        first = np.zeros(len(out) + 1, bool)
        first[off] = True
        accent = np.flatnonzero(((bits[out] & ACCENT) > 0) & ~first[:-1])
        accent = accent[(bits[out[accent - 1]] & ACCENT) == 0]
        key = out[accent - 1].astype(np.int64) << 21 | out[accent].astype(np.int64)
        slot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        ok = keys[slot] == key
        if not ok.any():
            break
        out[accent[ok] - 1] = composed[slot[ok]]
        keep = np.ones(len(out), bool)
        keep[accent[ok]] = False
        off = np.concatenate([[0], np.cumsum(keep)])[off]
        out = out[keep]
    return out, off


def affected(df: DataFrame, key: str, text: str) -> DataFrame:
    """record_id of the rows whose text has a case. Null and empty texts have none; rows repeated in full give one row; null keys are left out."""

    def scan(batches):
        for batch in batches:
            for a, _, cp, off in P.chunks(batch.column(1)):
                row = np.unique(P.rows_of(off)[judge(cp, off)])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + a))], ["record_id"])

    return spread(df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long"), text)).mapInArrow(scan, "record_id long").distinct()


def consistent(df: DataFrame, key: str, text: str) -> DataFrame:
    """(record_id, text): every row, its text in the consistent form; a null text stays null."""

    def scan(batches):
        for batch in batches:
            done = [P.strings(*usual(cp, off)) for _, _, cp, off in P.chunks(batch.column(1))]
            if done:
                whole = pa.concat_arrays(done)
                missing = batch.column(1).is_null()
                yield pa.RecordBatch.from_arrays([batch.column(0), pc.if_else(missing, pa.scalar(None, pa.string()), whole)], ["record_id", "text"])

    return spread(df.select(F.col(key).cast("long"), text)).mapInArrow(scan, "record_id long, text string")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = affected(read(spark, sf_dir, "documents"), "doc_id", "path")
    texts = affected(read(spark, sf_dir, "doc_segments"), "segment_row_id", "content")
    return paths.select(F.lit("path").alias("kind"), "record_id").union(texts.select(F.lit("segment").alias("kind"), "record_id"))


def p6_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = consistent(read(spark, sf_dir, "documents"), "doc_id", "path")
    texts = consistent(read(spark, sf_dir, "doc_segments"), "segment_row_id", "content")
    return paths.select(F.lit("path").alias("kind"), "record_id", "text").union(texts.select(F.lit("segment").alias("kind"), "record_id", "text"))


QUERIES = {"p6_found": p6_found, "p6_consistent": p6_consistent}
SQL: dict[str, str] = {}
