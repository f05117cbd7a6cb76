"""Problem 7: held-out items inside a training corpus.

Texts become sequences of units (one ideograph, or a run of other letters and digits). Every window of SPAN consecutive units, of items and of
corpus texts, is embedded by the CGK random walk (Chakraborty, Goldenberg, Koucky 2016): step j copies the unit under the cursor and moves the
cursor on by a random bit drawn for (j, unit), so windows at a small edit distance agree in most of the output. Bit sampling of the output gives
the LSH keys; windows that share a key are verified by their exact edit distance (banded). The number of repetitions follows from the target recall and
the share of keys that item windows keep when as many edits are put into them; without edits all outputs agree and one repetition has recall 1.

The walk runs over all windows of a batch at once and stops early: after each sampled position only windows whose outputs so far are a prefix of
some item key go on, so beyond the first position only a small part of the corpus is walked. Item keys are read by blocks of bounded size; the
corpus is never shuffled.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import points as P
from .tables import read, spread

SPAN = 15
#: Sampled positions of a repetition, and the share of the leaks that the repetitions must find.
SAMPLES, RECALL = 3, 0.99
MOST_REPETITIONS = 200
#: Edits of p7_near.
DISTANCE = 2
#: Windows verified at once.
PAIRS = 1 << 15
PAD = np.uint64(0x5DEECE66D)
#: Items of one pass over the corpus; their index is what a task holds (some MB). More items mean more passes.
ITEM_BLOCK = 20_000
SEP, WORD, IDEOGRAPH = 0, 1, 2
IDEOGRAPHS = ((0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))


@cache
def classes() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of every code point (characters whose lower case has several characters stay)."""
    n = 0x110000
    kind = np.fromiter((chr(i).isalnum() for i in range(n)), np.uint8, n)
    low = np.arange(n, dtype=np.uint32)
    for i in np.flatnonzero(kind):
        x = chr(i).lower()
        if len(x) == 1:
            low[i] = ord(x)
    for a, b in IDEOGRAPHS:
        kind[a : b + 1] = np.where(kind[a : b + 1] == WORD, IDEOGRAPH, kind[a : b + 1])
    return kind, low


def units(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the units, in order."""
    kind, low = classes()
    k = kind[cp]
    n = len(cp)
    edge = np.ones(n + 1, bool)
    edge[1:n] = (k[1:] != k[:-1]) | (k[1:] == IDEOGRAPH)
    edge[off] = True
    starts = np.flatnonzero(edge[:n])
    ends = np.r_[starts[1:], n]
    keep = k[starts] != SEP
    starts, ends = starts[keep], ends[keep]
    return P.spans(P.prefix(low[cp]), starts, ends), np.searchsorted(off, starts, "right") - 1


def windows(row: np.ndarray, span: int) -> np.ndarray:
    """First units of the windows that lie inside one row."""
    n = len(row) - span + 1
    return np.flatnonzero(row[:n] == row[span - 1 :]) if n > 0 else np.zeros(0, np.int64)


def repetitions(recall: float, hit: np.ndarray | float) -> int:
    """Repetitions after which pairs that share a key in one repetition with probability `hit` (each its own) share one with the mean recall wanted."""
    hit = np.minimum(np.atleast_1d(np.asarray(hit, float)), 1 - 1e-12)
    r = 1
    while np.mean(1 - (1 - hit) ** r) < recall and r < MOST_REPETITIONS:
        r += 1
    return r


def positions(span: int, samples: int, seed: int, distance: int) -> np.ndarray:
    """Sampled output positions of one repetition. A walk of span units is sure to stay inside them for span steps.

    Windows that must be equal agree in the first position, which then is the cheapest filter; else any position may be the first.
    """
    rng = np.random.default_rng(seed)
    if not distance:
        return np.r_[0, 1 + np.sort(rng.choice(span - 1, min(samples, span) - 1, replace=False))]
    return np.sort(rng.choice(span, min(samples, span), replace=False))


def walk(u: np.ndarray, row: np.ndarray, starts: np.ndarray, at: np.ndarray, seed: int, known: list[np.ndarray] | None = None):
    """Keys of the windows at the sampled positions. With known (sorted keys of each prefix), only windows that stay in them: (starts, keys).

    Beyond the end of a row the walk reads a unit of its own kind, as the embedding pads with a sign outside the alphabet.
    """
    cursor, key, j, last = starts.copy(), np.zeros(len(starts), np.uint64), 0, len(u) - 1
    for level, stop in enumerate(at):
        while j < stop:
            bit = P.mix(_read(u, row, starts, cursor, last) ^ np.uint64((seed * 1000 + j + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(63)
            cursor = cursor + bit.astype(np.int64)
            j += 1
        key = P.mix(key * np.uint64(P.BASE) + _read(u, row, starts, cursor, last))
        if known is not None:
            slot = np.minimum(np.searchsorted(known[level], key), len(known[level]) - 1)
            ok = known[level][slot] == key
            starts, cursor, key = starts[ok], cursor[ok], key[ok]
    return starts, key


def _read(u: np.ndarray, row: np.ndarray, starts: np.ndarray, cursor: np.ndarray, last: int) -> np.ndarray:
    at = np.minimum(cursor, last)
    return np.where((cursor <= last) & (row[at] == row[starts]), u[at], PAD)


def edits(u: np.ndarray, row: np.ndarray, s: np.ndarray, item: np.ndarray, t: np.ndarray, span: int, most: int) -> np.ndarray:
    """Edit distance of the item window at t (span units) and the nearest stretch of the text that begins at s; most + 1 for more. Banded."""
    far, wide, last = most + 1, 2 * most + 1, len(u) - 1
    # column b stands for the first i - most + b units of the text
    now = np.tile(np.where(np.arange(wide) >= most, np.arange(wide) - most, far), (len(s), 1)).astype(np.int16)
    for i in range(span):
        nxt = np.full_like(now, far)
        for b in range(wide):
            j = i - most + b  # the text unit that is read against item unit i
            if j >= 0:
                at = np.minimum(s + j, last)
                same = (s + j <= last) & (row[at] == row[s]) & (u[at] == item[t + i])
                nxt[:, b] = now[:, b] + ~same
            if b + 1 < wide:
                nxt[:, b] = np.minimum(nxt[:, b], now[:, b + 1] + 1)
            if b and j >= 0:
                nxt[:, b] = np.minimum(nxt[:, b], nxt[:, b - 1] + 1)
        now = np.minimum(nxt, far)
    return now.min(1)


class ItemIndex:
    """LSH tables over the windows of a block of items, as flat sorted arrays."""

    def __init__(self, ids: list[int], texts: list[str], span: int = SPAN, distance: int = 0, samples: int = SAMPLES, recall: float = RECALL):
        parts = [(a, *units(cp, off)) for a, _, cp, off in P.chunks(pa.array(texts, pa.string()))]
        u = np.concatenate([x[1] for x in parts]) if parts else np.zeros(0, np.uint64)
        row = np.concatenate([x[2] + x[0] for x in parts]) if parts else np.zeros(0, np.int64)
        starts = windows(row, span)
        self.span, self.distance, self.ids = span, distance, np.array(ids, np.int64)
        self.units, self.tables, self.gate = u, [], None
        # units of the items, by 16 bits of their hashes
        self.own = np.zeros(1 << 16, bool)
        self.own[(np.unique(u) & np.uint64(0xFFFF)).astype(np.int64)] = True
        if not distance:
            first = np.unique(u[starts])
            self.gate = np.zeros(1 << 16, bool)
            self.gate[(first & np.uint64(0xFFFF)).astype(np.int64)] = True
        for seed in range(repetitions(recall, agreement(u, starts, span, distance, samples)) if len(starts) else 0):
            at = positions(span, samples, seed, distance)
            known = [np.unique(walk(u, row, starts, at[: i + 1], seed)[1]) for i in range(len(at))]
            s, key = walk(u, row, starts, at, seed)
            o = np.argsort(key, kind="stable")
            self.tables.append((at, seed, known, key[o], s[o], row[s[o]]))

    def hits(self, u: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Distinct (row, item slot) pairs of the corpus units, verified by the edit distance of the windows."""
        found = [np.zeros((0, 2), np.int64)]
        starts = windows(row, max(1, self.span - self.distance))
        if self.gate is not None:
            starts = starts[self.gate[(u[starts] & np.uint64(0xFFFF)).astype(np.int64)]]
        elif len(starts):
            # all but `distance` of an item window's units stand in the stretch that it is near to, which has that many more at most
            count = np.concatenate([[0], np.cumsum(self.own[(u & np.uint64(0xFFFF)).astype(np.int64)])])
            end = np.minimum(starts + self.span + self.distance, len(u))
            starts = starts[count[end] - count[starts] >= self.span - self.distance]
        for at, seed, known, keys, item_start, item_row in self.tables:
            if not len(starts):
                continue
            s, key = walk(u, row, starts, at, seed, known)
            lo, hi = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
            for a in range(0, len(s), PAIRS):
                i = P.ragged(lo[a : a + PAIRS], hi[a : a + PAIRS])
                t = np.repeat(s[a : a + PAIRS], (hi - lo)[a : a + PAIRS])
                ok = edits(u, row, t, self.units, item_start[i], self.span, self.distance) <= self.distance
                found.append(np.unique(np.stack([row[t[ok]], item_row[i[ok]]], 1), axis=0))
        return np.unique(np.concatenate(found), axis=0)


def agreement(u: np.ndarray, starts: np.ndarray, span: int, distance: int, samples: int, pairs: int = 400, seeds: int = 48) -> np.ndarray | float:
    """For item windows with `distance` random edits put in: the share of repetitions in which each still has its key. 1 without edits."""
    if not distance:
        return 1.0
    rng = np.random.default_rng(13)
    alphabet, rows = np.unique(u), []
    pick = rng.choice(starts, pairs)
    for s in pick:
        w = list(u[s : s + span])
        for _ in range(distance):
            kind, i = rng.integers(3), int(rng.integers(len(w)))
            if kind == 0:
                w[i] = alphabet[rng.integers(len(alphabet))]
            elif kind == 1:
                w.insert(i, alphabet[rng.integers(len(alphabet))])
            else:
                del w[i]
        rows.append(w + list(u[s + span : s + 2 * span - len(w) + distance]))
    v, vrow = np.concatenate([np.array(r, np.uint64) for r in rows]), np.repeat(np.arange(pairs), [len(r) for r in rows])
    begin = np.searchsorted(vrow, np.arange(pairs))
    w, wrow = np.concatenate([u[s : s + span] for s in pick]), np.repeat(np.arange(pairs), span)
    same = np.zeros(pairs)
    for seed in range(seeds):
        at = positions(span, samples, seed, distance)
        same += walk(v, vrow, begin, at, seed)[1] == walk(w, wrow, np.arange(pairs) * span, at, seed)[1]
    return same / seeds


def leaks(corpus: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", span: int = SPAN, distance: int = 0, recall: float = RECALL) -> DataFrame:
    """(key, item_id) of every corpus text that holds span consecutive units of an item's text with at most `distance` units changed, put in or left out.

    With distance 0 all are found, else the share `recall` of those with just so many edits, and more of those with fewer.

    Null and empty texts, and items shorter than span units, take part in no row. Repeated corpus or item rows give one row per (key, item).
    Items are read in blocks of ITEM_BLOCK (one pass over the corpus each); nothing is shuffled but the few resulting pairs.
    """
    spark = corpus.sparkSession
    rows = items.where(f"{item_text} is not null and {item_key} is not null").select(item_key, item_text).distinct().orderBy(item_key)
    schema = f"{key} {corpus.schema[key].dataType.simpleString()}, item_id bigint"
    texts = spread(corpus.where(f"{text} is not null").select(key, text))

    def one(index: ItemIndex) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)

        def scan(batches):
            index = shared.value
            for batch in batches:
                for a, _, cp, off in P.chunks(batch.column(1)):
                    hit = index.hits(*units(cp, off))
                    if len(hit):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hit[:, 0] + a)), pa.array(index.ids[hit[:, 1]])], [key, "item_id"])

        return texts.mapInArrow(scan, schema)

    found, block = None, []
    for r in rows.toLocalIterator():
        block.append(r)
        if len(block) == ITEM_BLOCK:
            part = one(ItemIndex([int(x[0]) for x in block], [x[1] for x in block], span, distance, recall=recall))
            found, block = part if found is None else found.unionByName(part), []
    if block or found is None:
        part = one(ItemIndex([int(x[0]) for x in block], [x[1] for x in block], span, distance, recall=recall))
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"))


def p7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"), distance=DISTANCE)


QUERIES = {"p7_found": p7_found, "p7_near": p7_near}
_UNITS = r"regexp_extract_all(regexp_replace(lower(text), '([\x{3400}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{323af}])', ' \1 ', 'g'), '[\pL\pN]+')"
_WINDOWS = "(SELECT DISTINCT {id}, array_to_string(u[i : i + 14], ' ') AS w FROM (SELECT {id}, u, unnest(range(1, len(u) - 13)) AS i FROM (SELECT {id}, {units} AS u FROM {table} WHERE text IS NOT NULL) WHERE len(u) >= 15))"
SQL: dict[str, str] = {
    "p7_found": f"SELECT DISTINCT doc_id, item_id FROM {_WINDOWS.format(id='doc_id', units=_UNITS, table='documents')} JOIN {_WINDOWS.format(id='item_id', units=_UNITS, table='eval_items')} USING (w)",
}
