"""Problem 9: long exact spans shared between records, by relative Lempel-Ziv parsing.

* Reference blocks. Winnowing picks the least hash of every SPAN-K+1 consecutive K-character blocks, so any two equal substrings of SPAN characters pick
  the same block at the same place. A block that texts of two records hold is indexed, with the text around it, as it stands in the record of least
  and of greatest key: two references for a block, however many records hold it.
* Parsing. Each text is factored against the references of every indexed block it holds: a factor grows greedily, character by character, from the block
  to both sides for as long as the text agrees with the reference. Factors of SPAN characters and more are duplicate spans of the text, compared by text.
* Factor boundaries. Two records can share with each other what neither shares with a reference. Such windows of SPAN characters are not inside the
  factors of both references, so only these, which lie across the ends of factors, are compared among all records, by their 64-bit hashes. A record that
  is itself a reference counts only the factors of the other one; what it shares with third records alone is such a window on both sides.

A block that a third of all records hold is counted by partial least and greatest keys, is joined with one row, which lets adaptive execution split its
side, and is compared with two texts, not with all of its records.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import points as P
from .tables import cut, prune, read, spread

SPAN, BLOCK = 300, 200
#: Rows compared at once.
ROWS = 2048
PLACE = np.uint64((1 << 28) - 1)


def blocks(cp: np.ndarray, off: np.ndarray, span: int, k: int) -> tuple[np.ndarray, ...]:
    """The reference blocks of the SPAN-windows: (row, place, first window, last window, hash); of equal hashes in a window the leftmost counts."""
    h = P.grams(cp, k)
    # the upper 36 bits of the hash decide, then the place
    least = P.window_min((h & ~PLACE) | np.arange(len(h), dtype=np.uint64), span - k + 1)
    row = P.rows_of(off)
    start = np.flatnonzero(row[: len(least)] == row[span - 1 : span - 1 + len(least)])
    if not len(start):
        return (start,) * 4 + (h[:0],)
    at = (least[start] & PLACE).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (row[start[1:]] != row[start[:-1]])])
    last = np.r_[new[1:], len(start)] - 1
    return row[start[new]], at[new], start[new], start[last], h[at[new]]


def agreeing(own: tuple, other: tuple, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Characters that agree to the left and to the right of the blocks' starts. Sides: (code points, offsets, place of the block in each row)."""
    (x, xo, xp), (y, yo, yp) = own, other
    a, b = xo[:-1] + xp, yo[:-1] + yp

    def run(step: np.ndarray, size: np.ndarray) -> np.ndarray:
        i, j = a[:, None] + step, b[:, None] + step
        same = np.abs(step + (step < 0)) < size[:, None]
        same &= x[np.clip(i, 0, max(len(x) - 1, 0))] == y[np.clip(j, 0, max(len(y) - 1, 0))]
        return np.where(same.all(1), len(step), np.argmin(same, axis=1))

    left = run(-np.arange(1, span + 1), np.minimum(xp, yp))
    return left, run(np.arange(span), np.minimum(xo[1:] - a, yo[1:] - b))


def shared_spans(df: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, block: int = BLOCK) -> DataFrame:
    """(key, span_start, span_end): the longest runs of characters that lie in a substring of at least span characters which another key's text holds too.

    Texts that are null, empty or shorter than span give no row; a repetition inside one text alone is none. Rows repeated under the same key count as
    one record; null keys take no part. Offsets count code points. Other columns are not read.
    """
    kind = df.schema[key].dataType.simpleString()
    texts = df.where(F.col(key).isNotNull() & (F.length(text) >= span)).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    reach = span - block

    def index(batches):
        for batch in batches:
            for a, _, cp, off in P.chunks(batch.column(1)):
                row, _, _, _, h = blocks(cp, off, span, block)
                row, h = distinct(row, h)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + a)), pa.array(h.view(np.int64))], ["_key", "_block"])

    held = cut(spread(texts).mapInArrow(index, f"_key {kind}, _block long"))
    indexed = cut(held.groupBy("_block").agg(F.min("_key").alias("_one"), F.max("_key").alias("_two")).where("_one <> _two"))
    wanted = prune(held, indexed, "_block").join(indexed, "_block").groupBy("_key").agg(F.collect_set("_block").alias("_blocks"))
    wanted = cut(wanted)

    def places(batches):
        for batch in batches:
            lists = batch.column(2)
            at = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            for a, b, cp, off in P.chunks(batch.column(1)):
                row, place, first, last, h = blocks(cp, off, span, block)
                known = np.unique(P.mix(flat[at[a] : at[b]] ^ P.mix(np.repeat(np.arange(a, b), np.diff(at[a : b + 1])))))
                mine = P.mix(h ^ P.mix(row + a))
                keep = known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine
                row, place, first, last, h = row[keep], place[keep], first[keep], last[keep], h[keep]
                begin, end = np.maximum(place - reach, off[row]), np.minimum(place + span, off[row + 1])
                around = P.strings(cp[P.ragged(begin, end)], np.r_[0, np.cumsum(end - begin)])
                base = off[row]
                numbers = [pa.array(v.astype(np.int32)) for v in (place - base, first - base, last - base, place - begin)]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).take(pa.array(row + a)), *numbers, around], ["_block", "_key", "_place", "_first", "_last", "_lead", "_around"])

    rest = prune(texts, wanted, "_key").join(wanted, "_key").select("_key", "_text", "_blocks")
    found = cut(rest.mapInArrow(places, f"_block long, _key {kind}, _place int, _first int, _last int, _lead int, _around string"))
    # the references: the first place of the block in the records of least and greatest key
    ends = found.join(indexed, "_block").where("_key = _one or _key = _two")
    one, two = (F.min(F.when(F.col("_key") == F.col(c), F.struct("_place", "_lead", "_around"))) for c in ("_one", "_two"))
    refs = ends.groupBy("_block").agg(F.first("_one").alias("_one"), F.first("_two").alias("_two"), one.alias("a"), two.alias("b"))
    refs = refs.select("_block", "_one", "_two", *(F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("_lead", "_around")))
    side = found.join(refs, "_block").withColumns({"_is_a": F.col("_key") == F.col("_one"), "_is_b": F.col("_key") == F.col("_two")})

    def factor(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                yield factored(batch.slice(s, ROWS), span, block)

    columns = ["_key", "_place", "_first", "_last", "_lead", "_around", "_lead_a", "_around_a", "_lead_b", "_around_b", "_is_a", "_is_b"]
    parsed = cut(side.select(*columns).mapInArrow(factor, f"_key {kind}, _start int, _end int, _hash long"))
    across = parsed.where("_hash is not null")
    both = across.groupBy("_hash").agg(F.min("_key").alias("_one"), F.max("_key").alias("_two")).where("_one <> _two").select("_hash")
    more = prune(across, both, "_hash").join(both, "_hash").select("_key", "_start", "_end")
    spans = parsed.where("_hash is null").select("_key", "_start", "_end").union(more)
    lists = spans.groupBy("_key").agg(F.sort_array(F.collect_set(F.struct("_start", "_end"))).alias("_spans"))

    def runs(batches):
        for batch in batches:
            row = P.rows_of(batch.column(1).offsets.to_numpy().astype(np.int64) - batch.column(1).offsets[0].as_py())
            if not len(row):
                continue
            pairs = batch.column(1).flatten()
            s, e = (pairs.field(i).to_numpy().astype(np.int64) for i in (0, 1))
            # the running greatest end inside a row: rows are far apart on the shifted axis
            far = int(e.max()) + 1
            reached = np.maximum.accumulate(e + row * far)
            new = np.flatnonzero(np.r_[True, s[1:] + row[1:] * far > reached[:-1]])
            end = reached[np.r_[new[1:], len(s)] - 1] - row[new] * far
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[new])), pa.array(s[new].astype(np.int32)), pa.array(end.astype(np.int32))], [key, "span_start", "span_end"])

    return lists.mapInArrow(runs, f"{key} {kind}, span_start int, span_end int")


def factored(batch: pa.RecordBatch, span: int, block: int) -> pa.RecordBatch:
    """The factors of span characters and more (hash null), and the windows outside of the factors of both references with their hashes."""
    col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
    place, first, last = (col[c].to_numpy().astype(np.int64) for c in ("_place", "_first", "_last"))
    sides = []
    for s in ("", "_a", "_b"):
        _, _, cp, off = next(P.chunks(col["_around" + s], 1 << 62))
        sides.append((cp, off, col["_lead" + s].to_numpy().astype(np.int64)))
    starts, ends, owner = [], [], []
    inside = []
    for other, mine in ((sides[1], col["_is_a"]), (sides[2], col["_is_b"])):
        left, right = agreeing(sides[0], other, span)
        a, b = np.maximum(first, place - left), np.minimum(last, place + right - span)
        b = np.where(right < block, a - 1, b)  # another block with the same hash
        inside.append((a, b))
        i = np.flatnonzero((a <= b) & ~mine.to_numpy(zero_copy_only=False))
        owner.append(i)
        starts.append(a[i])
        ends.append(b[i] + span)
    (a, b), (c, d) = inside
    lo, hi = np.maximum(a, c), np.minimum(b, d)
    lo, hi = np.where(lo > hi, last + 1, lo), np.where(lo > hi, last, hi)
    i = np.r_[np.repeat(np.arange(len(first)), np.maximum(lo - first, 0)), np.repeat(np.arange(len(first)), np.maximum(last - hi, 0))]
    s = np.r_[P.ragged(first, lo), P.ragged(hi + 1, last + 1)]
    cp, off, lead = sides[0]
    local = off[i] + lead[i] + s - place[i]
    h = P.spans(P.prefix(cp), local, local + span).view(np.int64) if len(s) else np.zeros(0, np.int64)
    done = sum(map(len, owner))
    who = np.r_[tuple(owner) + (i,)].astype(np.int64)
    hashes = pa.array(np.r_[np.zeros(done, np.int64), h], mask=np.r_[np.ones(done, bool), np.zeros(len(h), bool)])
    start, end = np.r_[tuple(starts) + (s,)], np.r_[tuple(ends) + (s + span,)]
    return pa.RecordBatch.from_arrays([col["_key"].take(pa.array(who)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), hashes], ["_key", "_start", "_end", "_hash"])


def distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs; rows are ascending and equal hashes mostly adjoin."""
    new = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
    row, h = row[new], h[new]
    o = np.lexsort((h, row))
    row, h = row[o], h[o]
    new = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
    return row[new], h[new]


def coverage(df: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """(key, n_chars, shared_chars, shared_ratio) of every record, 0 where nothing is shared; a null text has 0 characters and the ratio 0."""
    held = shared_spans(df, key, text, span).groupBy(key).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    all_ = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.coalesce(F.max(F.length(text)), F.lit(0)).cast("long").alias("n_chars"))
    shared = F.coalesce("shared_chars", F.lit(0)).cast("long")
    return all_.join(held, key, "left").select(key, "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, F.round(shared / F.col("n_chars"), 6)).otherwise(0.0).alias("shared_ratio"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(read(spark, sf_dir, "documents"))


def p9_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(read(spark, sf_dir, "documents"))


QUERIES = {"p9_found": p9_found, "p9_coverage": p9_coverage}
_SPANS = """WITH w AS (SELECT doc_id, i - 1 AS p, substring(text, i, 300) AS t FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300)),
h AS (SELECT DISTINCT doc_id, p FROM w JOIN (SELECT t FROM w GROUP BY t HAVING count(DISTINCT doc_id) > 1) USING (t)),
f AS (SELECT *, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 300 OR lag(p) OVER (PARTITION BY doc_id ORDER BY p) IS NULL THEN 1 ELSE 0 END AS n FROM h),
g AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM f),
r AS (SELECT doc_id, CAST(min(p) AS INT) AS span_start, CAST(max(p) + 300 AS INT) AS span_end FROM g GROUP BY doc_id, run)
"""
SQL: dict[str, str] = {
    "p9_found": _SPANS + "SELECT doc_id, span_start, span_end FROM r",
    "p9_coverage": _SPANS + "SELECT d.doc_id, CAST(coalesce(length(text), 0) AS BIGINT) AS n_chars, CAST(coalesce(c, 0) AS BIGINT) AS shared_chars, CASE WHEN coalesce(length(text), 0) > 0 THEN round(coalesce(c, 0) / length(text), 6) ELSE 0e0 END AS shared_ratio FROM documents d LEFT JOIN (SELECT doc_id, sum(span_end - span_start) AS c FROM r GROUP BY doc_id) USING (doc_id)",
}
