"""Problem 3: splitting oversized text at natural boundaries.

A recursive separator hierarchy (section and paragraph breaks and sentence ends, then blanks, then any character): the coarsest separator that
occurs inside the window of allowed ends decides, the greedy packer takes its last occurrence, and the next piece starts inside the one before by
the stated overlap. All boundaries of a batch are found at once on the code-point array; then every document's current piece is cut in the same
vector step, so the number of steps is the number of pieces of the longest document of the batch, not of all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import points as P
from .tables import read, spread

LIMIT, LOW, HIGH, OVERLAP = 1000, 400, 800, 0.15


def boundaries(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position p in 0..n: is p right after a natural end; right after a blank. Ends never look across rows."""
    n = len(cp)
    line = cp == 10
    blank = line | (cp == 32) | (cp == 9)
    first = np.zeros(n + 1, bool)
    first[off[:-1]] = True
    strong = np.zeros(n + 1, bool)
    soft = np.zeros(n + 1, bool)
    # after a run of line breaks: the next character is none, or another row starts
    strong[1:] = line & np.r_[~line[1:] | first[1:n], True] if n else False
    strong[1:] |= (cp == 0x3002) | (cp == 0xFF01) | (cp == 0xFF1F)
    mark = (cp == 46) | (cp == 33) | (cp == 63)
    if n > 1:
        strong[2:] |= mark[:-1] & blank[1:] & ~first[1:n]
    soft[1:] = blank
    return strong, soft


def last_at(flags: np.ndarray) -> np.ndarray:
    """For each position the last flagged position at or before it, else -1."""
    return np.maximum.accumulate(np.where(flags, np.arange(len(flags)), -1))


def pieces(cp: np.ndarray, off: np.ndarray, limit: int = LIMIT, low: int = LOW, high: int = HIGH, overlap: float = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of all pieces; rows within the limit are one piece, empty rows none."""
    strong, soft = map(last_at, boundaries(cp, off))
    rows = np.flatnonzero(np.diff(off) > 0)
    start = off[rows].copy()
    out = []
    while len(rows):
        more = off[rows + 1] - start > limit
        done = ~more
        out.append((rows[done], start[done], off[rows[done] + 1]))
        rows, start = rows[more], start[more]
        floor, top = start + low, start + high
        a, b = strong[top], soft[top]
        end = np.where(a >= floor, a, np.where(b >= floor, b, top))
        out.append((rows, start, end))
        start = end - np.floor(overlap * (end - start)).astype(np.int64)
    row, s, e = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3))
    o = np.lexsort((s, row))
    return row[o], s[o] - off[row[o]], e[o] - off[row[o]]


def split_long(df: DataFrame, key: str, text: str, limit: int = LIMIT, low: int = LOW, high: int = HIGH, overlap: float = OVERLAP) -> DataFrame:
    """(key, piece_start, piece_end) of every row with more than limit characters.

    Null and empty texts and texts within the limit give no row; a text without any boundary is cut at high. Repeated rows give repeated pieces;
    other columns are not read. Null keys are kept as null. The filter runs in the scan, the cutting without a shuffle.
    """
    if not (0 < low <= high <= limit and 0 <= overlap < 1 and low - int(overlap * low) >= 1):
        raise ValueError("0 < low <= high <= limit and 0 <= overlap < 1")

    def cut(batches):
        for batch in batches:
            ids = batch.column(0)
            for a, b, cp, off in P.chunks(batch.column(1)):
                row, s, e = pieces(cp, off, limit, low, high, overlap)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + a)), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], ["segment_row_id", "piece_start", "piece_end"])

    long = df.where(F.length(text) > limit).select(F.col(key).alias("segment_row_id"), F.col(text).alias("content"))
    return spread(long).mapInArrow(cut, f"segment_row_id {df.schema[key].dataType.simpleString()}, piece_start int, piece_end int")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_long(read(spark, sf_dir, "doc_segments"), "segment_row_id", "content")


QUERIES = {"p3_found": p3_found}
SQL: dict[str, str] = {
    # one step of the recursion cuts one piece; w holds the characters from two before the first allowed end to one behind the last
    "p3_found": r"""WITH RECURSIVE long AS (SELECT row_number() OVER () AS n, segment_row_id, content FROM doc_segments WHERE length(content) > 1000),
c AS (
  SELECT n, segment_row_id, content, 0 AS s, CAST(NULL AS INT) AS a, CAST(NULL AS INT) AS b FROM long
  UNION ALL
  SELECT n, segment_row_id, content, CASE WHEN e IS NULL THEN NULL ELSE e - CAST(floor(0.15 * (e - s)) AS INT) END, s, coalesce(e, CAST(length(content) AS INT)) FROM (
    SELECT *, CASE WHEN length(content) - s <= 1000 THEN NULL WHEN hard >= 2 THEN s + 398 + hard WHEN soft >= 2 THEN s + 398 + soft ELSE s + 800 END AS e FROM (
      SELECT *, CAST(greatest(length(regexp_extract(w, '(?s)^(.*\n)[^\n]', 1)), length(regexp_extract(v, '(?s)^(.*[。！？])', 1)), length(regexp_extract(v, '(?s)^(.*[.!?][ \t\n])', 1))) AS INT) AS hard, CAST(length(regexp_extract(v, '(?s)^(.*[ \t\n])', 1)) AS INT) AS soft FROM (
        SELECT *, substring(content, s + 399, 403) AS w, substring(content, s + 399, 402) AS v FROM c WHERE s IS NOT NULL))))
SELECT segment_row_id, a AS piece_start, b AS piece_end FROM c WHERE a IS NOT NULL""".replace("\\\\", "\\"),
}
