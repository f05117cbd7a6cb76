"""Passages for vectors: pieces of about `target` characters that end at a line or sentence end, each beginning inside the one before."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET, MOST, OVERLAP = 800, 1000, 0.15
ENDS = re.compile(r"\n+|[。！？]|[.!?](?=\s)")


def bounds(text: str, target: int = TARGET, most: int = MOST, overlap: float = OVERLAP, fits: Callable[[str], bool] | None = None) -> list[tuple[int, int]]:
    """(start, end) of the passages; a rest of at most `most` is taken whole. fits: whether an encoder takes a passage; longer ones are halved to fit."""
    out, start, n = [], 0, len(text)
    ends = [m.end() for m in ENDS.finditer(text)] if n > most else []
    at = 0
    while start < n:
        if n - start <= most:
            end = n
        else:
            while at < len(ends) and ends[at] < start + target // 2:
                at += 1
            i, end = at, start + target
            best = None
            while i < len(ends) and ends[i] <= start + target:
                best = ends[i]
                i += 1
            end = best or end
        if fits is not None and not fits(text[start:end]):
            low, high = start + 1, end
            while low < high:  # the longest part that fits
                mid = (low + high + 1) // 2
                low, high = (mid, high) if fits(text[start:mid]) else (low, mid - 1)
            end = low
        out.append((start, end))
        if end >= n:
            break
        back = max(1, round((end - start) * overlap))
        start = max(start + 1, end - back)
    return out


def chunked(df: DataFrame, key: str = "segment_row_id", text: str = "content", encoder=None) -> DataFrame:
    """(key, start, end, text) of every passage of texts that are not blank; null texts have none."""

    def cut(batches):
        fits = None if encoder is None else lambda t: encoder.token_count(t) <= encoder.max_tokens
        for batch in batches:
            ids, rows = batch.column(0), []
            for i, t in enumerate(batch.column(1).to_pylist()):
                rows += [(i, a, b, t[a:b]) for a, b in bounds(t, fits=fits)]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.string())], [key, "start", "end", "text"])

    rows = df.where(F.length(F.trim(text)) > 0).select(key, text)
    return rows.mapInArrow(cut, f"{key} {df.schema[key].dataType.simpleString()}, start int, end int, text string")
