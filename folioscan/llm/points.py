"""Arrow text as numpy code points, and position-free hashes of substrings.

Everything here works on whole Arrow batches: one UTF-32 array for all rows, row borders as offsets, no Python loop over rows or characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Characters worked on at once; bounds the temporaries of a task, splits no row.
CHUNK_CHARS = 1 << 19


def plain(column) -> pa.Array:
    """One contiguous Array with offset 0, nulls as empty strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return pc.fill_null(column.cast(pa.large_string()), "")


def chunks(column: pa.Array, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, code points, offsets) of runs of rows with about limit characters; a longer row is a run of its own."""
    column = plain(column)
    n = len(column)
    if not n:
        return
    chars = np.concatenate([[0], np.cumsum(pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64))])
    data = column.buffers()[2]
    at = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :]
    view = memoryview(data) if data is not None else memoryview(b"")
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(chars, chars[a] + limit, "right")) - 1)
        text = str(view[at[a] : at[b]], "utf-8")
        yield a, b, np.frombuffer(text.encode("utf-32-le"), np.uint32), chars[a : b + 1] - chars[a]
        a = b


def strings(points: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The inverse of chunks for one run: an Arrow string array."""
    points = np.ascontiguousarray(points, np.uint32)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    at = np.concatenate([[0], np.cumsum(width)])[offsets].astype(np.int64)
    data = points.tobytes().decode("utf-32-le").encode("utf-8")
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(at.tobytes()), pa.py_buffer(data)).cast(pa.string())


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each character."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply, after Stafford's published mix 13)."""
    x = np.asarray(x).astype(U64)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@cache
def _grown(base: int, bits: int) -> np.ndarray:
    out = np.ones(1 << bits, U64)
    if bits:
        half = _grown(base, bits - 1)
        out[: len(half)] = half
        out[len(half) :] = half * U64(pow(base, len(half), 1 << 64))
    return out


def powers(base: int, n: int) -> np.ndarray:
    return _grown(base, max(16, int(n).bit_length()))[:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """S with S[e]-S[s] = sum of values[j] * BASE**j for s <= j < e, modulo 2**64."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(mix(values.astype(U64) + U64(1)) * powers(BASE, len(values)), out=out[1:])
    return out


def raw(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The polynomials of [start, end), before they are mixed."""
    return (sums[ends] - sums[starts]) * powers(INVERSE, len(sums))[starts]


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of [start, end), equal for equal content wherever it stands."""
    return mix(raw(sums, starts, ends))


def joined(sums: np.ndarray, one: tuple, two: tuple, between: str = "") -> np.ndarray:
    """The hashes that the texts of two spans (starts, ends) would have, put together with the same text between them."""
    out, size = raw(sums, *one), one[1] - one[0]
    for c in between:
        out = out + mix(np.array([ord(c) + 1])) * powers(BASE, int(size.max(initial=0)) + 1)[size]
        size = size + 1
    return mix(out + raw(sums, *two) * powers(BASE, int(size.max(initial=0)) + 1)[size])


def grams(points: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k characters from each position that has so many (borders of rows are the caller's)."""
    if len(points) < k:
        return np.zeros(0, U64)
    sums = prefix(points)
    n = len(points) - k + 1
    return mix((sums[k:] - sums[:n]) * powers(INVERSE, n))


def window_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values (van Herk: running minima from both sides of blocks)."""
    n = len(values)
    if n < w:
        return values[:0]
    full = -(-n // w) * w
    padded = np.full(full, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def ragged(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All integers of all [start, end), in order."""
    lengths = np.maximum(ends - starts, 0)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(first, lengths) + np.repeat(starts, lengths)
