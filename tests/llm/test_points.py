import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscan.llm import points as P

TEXT = st.text(st.characters(codec="utf-8"), max_size=30)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.integers(1, 40))
def test_round_trip(rows, limit):
    column = pa.array(["skipped", *rows], pa.string()).slice(1)
    out = []
    for a, b, cp, off in P.chunks(column, limit):
        assert len(off) == b - a + 1 and off[0] == 0 and off[-1] == len(cp)
        out += P.strings(cp, off).to_pylist()
    assert out == [r or "" for r in rows]


@settings(max_examples=60, deadline=None)
@given(st.text("ab😀", min_size=0, max_size=40), st.integers(1, 6))
def test_equal_substrings_have_equal_hashes(text, k):
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    h = P.grams(cp, k)
    parts = [text[i : i + k] for i in range(len(text) - k + 1)]
    assert len(h) == len(parts)
    assert len(set(zip(parts, h.tolist()))) == len(set(parts)) == len(set(h.tolist()))
    s = np.arange(len(parts))
    assert (P.spans(P.prefix(cp), s, s + k) == h).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=40), st.integers(1, 9))
def test_window_min(values, w):
    x = np.array(values, np.uint64)
    assert P.window_min(x, w).tolist() == [min(values[i : i + w]) for i in range(len(values) - w + 1)]


def test_ragged():
    assert P.ragged(np.array([3, 7, 9]), np.array([5, 7, 12])).tolist() == [3, 4, 9, 10, 11]
    assert P.ragged(np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []
