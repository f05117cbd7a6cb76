import re

from hypothesis import given, settings
from hypothesis import strategies as st

from folioscan.llm import points as P
from folioscan.llm.split import pieces, split_long


def brute(t: str) -> list[tuple[int, int]]:
    strong = {m.end() for p in (r"\n+", "[。！？]", r"[.!?][ \t\n]") for m in re.finditer(p, t)}
    soft = {m.end() for m in re.finditer(r"[ \t\n]", t)}
    out, s = [], 0
    while len(t) - s > 1000:
        span = range(s + 800, s + 399, -1)
        e = next((p for p in span if p in strong), None) or next((p for p in span if p in soft), None) or s + 800
        out.append((s, e))
        s = e - int(0.15 * (e - s))
    return [*out, (s, len(t))]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("ab c.!?。！\n\t😀", min_size=0, max_size=40).map(lambda x: x * 60), min_size=1, max_size=4))
def test_equals_brute_force(texts):
    import pyarrow as pa

    got = {}
    for a, _, cp, off in P.chunks(pa.array(texts)):
        for r, s, e in zip(*map(lambda x: x.tolist(), pieces(cp, off))):
            got.setdefault(r + a, []).append((s, e))
    assert got == {i: brute(t) for i, t in enumerate(texts) if t}


def test_edges(spark, prose):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a" * 1000, "x"), (4, "b" * 2500, "x"), (4, "b" * 2500, "x"), (None, prose(1500, 1), "x"), (5, prose(200_000, 2), "x")]
    df = spark.createDataFrame(rows, "segment_row_id long, content string, piece_start string")
    got = split_long(df, "segment_row_id", "content").collect()
    by = {}
    for r in got:
        by.setdefault(r[0], []).append((r[1], r[2]))
    assert set(by) == {4, 5, None}
    assert sorted(by[4]) == sorted(brute("b" * 2500) * 2)
    assert sorted(by[5]) == brute(rows[-1][1])
    assert split_long(df.where("false"), "segment_row_id", "content").count() == 0
