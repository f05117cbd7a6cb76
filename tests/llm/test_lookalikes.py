import pyarrow as pa
import pytest

from folioscan.llm import lookalikes as L
from folioscan.llm import points as P

CASES = {
    "ｆｕｌｌ": "full", "１２": "12", "café": "café", "a​b": "ab", "so­ft": "soft", "a b": "a b", "　": " ", "ﬁne": "fine", "𝐛𝐨𝐥𝐝": "bold", "⽉底": "月底", "buдget": None, "оn": "on", "ѕее": "see", "budgеt": "budget", "a‍b": "ab",
}
CLEAN = ["👩‍💻", "См. Счёт", "kΩ Δt μ", "（，）", "plain", "", "№ ℃ ™ ② Ⅶ", "café", "он был", "ß œ"]


@pytest.mark.parametrize("text,want", [(a, b) for a, b in CASES.items() if b])
def test_cases(text, want):
    ((_, _, cp, off),) = P.chunks(pa.array([text]))
    assert L.judge(cp, off).any()
    assert P.strings(*L.usual(cp, off)).to_pylist() == [want]


@pytest.mark.parametrize("text", CLEAN)
def test_clean(text):
    ((_, _, cp, off),) = P.chunks(pa.array([text]))
    assert not L.judge(cp, off).any() and P.strings(*L.usual(cp, off)).to_pylist() == [text]


def test_rows_do_not_mix_and_edges(spark):
    rows = [(1, "x", "👩"), (2, "‍x", "a"), (3, None, "a"), (4, "", "a"), (5, "e", "a"), (6, "́x", "a"), (2, "‍x", "a"), (None, "ｘ", "a"), (7, "ok " * 200_000 + "ｘ", "a")]
    df = spark.createDataFrame(rows, "segment_row_id long, content string, record_id string")
    assert sorted(r[0] for r in L.affected(df, "segment_row_id", "content").collect()) == [2, 6, 7]
    out = {r[0]: r[1] for r in L.consistent(df, "segment_row_id", "content").collect()}
    assert out[2] == "x" and out[3] is None and out[4] == "" and out[5] == "e" and len(out[7]) == 600_001
    assert L.affected(df.where("false"), "segment_row_id", "content").count() == 0


def test_idempotent(spark):
    text = "".join(chr(i) for i in range(0x20, 0x3000) if not 0xD800 <= i < 0xE000)
    ((_, _, cp, off),) = P.chunks(pa.array([text]))
    once = L.usual(cp, off)
    assert P.strings(*L.usual(*once)).equals(P.strings(*once))
