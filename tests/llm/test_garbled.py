import pytest

from folioscan.llm import garbled as G

CLEAN = ["La réunion régulière a été vérifiée après l’année.", "Die Prüfung für die städtische Straße über 20 Stück.", "秘書室依據年度場地修正相關維護，請各單位配合。", "推動小組就最新檢查比較既有獎勵，由專人負責。", "The “quarterly” register — see B-1."]


@pytest.mark.parametrize("chain", G.CHAINS)
def test_round_trip(chain):
    for text in CLEAN:
        form = G.garble(text, chain)
        if form is not None and form != text and "�" not in form:
            assert G.restore(form, chain) == text


def frame(spark, extra):
    rows = [(i, CLEAN[i % len(CLEAN)], "x") for i in range(60)] + extra
    return spark.createDataFrame(rows, "segment_row_id long, content string, token string")


def test_finds_and_restores(spark):
    pairs = [(("utf-8", "ansi"), 0), (("utf-8", "latin-1"), 1), (("utf-8", "cp437"), 1), (("utf-8", "gb18030"), 2), (("gb18030", "latin-1"), 3), (("big5", "gb18030"), 2), (("ansi", "mac_roman"), 0), (("utf-8", "ansi"), 4)]
    bad = [(100 + i, "Plain words. " + G.garble(CLEAN[t], (step,)), "x") for i, (step, t) in enumerate(pairs)]
    extra = [*bad, (200, "lost � here", "x"), (201, None, "x"), (202, "", "x"), (203, "plain ascii", "x"), (None, "Ã©", "x"), (100, bad[0][1], "x")]
    df = frame(spark, extra)
    assert sorted(r[0] for r in G.garbled(df).collect()) == [*range(100, 108), 200]
    back = {r[0]: (r[1], r[2]) for r in G.restored(df).collect()}
    assert back[200][1] is False
    right = [i for i, (_, t) in enumerate(pairs) if back[100 + i][0] == "Plain words. " + CLEAN[t]]
    assert len(right) >= 6


def test_empty(spark):
    assert G.garbled(frame(spark, []).where("false")).count() == 0
    assert G.garbled(frame(spark, [])).count() == 0


def test_copies_of_a_garbled_text_do_not_hide_it(spark):
    chain = (("big5", "gb18030"),)
    # signs whose garbled form is an ideograph: others are evidence of their own
    text = "".join(c for c in CLEAN[2] + CLEAN[3] if G.WIDE.fullmatch(G.garble(c, chain) or ""))
    bad = G.garble(text, chain)
    filler = [(i, f"第{i}項\n{text}{i}", "x") for i in range(40)]
    copies = [(1000 + i, bad, "x") for i in range(60)]
    near = [(2000 + i, f"{bad}\nNo. {i}", "x") for i in range(60)]
    df = spark.createDataFrame(filler + copies + near, "segment_row_id long, content string, token string")
    assert {r[0] for r in G.garbled(df).collect()} == {r[0] for r in copies + near}
