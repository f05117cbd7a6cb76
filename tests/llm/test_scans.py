import random

import numpy as np
import pytest

from folioscan.llm import scans as S


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    subjects, verbs, objects = "reviewer committee vendor treasurer planner surveyor landlord secretariat".split(), "measured forwarded calibrated documented cancelled renewed".split(), "insulation transcript curriculum furniture telescope warehouse register".split()
    sentence = lambda: f"The {rng.choice(subjects)} {rng.choice(verbs)} the {rng.choice(objects)} and the {rng.choice(objects)} within {rng.randint(2, 40)} working days."
    text = lambda n: " ".join(sentence() for _ in range(n))
    rows = [(i, "section", text(6)) for i in range(150)]
    wrap = lambda t, w=50: "\n".join(t[i : i + w].strip() for i in range(0, len(t), w))
    import textwrap

    good = [(500 + i, "page", "\n".join(textwrap.wrap(text(5), 60, break_on_hyphens=False))) for i in range(60)]
    clean = "\n".join(textwrap.wrap(text(4), 60, break_on_hyphens=False))
    bad = [(900, "page", clean.replace("register", "re9ister").replace("committee", "comrnittee").replace("the ", "tbe ")), (901, "page", "The transcr-\nipt was renewed by the surv¬\neyor."), (902, "image", clean + "\n- 12 -"), (903, "page", "p. 7\n" + clean)]
    bad += [(910 + i, "page", f"Harbour Office Review, No. {i}   {i + 3}\n" + "\n".join(textwrap.wrap(text(4), 60, break_on_hyphens=False))) for i in range(12)]
    edge = [(950, "page", None), (951, "page", ""), (952, None, "p. 7"), (None, "page", "p. 7"), (903, "page", bad[3][2]), (953, "section", "p. 7")]
    del wrap
    return rows + good + bad + edge, [b[0] for b in bad]


def test_found(spark, corpus):
    rows, bad = corpus
    df = spark.createDataFrame([(i, k, t, "x") for i, k, t in rows], "segment_row_id long, segment_type string, content string, token string")
    got = sorted(r[0] for r in S.scanned(df).collect())
    assert set(bad) <= set(got) and len([g for g in got if g not in bad]) <= 2 and len(got) == len(set(got))
    assert S.scanned(df.where("false")).count() == 0


def test_repair(spark, corpus):
    rows, _ = corpus
    df = spark.createDataFrame(rows, "segment_row_id long, segment_type string, content string")
    out = {r[0]: r[1] for r in S.repaired(df).collect()}
    assert out[901] == "The transcript was renewed by the surveyor."
    assert "re9ister" not in out[900] and "\n" not in out[902] and not out[902].endswith("12 -") and out[950] is None
    assert 953 not in out


def test_held_out_accuracy_of_the_editor():
    rng = random.Random(7)
    words = sorted({a + b + c for a in ("com", "re", "de", "in", "sub", "cal") for b in ("ment", "form", "gist", "ceiv", "duct", "clin", "mobil", "ridg") for c in ("ed", "ing", "er", "ion", "able", "s")})
    clean = {w: rng.randint(20, 400) for w in words}
    train = {w: n for i, (w, n) in enumerate(clean.items()) if i % 4}
    weights = S.train_words(train)
    right = total = kept = same = 0
    for w in words[::4]:
        g = S.garble_word(w, rng)
        options = [(S.verdict(weights, g, ops, 1, 0, clean[t]), t) for t, ops in S.variants(g).items() if t in clean]
        if g != w and g not in clean:
            total += 1
            right += bool(options) and max(options)[0] > 0 and max(options)[1] == w
        own = [S.verdict(weights, w, ops, clean[w], clean[w], clean[t]) for t, ops in S.variants(w).items() if t in clean]
        same += 1
        kept += not own or max(own) <= 0
    assert right / total > 0.9 and kept / same > 0.9


def test_copies_of_a_page_do_not_hide_its_misread_sign(spark):
    right = "這個月的例會照常舉行，請大家準時出席會議並且帶上資料，" + "有關場地租借以及設備維護的事項由秘書室統一辦理並通知各單位，" * 3
    page = right.replace("個月的", "個用的")
    clean = [(i, "section", f"{i}，{right}") for i in range(40)]
    copies = [(100 + i, "page", page) for i in range(60)]
    df = spark.createDataFrame(clean + copies, "segment_row_id long, segment_type string, content string")
    assert {r[0] for r in S.scanned(df).collect()} == {r[0] for r in copies}
    assert {r[1] for r in S.repaired(df).collect()} == {right}


def test_words_with_many_edits(spark):
    """Words with more hard signs, letters or soft places than are listed find their clean word too."""
    long = "supercalifragilisticexpialidocious" * 2
    pairs = {"1mp0ss1b111t1es": "impossibilities", "aeeommodatedcircumstance": "accommodatedcircumstance", long.replace("docious", "docions") + "t1on": long.replace("docious", "docions") + "tion", "tab1e": "table"}
    rows = [(k, 1, 0, 1) for k in pairs] + [(v, 0, 500, 0) for v in pairs.values()] + [("1mp0ss1b111t1ez", 1, 0, 1)]
    weights = spark.sparkContext.broadcast((np.ones(S.WEIGHTS), np.ones(S.WEIGHTS)))
    got = S.corrections(spark.createDataFrame(rows, "token string, held long, other long, held_d long"), weights)
    assert {r["token"]: r["right"] for r in got.collect()} == pairs


def test_operations_equal_the_listed_ones():
    for word in ("rn0dem", "c1ean", "vva11", "b|t", "tldfect", "riiie", "1iig"):
        for text, ops in S.variants(word).items():
            if text != word:
                assert S.skeleton(text) == S.skeleton(word) and len(S.operations(word, text)) == len(ops)
    assert S.operations("clean", "clean") is None and S.operations("clean", "clear") is None
