import random

import pytest

from folioscan.llm.spans import coverage, shared_spans


def brute(docs, span):
    held = {}
    for d, t in docs:
        for i in range(len(t or "") - span + 1):
            held.setdefault(t[i : i + span], set()).add(d)
    out = set()
    for d, t in docs:
        mark = [False] * (len(t or "") + 1)
        for i in range(len(t or "") - span + 1):
            if len(held[t[i : i + span]]) > 1:
                mark[i : i + span] = [True] * span
        start = None
        for i, m in enumerate(mark):
            if m and start is None:
                start = i
            elif not m and start is not None:
                out.add((d, start, i))
                start = None
    return out


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefgh 會議😀") for _ in range(n))
    pool = [text(rng.randint(20, 90)) for _ in range(6)]
    docs = [(i, text(rng.randint(0, 80)) + rng.choice(pool)[rng.randint(0, 10) :] + text(20) + rng.choice(pool) * rng.randint(1, 3) + text(rng.randint(0, 50))) for i in range(25)]
    docs += [(50, None), (51, ""), (52, "aaaa" * 40), (53, "aaaa" * 30), (54, "b" * 200)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, span_start string")
    got = [tuple(r) for r in shared_spans(df, span=30, block=20).collect()]
    assert set(got) == brute(docs, 30) and len(got) == len(set(got))


def test_a_third_is_boilerplate_and_edges(spark):
    rng = random.Random(9)
    boiler = "".join(rng.choice("abcdefghij ") for _ in range(400))
    docs = [(i, f"{i:05d}" * 10 + (boiler if i % 3 == 0 else "") + f"{i * 7:06d}" * 9) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {tuple(r) for r in shared_spans(df).collect()}
    # a digit beside the boilerplate can agree by chance
    assert {g[0] for g in got} == {d for d, _ in docs if d % 3 == 0}
    assert all(50 - 6 <= s <= 50 and 450 <= e <= 456 for _, s, e in got)
    share = {r["doc_id"]: r for r in coverage(df).collect()}
    assert len(share) == 300 and share[1]["shared_chars"] == 0 and share[3]["shared_ratio"] > 0.7
    assert shared_spans(df.where("false")).count() == 0
    one = spark.createDataFrame([(1, boiler), (1, boiler)], "doc_id long, text string")
    assert shared_spans(one).count() == 0
    assert shared_spans(spark.createDataFrame([(1, boiler), (None, boiler)], "doc_id long, text string")).count() == 0
