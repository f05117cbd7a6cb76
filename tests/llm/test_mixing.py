import random

import pytest

from folioscan.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, tokens string"


def docs(spark, prose, n=300):
    rng = random.Random(1)
    rows = [(i, prose(rng.randint(40, 600), i), rng.choice(["a", "a", "a", " B ", "b", "C"]), "x") for i in range(n)]
    rows += rows[:20]
    rows += [(1000, None, "a", "x"), (1001, "", "a", "x"), (1002, "hello there", None, "x"), (1003, "other", "unknown", "x"), (1004, prose(300, 7), "tiny", "x")]
    return spark.createDataFrame(rows, SCHEMA)


TARGETS = [("A", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 4), ("tiny", 0.05, 3), ("none", 0.1, 2), (None, 0.2, 2)]


def test_shares(spark, prose):
    m = M.mix(docs(spark, prose), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int"))
    drawn = m.draw()
    rows = drawn.collect()
    most = {"a": 1, "b": 2, "c": 4, "tiny": 3}
    assert all(1 <= r["copies"] <= most[r["source"]] for r in rows) and len({r["doc_id"] for r in rows}) == len(rows)
    assert not {1000, 1001, 1002, 1003} & {r["doc_id"] for r in rows}
    share = {r["source"]: r for r in m.shares(drawn).collect()}
    assert set(share) == {"a", "b", "c", "tiny", "none"} and share["none"]["tokens"] == 0
    for s in ("a", "b", "c"):
        assert share[s]["actual_share"] == pytest.approx(share[s]["feasible_share"], abs=0.004)
    assert sum(r["actual_share"] for r in share.values()) == pytest.approx(1, abs=1e-5)


def test_empty_and_zero(spark, prose):
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    m = M.mix(docs(spark, prose).where("false"), t)
    d = m.draw()
    assert d.count() == 0 and m.shares(d).count() == 5
    none = M.mix(docs(spark, prose, 20), t.where("false"))
    assert none.draw().count() == 0


def test_flight_keeps_totals():
    rng = random.Random(3)
    f = M.Flight(5)
    rows = [(0.37, rng.randint(10, 500), i) for i in range(200)]
    taken = []
    for r in rows:
        taken += [x for x in f.step(*r) if x[2]]
    left = sum(x[0] * x[1] for x in f.open), sum(x[0] for x in f.open)
    assert len(f.open) <= 2
    assert sum(x[1] for x in taken) + left[0] == pytest.approx(sum(p * t for p, t, _ in rows), rel=1e-6)
    assert len(taken) + left[1] == pytest.approx(0.37 * 200, rel=1e-6)


def test_no_source_misses_a_share_it_can_have(spark, prose):
    rows = [(i, prose(200, i), "big" if i < 200 else "small", "x") for i in range(220)]
    targets = spark.createDataFrame([("big", 0.93, 1), ("small", 0.07, 1)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame([r for r in rows if r[0] < 206], SCHEMA)
    m = M.mix(df, targets)
    for r in m.shares(m.draw()).collect():
        assert abs(r["deviation"]) < 0.01
    loose = M.mix(df, targets, short=0.1)
    assert loose.total > 2 * m.total


def test_draw_does_not_depend_on_partitions(spark, prose, monkeypatch):
    monkeypatch.setattr(M, "STRATUM", 40)
    df, t = docs(spark, prose), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    draws = [sorted(map(tuple, M.mix(df.repartition(n), t).draw().collect())) for n in (1, 7)]
    assert draws[0] == draws[1] and draws[0]
