import random

import numpy as np

from folioscan.llm import nearcopies as N


def likeness(a, b, n):
    x, y = ({s[i : i + n] for i in range(len(s) - n + 1)} for s in (a, b))
    return len(x & y) / len(x | y)


def norm(t):
    return " ".join(t.lower().replace("\t", " ").replace("\n", " ").split(" ")).strip() if "  " not in t else " ".join(t.lower().split())


def rows(prose):
    rng = random.Random(1)
    out, i = [], 0
    for f in range(25):
        t = prose(rng.randint(220, 900), f)
        for _ in range(4):
            u = list(t)
            for _ in range(rng.randint(0, 12)):
                u[rng.randrange(len(u))] = rng.choice("xyz")
            out.append((i, "".join(u)))
            i += 1
    return out


def test_recall_and_precision(spark, prose):
    data = rows(prose)
    data += [(200, "  " + data[0][1].upper().replace(" ", "\n\t")), (201, None), (202, ""), (203, "short"), (0, data[0][1])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in data], "segment_row_id long, content string, a string, _class int")
    want = {(min(i, j), max(i, j)) for i, a in data for j, b in data if i < j and a and b and len(norm(a)) >= 200 and len(norm(b)) >= 200 and likeness(norm(a), norm(b), 8) >= 0.6}
    got = [tuple(r) for r in N.near_texts(df).pairs().collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(want & set(got)) / len(want) > 0.93
    assert (0, 200) in got


def test_copies_beyond_the_limit_are_membership(spark, prose):
    t, u = prose(400, 1), prose(400, 1)[:395] + "zzzzz"
    df = spark.createDataFrame([(i, t) for i in range(80)] + [(100, u)], "segment_row_id long, content string")
    near = N.near_texts(df)
    assert sorted(map(tuple, near.pairs().collect())) == [(0, i) for i in range(1, 80)] + [(0, 100)]
    by = {r["id"]: (r["class_id"], r["copies"], r["links"]) for r in near.classes().collect()}
    assert by[79] == (0, 80, 1) and by[100] == (100, 1, 1) and len(by) == 81


def test_full_nodes_are_dealt_to_blocks(spark, prose, monkeypatch):
    monkeypatch.setattr(N, "NODE", 6)
    t = prose(600, 3)
    data = [(i, t[: 10 * i] + f"{i:04d}" + t[10 * i :]) for i in range(1, 41)]
    df = spark.createDataFrame(data, "segment_row_id long, content string")
    got = {tuple(r) for r in N.near_texts(df).pairs().collect()}
    assert got == {(i, j) for i in range(1, 41) for j in range(i + 1, 41)}


def test_names_and_empty(spark):
    names = [(1, "Annual_budget_report_2019.PDF"), (2, "annual_budget_report_2020.xlsx"), (3, "annual_budget_report_2019"), (4, "short.txt"), (5, None), (6, "entirely_different_name.md")]
    df = spark.createDataFrame(names, "doc_id long, filename string")
    want = {(1, 2), (1, 3), (2, 3)}
    assert {tuple(r) for r in N.near_names(df).pairs().collect()} == want
    assert N.near_names(df.where("false")).pairs().count() == 0
    assert N.near_names(df.where("false")).classes().count() == 0


def test_levels_equal_scan():
    rng = np.random.default_rng(0)
    w = rng.integers(0, 1 << 62, (500, 3)).astype(np.uint64)
    w[100:200] = w[0] ^ (np.uint64(1) << rng.integers(0, 60, (100, 3)).astype(np.uint64))
    q, leaf = N.Levels(w).search(w[:50], 10)
    want = {(i, j) for i in range(50) for j in range(500) if N.differing(w[i] ^ w[j]) <= 10}
    assert set(zip(q.tolist(), leaf.tolist())) == want


def test_gray_rank():
    x = np.arange(64, dtype=np.uint64)
    assert (N.gray_rank(x ^ (x >> np.uint64(1))) == x).all()


def test_groups(spark, prose):
    rng = random.Random(5)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 300 + i) for i in range(20)]
    boss = {}

    def top(x):
        while boss.setdefault(x, x) != x:
            x = boss[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            boss[y] = x
    want = {x: top(x) for a, b in edges if a != b for x in (a, b)}
    got = N.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r[0]: r[1] for r in got} == want and len(got) == len(want)
    assert N.components(spark.createDataFrame([], "a long, b long")).count() == 0
    t = prose(400, 1)
    df = spark.createDataFrame([(5, t), (6, t), (7, t[:390] + "zzzzzzzzzz"), (8, prose(400, 2))], "segment_row_id long, content string")
    assert {r[0]: (r[1], r[2]) for r in N.near_texts(df).groups().collect()} == {5: (5, 3), 6: (5, 3), 7: (5, 3), 8: (8, 1)}


def test_common_text_does_not_hide_pairs(spark, prose, monkeypatch):
    """A third of a text is the same in all: full nodes are split by further cells, and near pairs among them still meet."""
    monkeypatch.setattr(N, "NODE", 8)
    monkeypatch.setattr(N, "MOST_PARTS", 1)
    common = prose(300, 99)
    data = []
    for i in range(60):
        own = prose(600, i)
        data += [(2 * i, common + own), (2 * i + 1, common + own[:590] + f"zz{i:04d}zz")]
    got = {tuple(r) for r in N.near_texts(spark.createDataFrame(data, "segment_row_id long, content string")).pairs().collect()}
    assert {(2 * i, 2 * i + 1) for i in range(60)} <= got


def test_all_pairs_of_a_full_node_are_compared(spark, monkeypatch):
    """Records of one node that agree in no further cell."""
    monkeypatch.setattr(N, "NODE", 2)
    monkeypatch.setattr(N, "MOST_PARTS", 3)
    rng = np.random.default_rng(4)
    rows = [(i, [7 if i < 20 else 1000 + i], bytes(24), rng.bytes(192)) for i in range(200)]
    df = spark.createDataFrame(rows, "_class long, _nodes array<long>, _print binary, _cells binary")
    assert {tuple(r) for r in N.candidates(df, 5).collect()} == {(i, j) for i in range(20) for j in range(i + 1, 20)}
