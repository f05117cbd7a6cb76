import numpy as np
from pyspark.sql import functions as F

from folioscan.llm import neighbours as N

SCHEMA = "chunk_id long, vector array<float>, id string, v int, cell int"


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), None if v is None else [float(y) for y in v], "x", 0, 0) for i, v in zip(ids, x)], SCHEMA)


def brute(ids, x, k, least):
    x = np.array(x, np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 12)
    out = set()
    for i in range(len(ids)):
        near = sorted((-s[i, j], ids[j]) for j in range(len(ids)) if ids[j] != ids[i])[:k]
        out |= {(ids[i], j) for c, j in near if -c >= least}
    return out


def test_recall(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(150, 64))
    x = (base[:, None] + 0.15 * rng.normal(size=(150, 8, 64))).reshape(-1, 64)
    ids = list(range(len(x)))
    want = brute(ids, x.astype(np.float32), 5, 0.85)
    got = {(r["id"], r["other"]) for r in N.knn(frame(spark, ids, x), shard=200).collect()}
    assert len(want & got) / len(want) > 0.95


def test_dirty_copies_and_ties(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=64), rng.normal(size=64)
    rows = [(1, a), (1, a), *((i, a) for i in range(2, 40)), (50, b), (51, b * 2), (60, None), (61, np.zeros(64)), (62, np.full(64, np.nan)), (63, rng.normal(size=32)), (64, np.r_[np.inf, np.zeros(63)])]
    df = frame(spark, [r[0] for r in rows], [r[1] for r in rows])
    got = {}
    for r in N.knn(df).collect():
        got.setdefault(r["id"], []).append(r["other"])
    assert sorted(got[1]) == [2, 3, 4, 5, 6] and sorted(got[3]) == [1, 2, 4, 5, 6] and sorted(got[39]) == [1, 2, 3, 4, 5]
    assert got[50] == [51] and got[51] == [50] and not {60, 61, 62, 63, 64} & set(got)
    assert N.knn(df.where("false")).count() == 0
    assert N.knn(df.where("chunk_id = 50")).count() == 0


def test_large_cell_is_split(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=64) + (0.3 * rng.normal(size=(100, 1, 64)) + 0.05 * rng.normal(size=(100, 6, 64))).reshape(-1, 64)
    ids = list(range(600))
    want = brute(ids, x.astype(np.float32), 5, 0.85)
    got = {(r["id"], r["other"]) for r in N.knn(frame(spark, ids, x), shard=30).collect()}
    assert len(got) and all(N_ in set(ids) for p in got for N_ in p)
    monkeypatch.setattr(N, "pivots", lambda sample, count: sample[:1])
    monkeypatch.setattr(N, "SALTS", 3)
    got = {(r["id"], r["other"]) for r in N.knn(frame(spark, ids, x), shard=30).collect()}
    assert len(want & got) / len(want) > 0.9


def test_graph_finds_what_brute_force_finds():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = N.Graph(x)
    node, _ = g.search(x[:200], 5)
    want = N.top(x[:200] @ x.T, 5)
    hit = np.mean([len(set(g.order[a[a >= 0]]) & set(b)) / 5 for a, b in zip(node, want)])
    assert hit > 0.9


def test_far_neighbours(spark):
    """Isolated vectors: the five nearest of all, however far, for some of the rows."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 64))
    ids = list(range(4000))
    df = frame(spark, ids, x)
    got = {(r["id"], r["other"]) for r in N.knn(df, least=-2.0, shard=400, asked=F.col("chunk_id") % 20 == 0).collect()}
    want = {p for p in brute(ids, x.astype(np.float32), 5, -2) if p[0] % 20 == 0}
    assert len(got) == 1000 and len(want & got) / len(want) >= 0.9


def test_a_third_is_one_vector(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=64)
    x = [a if i % 3 == 0 else rng.normal(size=64) for i in range(300)]
    got = {}
    for r in N.knn(frame(spark, range(300), x)).collect():
        got.setdefault(r["id"], set()).add(r["other"])
    assert set(got) == set(range(0, 300, 3)) and got[0] == {3, 6, 9, 12, 15} and got[297] == {0, 3, 6, 9, 12} and got[6] == {0, 3, 9, 12, 15}


def test_close_vectors_share_one_of_many_cells():
    rng = np.random.default_rng(8)
    x = N.unit(np.repeat(rng.normal(size=(60, 64)), 100, axis=0) + 0.8 * rng.normal(size=(6000, 64)))
    y = N.unit(x + 0.065 * rng.normal(size=x.shape))
    centre = N.pivots(x, 1500)
    cells = [np.zeros((6000, len(centre)), bool) for _ in range(2)]
    for v, own in zip((x, y), cells):
        row, cell, _ = N.nearest_cells(v, centre, np.full(6000, N.MOST), N.MARGIN)
        own[row, cell] = True
    two = [N.top(v @ centre.T, 2) for v in (x, y)]
    before = np.mean((two[0][:, :, None] == two[1][:, None, :]).any((1, 2)))
    after = np.mean((cells[0] & cells[1]).any(1))
    assert after > 0.998 > before and cells[0].sum() < 2 * 6000


def test_graph_of_a_large_cell():
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(10000, 32)), 2, axis=0) + 0.2 * rng.normal(size=(20000, 32))
    g = N.Graph((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32))
    at = np.arange(0, 20000, 10)
    node, _ = g.search(g.x[at], 6, np.hstack([at[:, None], g.links[0][at]]))
    assert np.mean((g.order[node] == (g.order[at] ^ 1)[:, None]).any(1)) > 0.98
