"""Problem 4: the k most similar vectors for every vector.

A hierarchical navigable small-world graph per shard (Malkov and Yashunin 2016), stored as flat neighbour arrays, shard results merged.

Equal vectors are one node with the k+1 least ids (a limit inside the partitions comes before their shuffle), so a mass of copies is one node, and what
is found for a node is joined back to all of its ids. Shards are the cells of pivots fitted on a bounded sample (spherical k-means on at most PIVOT_SAMPLE
vectors); every node is a member of those cells, up to MOST, whose pivots are less than MARGIN farther than the nearest one, so close vectors on two sides
of a border meet in one of them, while a node deep in a cell moves once. Borders grow with the number of cells, so shards are as large as a task can hold;
their number follows the number of nodes. What one sample can have as pivots is bounded, so cells that are too large, because of that or of dense regions,
get pivots of their own from some of their nodes and are parted once more in the same way; no node is sent to all parts.

In a shard the graph is built from the top: a level holds a random 1/RATIO of the nodes of the level below; each node of a level descends the graph
above by beam search to its nearest anchors, nodes that meet at an anchor are compared as a block, and links are half the nearest and half the
diversified candidates, plus reverse links. The top level, of HEAD nodes at most, is compared in full. Then each asking node searches level 0 from its
links. All steps run over all nodes of a level as numpy arrays.

Two uses: all vectors ask, for neighbours that are near (a cosine of at least LEAST: a short search in their own cells finds these); or some vectors ask
for their k nearest however far these are, in ASKED cells of members of their MEMBERS nearest, and by a long search, which is what isolated vectors need.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import points as P
from .tables import cut, read, sampled

K, LEAST, DIMENSIONS = 5, 0.85, 64
#: Nodes to a cell, not counting second memberships; small inputs have cells of an eighth of that until there are FEW.
SHARD, FEW, MEMBERS, PIVOT_SAMPLE = 32_768, 32, 2, 20_000
MOST, MARGIN = 4, 0.05
RATIO, HEAD, LINKS, ANCHORS, EF, STEPS = 64, 2_048, 12, 4, 24, 2
#: Cells and length of the search of vectors that ask for their nearest however far they are.
ASKED, LONG_EF, LONG_STEPS = 12, 128, 64
BATCH, PAIRS = 2048, 1 << 15
#: Tasks of a cell that is parted.
SALTS = 16


def pivots(sample: np.ndarray, count: int, rounds: int = 5) -> np.ndarray:
    """Spherical k-means; starts from sampled vectors, so dense regions have as many cells as rows."""
    rng = np.random.default_rng(7)
    sample = np.unique(sample, axis=0)
    centre = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(sample[a : a + BATCH] @ centre.T).argmax(1) for a in range(0, len(sample), BATCH)])
        o = np.argsort(own, kind="stable")
        at = np.searchsorted(own[o], np.arange(len(centre)))
        sums = np.add.reduceat(np.vstack([sample[o], np.zeros((1, sample.shape[1]), sample.dtype)]), at, axis=0)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        some = (np.bincount(own, minlength=len(centre)) > 0)[:, None] & (size > 1e-6)
        centre = np.where(some, sums / np.maximum(size, 1e-6), centre).astype(np.float32)
    return centre


def top(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest of each row, the greatest first."""
    k = min(k, sims.shape[1])
    part = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < sims.shape[1] else np.broadcast_to(np.arange(k), sims.shape).copy()
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(sims, part, 1), axis=1, kind="stable"), 1)


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, ef: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries at once over one level: (nodes, similarities), best first, -1 where there are fewer."""
    outs, sims = [], []
    for a in range(0, len(q), BATCH):
        qq, node = q[a : a + BATCH], start[a : a + BATCH]
        sim = np.where(node >= 0, np.einsum("bkd,bd->bk", x[node], qq), -2).astype(np.float32)
        done = np.zeros(node.shape, bool)
        for _ in range(steps):
            open_ = np.where(done | (node < 0), -3, sim)
            pick = top(open_, 2)
            live = np.take_along_axis(open_, pick, 1) > -2
            if not live.any():
                break
            np.put_along_axis(done, pick, True, 1)
            near = np.where(live[:, :, None], links[np.take_along_axis(node, pick, 1)], -1).reshape(len(qq), -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[(near[:, :, None] == node[:, None, :]).any(2)] = -1
            fresh = np.where(near >= 0, np.einsum("bkd,bd->bk", x[near], qq), -2).astype(np.float32)
            node, sim, done = np.hstack([node, near]), np.hstack([sim, fresh]), np.hstack([done, np.zeros(near.shape, bool)])
            best = top(sim, ef)
            node, sim, done = (np.take_along_axis(v, best, 1) for v in (node, sim, done))
        best = top(sim, ef)
        node, sim = np.take_along_axis(node, best, 1), np.take_along_axis(sim, best, 1)
        pad = ef - node.shape[1]
        outs.append(np.pad(node, ((0, 0), (0, pad)), constant_values=-1) if pad > 0 else node)
        sims.append(np.pad(sim, ((0, 0), (0, pad)), constant_values=-2) if pad > 0 else sim)
    return (np.concatenate(outs), np.concatenate(sims)) if outs else (np.zeros((0, ef), np.int64), np.zeros((0, ef), np.float32))


def merge_rows(owner: np.ndarray, other: np.ndarray, sim: np.ndarray, n: int, width: int) -> np.ndarray:
    """[n, width] of the most similar distinct others of each owner, -1 where there are fewer."""
    o = np.lexsort((other, -sim, owner))
    owner, other = owner[o], other[o]
    o = np.unique(owner * n + other, return_index=True)[1]
    o.sort()
    owner, other = owner[o], other[o]
    first = np.searchsorted(owner, np.arange(n))
    rank = np.arange(len(owner)) - first[owner]
    keep = rank < width
    out = np.full((n, width), -1, np.int64)
    out[owner[keep], rank[keep]] = other[keep]
    return out


def blockwise(x: np.ndarray, anchor: np.ndarray, n: int, width: int) -> np.ndarray:
    """Nodes that share an anchor are compared; [n, width] nearest of each, -1 where there are fewer."""
    places = anchor.shape[1]
    flat = anchor.ravel()
    slot = np.flatnonzero(flat >= 0)
    slot = slot[np.argsort(flat[slot], kind="stable")]
    flat, node = flat[slot], slot // places
    begin = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else slot
    size = np.diff(np.r_[begin, len(flat)])
    # what each node finds at each of its anchors
    near, sims = np.full((n * places, width), -1, np.int32), np.full((n * places, width), -2, np.float32)
    order = np.argsort(size, kind="stable")
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and size[order[j]] <= size[order[i]] * 1.25 + 4 and (j - i + 1) * size[order[j]] ** 2 <= 1 << 20:
            j += 1
        group, w = order[i:j], int(size[order[j - 1]])
        cell = np.minimum(begin[group][:, None] + np.arange(w), len(node) - 1)
        real = np.arange(w) < size[group][:, None]
        member = node[cell]
        v = x[member]
        step = max(64, (1 << 21) // w)
        for r in range(0, w, step):
            s = np.matmul(v[:, r : r + step], v.transpose(0, 2, 1))
            s[np.broadcast_to(~real[:, None, :], s.shape)] = -2
            rows = np.arange(s.shape[1])
            s[:, rows, rows + r] = -2
            s = s.reshape(-1, w)
            some = real[:, r : r + step].ravel()
            best = top(s, width)
            at = slot[cell[:, r : r + step].ravel()[some]]
            near[at, : best.shape[1]] = member[np.repeat(np.arange(len(group)), len(rows))[:, None], best][some]
            sims[at, : best.shape[1]] = np.take_along_axis(s, best, 1)[some]
        i = j
    near[sims <= -2] = -1
    near, sims = near.reshape(n, -1), sims.reshape(n, -1)
    out = np.full((n, width), -1, np.int64)
    for a in range(0, n, BATCH):
        o = np.argsort(near[a : a + BATCH], axis=1, kind="stable")
        who, sim = np.take_along_axis(near[a : a + BATCH], o, 1), np.take_along_axis(sims[a : a + BATCH], o, 1)
        sim[:, 1:][who[:, 1:] == who[:, :-1]] = -2
        best = top(sim, width)
        out[a : a + BATCH, : best.shape[1]] = np.where(np.take_along_axis(sim, best, 1) > -2, np.take_along_axis(who, best, 1), -1)
    return out


def select(x: np.ndarray, candidates: np.ndarray, width: int) -> np.ndarray:
    """Half the links are the nearest candidates, the others are taken in order if no chosen one is nearer to them than the node is."""
    out = np.full((len(x), width), -1, np.int64)
    near = width // 2
    for a in range(0, len(x), BATCH):
        c = candidates[a : a + BATCH]
        v = x[c]
        own = np.where(c >= 0, np.einsum("bkd,bd->bk", v, x[a : a + BATCH]), -2)
        between = np.matmul(v, v.transpose(0, 2, 1))
        taken = np.zeros(c.shape, bool)
        taken[:, :near] = c[:, :near] >= 0
        for j in range(near, c.shape[1]):
            shadowed = (taken & (between[:, j] > own[:, j : j + 1])).any(1)
            taken[:, j] = (c[:, j] >= 0) & ~shadowed & (taken.sum(1) < width)
        place = np.cumsum(taken, 1) - 1
        r, j = np.nonzero(taken)
        out[a + r, place[r, j]] = c[r, j]
    return out


def both_ways(x: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Links and, up to the same number, the most similar reverse ones."""
    n, m = links.shape
    u, j = np.nonzero(links >= 0)
    v = links[u, j]
    sim = np.einsum("ed,ed->e", x[u], x[v])
    back = merge_rows(v, u, sim, n, m)
    back[(back[:, :, None] == links[:, None, :]).any(2)] = -1
    return np.hstack([links, back])


class Graph:
    """Levels of flat neighbour arrays; the nodes of level l are the first sizes[l] in a random order, so upper levels are prefixes."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        self.order = np.random.default_rng(11).permutation(n)
        self.x = np.ascontiguousarray(x[self.order], np.float32)
        self.sizes = [n]
        while self.sizes[-1] > HEAD:
            self.sizes.append(-(-self.sizes[-1] // RATIO))
        self.links: list[np.ndarray] = [np.zeros((0, 0), np.int64)] * len(self.sizes)
        for level in range(len(self.sizes) - 1, -1, -1):
            m = self.sizes[level]
            y = self.x[:m]
            anchor = np.zeros((m, 1), np.int64) if level == len(self.sizes) - 1 else self.descend(y, level + 1, ANCHORS)
            self.links[level] = both_ways(y, select(y, blockwise(y, anchor, m, 2 * LINKS), LINKS))

    def descend(self, q: np.ndarray, to: int, width: int) -> np.ndarray:
        """The nodes of level `to` nearest to the queries, found from the top."""
        level = len(self.sizes) - 1
        head = self.x[: self.sizes[level]]
        start = np.concatenate([top(q[a : a + BATCH] @ head.T, width) for a in range(0, len(q), BATCH)])
        while level > to:
            level -= 1
            start = beam(self.x, self.links[level], q, start, 2 * width, 4)[0][:, :width]
        return start

    def search(self, q: np.ndarray, k: int, start: np.ndarray | None = None, ef: int = EF, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) of the k nearest; start: nodes of level 0 to begin at, else those found from the top."""
        if start is None:
            start, steps = self.descend(q, 0, ANCHORS), 4 * steps
        node, sim = beam(self.x, self.links[0], q, start, max(ef, k), steps)
        return node[:, :k], sim[:, :k]


def nearest(node: np.ndarray, lists: pa.ListArray, vectors: np.ndarray, member: np.ndarray, asks: np.ndarray, k: int, least: float, long: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, id, cosine) in one shard: the listed ids of the nodes nearest to each asking node, its own among them, k+1 at most."""
    inside, rows = np.flatnonzero(member), np.flatnonzero(asks)
    if not len(inside) or not len(rows):
        return node[:0], node[:0], np.zeros(0)
    x = np.concatenate([unit(vectors[a : a + BATCH]) for a in range(0, len(vectors), BATCH)])
    graph = Graph(x[inside])
    slot = np.full(len(node), -1, np.int64)
    slot[inside[graph.order]] = np.arange(len(inside))
    effort = {"ef": LONG_EF, "steps": LONG_STEPS} if long else {}
    found = np.full((len(node), k + 1), -1, np.int64)
    for some, start in ((rows[slot[rows] >= 0], True), (rows[slot[rows] < 0], False)):
        if len(some):
            at = slot[some]
            got, sim = graph.search(x[some], k + 1, np.hstack([at[:, None], graph.links[0][at]]) if start else None, **effort)
            found[some, : got.shape[1]] = np.where(sim >= least - 1e-3, got, -1)  # single precision; the exact cosine decides below
    own = rows[slot[rows] >= 0]
    r, c = np.nonzero(found >= 0)
    r, other = np.r_[r, own], np.r_[inside[graph.order[found[r, c]]], own]
    cos = np.concatenate([np.round(np.einsum("ed,ed->e", exact(vectors[r[a : a + PAIRS]]), exact(vectors[other[a : a + PAIRS]])), 12) for a in range(0, max(len(r), 1), PAIRS)])
    cos[node[r] == node[other]] = 1.0
    keep = cos >= least
    r, other, cos = r[keep], other[keep], cos[keep]
    at = lists.offsets.to_numpy().astype(np.int64)
    ids = lists.values.to_numpy(zero_copy_only=False)
    per = at[other + 1] - at[other]
    a, b, cos = np.repeat(r, per), ids[P.ragged(at[other], at[other + 1])], np.repeat(cos, per)
    o = np.lexsort((b, -cos, a))
    a, b, cos = a[o], b[o], cos[o]
    first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (cos[1:] != cos[:-1])] if len(a) else np.zeros(0, bool)
    a, b, cos = a[first], b[first], cos[first]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < k + 1
    return node[a[keep]], b[keep], cos[keep]


def usable(vector: str, dimensions: int):
    """Neither null, of another length, all zero, nor holding a null, NaN or infinity."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) == dimensions) & ~bad & F.exists(v, lambda x: x != 0)


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """[rows, dimensions] of a column of packed vectors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    if not len(column):
        return np.zeros((0, dimensions), np.float32)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.float32, len(column) * dimensions, offset=at).reshape(-1, dimensions)


def exact(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def unit(v: np.ndarray) -> np.ndarray:
    return exact(v).astype(np.float32)


def nearest_cells(v: np.ndarray, centre: np.ndarray, many: np.ndarray, margin: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, place among the row's nearest) of the many[row] nearest cells of each row; of those within the margin of the nearest one, if it is given."""
    width = min(int(many.max()), len(centre))
    cells, some = [], []
    for a in range(0, len(v), BATCH):
        sim = v[a : a + BATCH] @ centre.T
        best = top(sim, width)
        sim = np.take_along_axis(sim, best, 1)
        cells.append(best)
        some.append((np.arange(width) < many[a : a + BATCH, None]) & (margin is None or sim[:, :1] - sim <= margin))
    r, p = np.nonzero(np.concatenate(some))
    return r, np.concatenate(cells)[r, p], p


ROUTED = "cell int, part int, node long, ids array<long>, v binary, member boolean, asks boolean"


def knn(df: DataFrame, key: str = "chunk_id", vector: str = "vector", k: int = K, least: float = LEAST, dimensions: int = DIMENSIONS, shard: int = SHARD, asked=None) -> DataFrame:
    """(id, other, cosine): for each usable vector its k most similar others with a cosine of at least `least`, ties to the smaller id.

    asked: a condition on the rows; only these ask, of all rows, by the long search in ASKED cells. Vectors that are null, all zero, of another length or
    not finite, and null keys, take no part. Rows repeated in full count once; a key with several vectors is as near as its nearest. An empty table gives
    no row. Recall against brute force is in the README.
    """
    spark = df.sparkSession
    ask = F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))
    usual = df.where(F.col(key).isNotNull() & usable(vector, dimensions))
    rows = usual.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"), ask.alias("asks")).withColumn("node", F.xxhash64("v"))
    place = F.row_number().over(W.partitionBy("node").orderBy("id"))
    # the limit is taken inside the partitions before the shuffle, and again after it; a vector moves once, without its ids
    once = rows.select("node", "id").distinct().withColumn("place", place).where(F.col("place") <= k + 1)
    listed = once.groupBy("node").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    nodes = listed.join(rows.groupBy("node").agg(F.first("v").alias("v")), "node")
    if asked is not None:
        nodes = nodes.join(rows.where("asks").select("node").distinct().withColumn("asks", F.lit(True)), "node", "left")
    else:
        nodes = nodes.withColumn("asks", F.lit(True))

    def packed(batches):
        for batch in batches:
            v = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            ends = pa.py_buffer(np.arange(0, 4 * dimensions * (batch.num_rows + 1), 4 * dimensions, np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, ends, pa.py_buffer(v.tobytes())]), batch.column(3)], ["node", "ids", "v", "asks"])

    nodes = cut(nodes.select("node", "ids", "v", F.coalesce("asks", F.lit(False)).alias("asks")).mapInArrow(packed, "node long, ids array<long>, v binary, asks boolean"))
    taken = nodes.count()
    sample = sampled(nodes.select("node", "v"), PIVOT_SAMPLE, "node", taken).select("v")
    x = unit(np.frombuffer(b"".join(bytes(r[0]) for r in sample.toLocalIterator()), np.float32).reshape(-1, dimensions))
    centre = spark.sparkContext.broadcast(pivots(x, max(1, min(len(x) // 8, max(math.ceil(taken / shard), min(FEW, math.ceil(8 * taken / shard)))))) if len(x) else np.zeros((1, dimensions), np.float32))
    long = asked is not None
    wide, members, margin = (ASKED, MEMBERS, None) if long else (MOST, MOST, MARGIN)

    def route(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            node, ids, v, asks = batch.columns
            asking = asks.to_numpy(zero_copy_only=False)
            r, cell, p = nearest_cells(unit(matrix(v, dimensions)), centre.value, np.where(asking, wide, members), margin)
            yield routed(cell, np.zeros(len(r), np.int32), node, ids, v, r, p < members, asking[r])

    first = nodes.mapInArrow(route, ROUTED)
    # the members of the cells, judged by an eighth of the nodes; one small row for each cell that is too large
    eighth = nodes.where(F.pmod(F.shiftright("node", 7), F.lit(8)) == 0).mapInArrow(route, ROUTED).where("member")
    most = 2 * shard * MEMBERS
    large = cut(eighth.groupBy("cell").count().where(F.col("count") * 8 > most).select("cell", F.lit(1 / (shard * MEMBERS)).alias("share")))
    if large.limit(1).count():
        first = parted(first, large, dimensions, max(members, wide // 2), members, margin)

    def solve(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        flags = [table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("member", "asks")]
        lists = table.column("ids").chunk(0)
        a, b, cos = nearest(table.column("node").to_numpy(), lists, matrix(table.column("v"), dimensions), *flags, k, least, long)
        return pa.table({"node": pa.array(a, pa.int64()), "other": pa.array(b, pa.int64()), "cosine": pa.array(cos, pa.float64())})

    near = first.groupBy("cell", "part").applyInArrow(solve, "node long, other long, cosine double")
    best = near.groupBy("node", "other").agg(F.max("cosine").alias("cosine"))
    found = best.groupBy("node").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), F.col("other")))), 1, k + 1).alias("n"))
    # every id of a node has the others of its node, but for itself
    mine = rows.where("asks").select("node", "id").distinct().join(found, "node")
    rest = mine.select("id", F.explode(F.slice(F.filter("n", lambda x: x["other"] != F.col("id")), 1, k)).alias("n"))
    pairs = rest.groupBy("id", "n.other").agg(F.max(-F.col("n.c")).alias("cosine"))
    ranked = pairs.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), F.col("other")))), 1, k).alias("n"))
    return ranked.select("id", F.explode("n").alias("n")).select("id", F.col("n.other").alias("other"), (-F.col("n.c")).alias("cosine"))


def routed(cell, part, node, ids, v, r, member, asks) -> pa.RecordBatch:
    at = pa.array(r)
    columns = [pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32)), node.take(at), ids.take(at), v.take(at), pa.array(member), pa.array(asks)]
    return pa.RecordBatch.from_arrays(columns, ["cell", "part", "node", "ids", "v", "member", "asks"])


def parted(first: DataFrame, large: DataFrame, dimensions: int, wide: int, members: int, margin: float | None) -> DataFrame:
    """Rows of large cells go to their nearest parts in the cell, whose pivots are some of its members, as many as there are to be parts.

    A cell is dealt to SALTS tasks by the hashes of its nodes, and its pivots are sent to each of them ahead of the nodes.
    """
    flagged = first.join(F.broadcast(large), "cell", "left")  # one row for a cell, so at most PIVOT_SAMPLE / 8
    some = flagged.where("share is not null").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    chosen = some.where("member").where(F.pmod(F.xxhash64(F.lit(5), "node"), F.lit(1 << 30)) < F.col("share") * (1 << 30)).drop("salt")
    heads = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    columns = ["cell", "salt", "head", "node", "ids", "v", "member", "asks"]
    both = heads.withColumn("head", F.lit(0)).select(columns).union(some.withColumn("head", F.lit(1)).select(columns))

    def route(batches):
        at, pivots_ = None, np.zeros((0, dimensions), np.float32)
        for batch in batches:
            cell, salt, head = (batch.column(i).to_numpy() for i in range(3))
            node, ids, v, member, asks = batch.columns[3:]
            x = unit(matrix(v, dimensions))
            begin = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (salt[1:] != salt[:-1])]) if len(cell) else []
            for a, b in zip(begin, np.r_[begin[1:], len(cell)]):
                if at != (cell[a], salt[a]):
                    at, pivots_ = (cell[a], salt[a]), pivots_[:0]
                c = a + int((head[a:b] == 0).sum())
                pivots_ = np.concatenate([pivots_, x[a:c]])
                if c == b:
                    continue
                inside, asking = (f.to_numpy(zero_copy_only=False)[c:b].astype(bool) for f in (member, asks))
                centre = pivots_ if len(pivots_) else np.zeros((1, dimensions), np.float32)
                r, part, p = nearest_cells(x[c:b], centre, np.where(asking, wide, members), margin)
                yield routed(np.full(len(r), cell[a]), part + 1, node, ids, v, r + c, inside[r] & (p < members), asking[r])

    dealt = both.repartition("cell", "salt").sortWithinPartitions("cell", "salt", "head").mapInArrow(route, ROUTED)
    return flagged.where("share is null").select("cell", "part", "node", "ids", "v", "member", "asks").union(dealt)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = knn(read(spark, sf_dir, "semantic_chunks"))
    return near.select(F.least("id", "other").alias("chunk_id_a"), F.greatest("id", "other").alias("chunk_id_b")).distinct()


def p4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all chunks, however far, for every chunk whose id is divisible by 100."""
    return knn(read(spark, sf_dir, "semantic_chunks"), least=-2.0, asked=F.col("chunk_id") % 100 == 0).withColumnsRenamed({"id": "chunk_id", "other": "near_id"})


QUERIES = {"p4_found": p4_found, "p4_nearest": p4_nearest}
SQL: dict[str, str] = {}
