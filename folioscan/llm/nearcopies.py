"""Problem 1: near-duplicate records with small edits.

A Gray-order hierarchical index over bit fingerprints, after the HA-index of Tang et al. (EDBT 2015), arranged for Spark:

* A record's fingerprint has CELLS cells, each the low bits of a min-hash of its character n-grams, so the share of differing cells estimates the
  likeness. Records of equal text are one class, known by the hash of the text, and indexed once.
* A view puts the full pattern of BAND cells first: its Gray rank is the key of an upper node, and the records of a node are sorted by the Gray rank of the
  rest. There are VIEWS views. A pair of likeness 0.6 shares an upper node in 1 - (1 - 0.6**3)**16 = 98 % of all cases, one of 0.7 in 99.9 %.
* Inside a node, runs of FAN fingerprints, and runs of such runs, are nodes that keep the bits all of their members share. A search accumulates the
  differences to those shared bits from the top and drops a whole group when they exceed what the likeness allows; what reaches a leaf is a candidate.
* Candidates are verified on the exact n-gram sets.

Upper nodes that are too full (counted in a table of fixed size, by the hashes of the nodes) are dealt to blocks, and each pair of blocks is a task's group
of its own, so all pairs of a node are compared, however full it is. Dealing writes a record once for each block; beyond MOST_PARTS blocks these grow instead.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import points as P
from .leaks import classes
from .tables import cut, prune, read, spread

CELLS, VIEWS, BAND, BITS, FAN = 96, 16, 3, 2, 8
#: Room for the estimate, in standard deviations.
ROOM = 2.5
#: Records of an upper node that one group compares; fuller nodes are dealt to blocks of about this size, of nodes with more than MOST_PARTS to so many larger ones.
NODE, MOST_PARTS = 2048, 48
#: Pairs of a query and a node that a search looks at together.
LOOKS = 1 << 21
NODE_BUCKETS = 1 << 18
#: Classes of equal texts up to this size are written as pairs of all their rows; of larger ones each row is paired with the least row only (membership).
EXPAND = 50
EMPTY = np.uint64(2**64 - 1)


def normal(cp: np.ndarray, off: np.ndarray, blanks: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Lower case; with blanks, each run of blanks, tabs and line breaks is one blank, and none at the ends."""
    cp = classes()[1][cp]
    if not blanks or not len(cp):
        return cp, off
    blank = (cp == 32) | (cp == 9) | (cp == 10) | (cp == 13)
    first = np.zeros(len(cp) + 1, bool)
    first[off] = True
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    keep &= ~(blank & first[:-1])
    at = np.concatenate([[0], np.cumsum(keep)])
    out, off = np.where(blank, np.uint32(32), cp)[keep], at[off]
    tail = np.zeros(len(out), bool)
    last = off[1:][off[1:] > off[:-1]] - 1
    tail[last[out[last] == 32]] = True
    gone = np.concatenate([[0], np.cumsum(tail)])
    return out[~tail], off - gone[off]


def shingles(cp: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the n-grams that lie inside a row."""
    h = P.grams(cp, n)
    row = P.rows_of(off)
    keep = row[: len(h)] == row[n - 1 : n - 1 + len(h)]
    return h[keep], row[: len(h)][keep]


def sketch(h: np.ndarray, row: np.ndarray, rows: int, cells: int, dense: bool) -> np.ndarray:
    """[rows, cells] min-hashes: one permutation cut into cells (empty cells borrow from the next), or one hash per cell for short texts."""
    out = np.full((rows, cells), EMPTY, np.uint64)
    if not len(h):
        return out
    if dense:
        begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        for c in range(cells):
            out[row[begin], c] = np.minimum.reduceat(P.mix(h ^ np.uint64((c + 1) * 0xD1B54A32D192ED03 % 2**64)), begin)
        return out
    cell = ((h >> np.uint64(40)) * np.uint64(cells)) >> np.uint64(24)
    np.minimum.at(out.ravel(), row * cells + cell.astype(np.int64), P.mix(h))
    some = np.zeros(rows, bool)
    some[row] = True
    for step in range(cells):
        hole = (out == EMPTY) & some[:, None]
        if not hole.any():
            break
        out = np.where(hole, np.roll(out, -1, axis=1), out)
    return out


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each bit pattern in the Gray order (the inverse of the Gray code)."""
    x = x.astype(np.uint64).copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def pack(cells: np.ndarray, bits: int) -> np.ndarray:
    """[rows, words] fingerprints of the low bits of each cell."""
    per = 64 // bits
    low = cells & np.uint64((1 << bits) - 1)
    words = -(-cells.shape[1] // per)
    out = np.zeros((len(cells), words), np.uint64)
    for c in range(cells.shape[1]):
        out[:, c // per] |= low[:, c] << np.uint64(bits * (c % per))
    return out


def differing(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Cells in which some bit of x is set, summed over the words."""
    y = x
    for b in range(1, bits):
        y = y | (x >> np.uint64(b))
    lanes = np.uint64(sum(1 << i for i in range(0, 64, bits)))
    return np.bitwise_count(y & lanes).sum(axis=-1).astype(np.int64)


class Levels:
    """The hierarchy over fingerprints in Gray order: per level, the pattern and the mask of the bits that all members of each group share."""

    def __init__(self, words: np.ndarray, fan: int = FAN):
        self.fan, self.levels = fan, [(words, np.full(words.shape, EMPTY))]
        while len(self.levels[-1][0]) > fan:
            pattern, mask = self.levels[-1]
            begin = np.arange(0, len(pattern), fan)
            first = np.repeat(pattern[begin], np.diff(np.r_[begin, len(pattern)]), axis=0)
            unlike = np.bitwise_or.reduceat((pattern ^ first) | ~mask, begin, axis=0)
            self.levels.append((pattern[begin], ~unlike))

    def search(self, query: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """All (query, leaf) with at most limit differing cells."""
        top = len(self.levels) - 1
        found_q, found_l = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if not len(self.levels[0][0]):
            return found_q[0], found_l[0]
        step = max(16, min(4096, LOOKS // len(self.levels[0][0])))
        for a in range(0, len(query), step):
            part = query[a : a + step]
            n = len(self.levels[top][0])
            q, node = np.repeat(np.arange(len(part)), n), np.tile(np.arange(n), len(part))
            for level in range(top, -1, -1):
                pattern, mask = self.levels[level]
                ok = differing((part[q] ^ pattern[node]) & mask[node]) <= limit
                q, node = q[ok], node[ok]
                if level:
                    below = len(self.levels[level - 1][0])
                    lo, hi = node * self.fan, np.minimum(node * self.fan + self.fan, below)
                    q, node = np.repeat(q, hi - lo), P.ragged(lo, hi)
            found_q.append(q + a)
            found_l.append(node)
        return np.concatenate(found_q), np.concatenate(found_l)


def full_of(rows: DataFrame) -> DataFrame:
    """(bucket, parts) of the node buckets that hold too many rows; at most NODE_BUCKETS rows."""
    counts = cut(rows.groupBy("bucket").count())
    usual = counts.agg(F.avg("count")).first()[0] or 0
    return counts.where(F.col("count") > 2 * usual + NODE).select("bucket", F.least(F.ceil(F.col("count") / NODE), F.lit(MOST_PARTS)).cast("int").alias("parts"))


def candidates(df: DataFrame, limit: int) -> DataFrame:
    """Pairs (a, b), a < b, of classes in one node with at most limit differing cells. df: _class, _nodes array<long>, _print binary."""
    rows = df.select("_class", "_print", F.explode("_nodes").alias("node"))
    # the low bits of a node are those of its last cell alone, so they are mixed
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(NODE_BUCKETS)).cast("int"))
    rows = rows.join(F.broadcast(full_of(rows)), "bucket", "left").select("_class", "_print", "node", "parts")
    own = F.pmod(F.xxhash64("_class"), F.col("parts")).cast("int")
    at = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    )
    rows = rows.withColumn("own", F.coalesce(own, F.lit(0))).withColumn("at", F.explode(at)).select("node", F.col("at.i").alias("i"), F.col("at.j").alias("j"), "own", "_class", "_print")
    sorted_ = rows.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j", "_print")

    def solve(batches):
        carry = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if carry is None else pa.concat_tables([carry, pa.Table.from_batches([batch])])
            if not len(table):
                continue
            key = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("node", "i", "j")], 1)
            begin = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
            carry = table.slice(begin[-1])
            if begin[-1]:
                yield pairs_of(table.slice(0, begin[-1]), begin, limit)
        if carry is not None:
            yield pairs_of(carry, np.array([0, len(carry)]), limit)

    return sorted_.mapInArrow(solve, "a long, b long").distinct()


def binary(rows: np.ndarray) -> pa.Array:
    """Each row as bytes."""
    wide = rows.itemsize * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, wide * (len(rows) + 1), wide, dtype=np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def pairs_of(table: pa.Table, begin: np.ndarray, limit: int) -> pa.RecordBatch:
    """Candidates of complete groups; begin holds the first row of each and the end."""
    who = table.column("_class").to_numpy()
    i, j, own = (table.column(c).to_numpy() for c in ("i", "j", "own"))
    size = np.diff(begin)
    some = np.flatnonzero(size > 1)
    out = [np.zeros((0, 2), np.int64)]
    if len(some):
        words = np.frombuffer(b"".join(table.column("_print").to_pylist()), np.uint64).reshape(len(who), -1)
        two = begin[some[size[some] == 2]]
        two = two[(i[two] == j[two]) | (own[two] != own[two + 1])]
        two = two[differing(words[two] ^ words[two + 1]) <= limit]
        out.append(np.stack([who[two], who[two + 1]], 1))
        for g in some[size[some] > 2]:
            s = slice(begin[g], begin[g] + size[g])
            left, right = (slice(None),) * 2 if i[s][0] == j[s][0] else (own[s] == i[s][0], own[s] == j[s][0])
            w, c = words[s], who[s]
            # the hierarchy is over the members in Gray order
            o = np.lexsort([gray_rank(w[right][:, k]) for k in range(w.shape[1])])
            q, leaf = Levels(w[right][o]).search(w[left], limit)
            out.append(np.stack([c[left][q], c[right][o][leaf]], 1))
    pair = np.concatenate(out)
    pair = np.unique(np.sort(pair[pair[:, 0] != pair[:, 1]], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])


def jaccard(a: pa.Array, b: pa.Array, n: int) -> np.ndarray:
    """The likeness of the n-gram sets of each two texts."""
    rows = len(a)
    out = np.zeros(rows)
    sides = [list(P.chunks(x, 1 << 62)) for x in (a, b)]
    if not rows:
        return out
    # (row, 44 bits of the hash) in one integer: two of a few thousand n-grams agree there by chance once in a million texts
    sets = []
    for side in sides:
        h, row = shingles(side[0][2], side[0][3], n)
        sets.append(np.unique(row.astype(np.uint64) << np.uint64(44) | h >> np.uint64(20)))
    keys = np.sort(np.concatenate(sets))
    row = (keys >> np.uint64(44)).astype(np.int64)
    both = np.bincount(row[1:][keys[1:] == keys[:-1]], minlength=rows)
    total = np.bincount(row, minlength=rows) - both
    return np.where(total > 0, both / np.maximum(total, 1), 0.0)


class Near:
    """The near copies of one text column: members (id, class) and links (a, b) between different classes."""

    def __init__(self, df: DataFrame, key: str, text: str, n: int, least: float, shortest: int, blanks: bool = True, dense: bool = False):
        rows = spread(df.where(F.col(key).isNotNull() & (F.length(text) >= shortest)).select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text")))
        # the BAND cells of the view are known to agree
        agree = least + (1 - least) / 2**BITS
        limit = math.ceil((CELLS - BAND) * (1 - agree) + ROOM * math.sqrt((CELLS - BAND) * agree * (1 - agree)))

        def index(batches):
            for batch in batches:
                for a, _, cp, off in P.chunks(batch.column(1)):
                    cp, off = normal(cp, off, blanks)
                    size = np.diff(off)
                    h, row = shingles(cp, off, n)
                    cells = sketch(h, row, len(size), CELLS, dense)
                    text_hash = P.mix(P.spans(P.prefix(cp), off[:-1], off[1:]) ^ size.astype(np.uint64)).view(np.int64)
                    nodes = []
                    for view in range(VIEWS):
                        pattern = np.zeros(len(size), np.uint64)
                        for c in range(view * BAND, view * BAND + BAND):
                            pattern = (pattern << np.uint64(20)) | (cells[:, c] >> np.uint64(44))
                        nodes.append(gray_rank((np.uint64(view) << np.uint64(60)) | pattern))
                    nodes = np.stack(nodes, 1).view(np.int64)
                    words = pack(cells, BITS)
                    keep = np.flatnonzero(size >= shortest)
                    if not len(keep):
                        continue
                    views = nodes.shape[1]
                    lists = pa.ListArray.from_arrays(np.arange(0, views * (len(keep) + 1), views, dtype=np.int32), pa.array(nodes[keep].ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep + a)), pa.array(text_hash[keep]), lists, binary(words[keep])], ["_id", "_class", "_nodes", "_print"])

        indexed = cut(rows.mapInArrow(index, "_id long, _class long, _nodes array<long>, _print binary"))
        self.members = indexed.select("_id", "_class").distinct()
        pairs = cut(candidates(indexed.select("_class", "_nodes", "_print").dropDuplicates(["_class"]), limit))
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("_class")).distinct()
        few = prune(indexed.select("_id", "_class"), wanted, "_class").join(wanted, "_class", "left_semi").groupBy("_class").agg(F.min("_id").alias("_id"))
        few = cut(few)
        texts = prune(rows, few, "_id").join(few, "_id").groupBy("_class").agg(F.min("_text").alias("_text"))

        def verify(batches):
            for batch in batches:
                a, b = batch.column(0), batch.column(1)
                for s in range(0, len(a), 512):
                    sides = []
                    for c in (2, 3):
                        done = [P.strings(*normal(cp, off, blanks)) for _, _, cp, off in P.chunks(batch.column(c).slice(s, 512))]
                        sides.append(pa.concat_arrays(done))
                    like = jaccard(*sides, n)
                    ok = np.flatnonzero(like >= least - 1e-12)
                    yield pa.RecordBatch.from_arrays([a.take(pa.array(ok + s)), b.take(pa.array(ok + s)), pa.array(like[ok])], ["a", "b", "likeness"])

        one, two = (texts.select(F.col("_class").alias(c), F.col("_text").alias(f"text_{c}")) for c in "ab")
        self.links = cut(pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long, likeness double"))

    def pairs(self, expand: int = EXPAND) -> DataFrame:
        """(id_a, id_b), id_a < id_b. Rows of equal text: all pairs up to `expand` rows, else each row with the least one; links: of all rows of both
        texts where they have up to `expand`, else of the least row."""
        sizes = self.members.groupBy("_class").agg(F.count("*").alias("n"), F.min("_id").alias("rep"))
        linked = self.links.select(F.explode(F.array("a", "b")).alias("_class")).distinct()
        some = sizes.where("n > 1").select("_class").union(linked).distinct()
        rows = prune(self.members, some, "_class").join(sizes.join(some, "_class", "left_semi"), "_class")
        listed = rows.where((F.col("n") <= expand) | (F.col("_id") == F.col("rep"))).select("_class", "_id")
        small = rows.where((F.col("n") > 1) & (F.col("n") <= expand)).select("_class", "_id")
        copies = small.join(small.select("_class", F.col("_id").alias("other")), "_class").where("_id < other").select("_id", "other")
        large = rows.where((F.col("n") > expand) & (F.col("_id") != F.col("rep"))).select("rep", "_id")
        a, b = (listed.select(F.col("_class").alias(c), F.col("_id").alias(f"id_{c}")) for c in "ab")
        between = self.links.join(a, "a").join(b, "b").select("id_a", "id_b")
        every = copies.toDF("id_a", "id_b").union(large.toDF("id_a", "id_b")).union(between)
        return every.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))

    def classes(self) -> DataFrame:
        """(id, class_id, copies, links): the least id of equal texts, their number, and the number of different texts that are near."""
        sizes = self.members.groupBy("_class").agg(F.count("*").alias("copies"), F.min("_id").alias("class_id"))
        degree = self.links.select(F.explode(F.array("a", "b")).alias("_class")).groupBy("_class").agg(F.count("*").alias("links"))
        return self.members.join(sizes.join(degree, "_class", "left"), "_class").select(F.col("_id").alias("id"), "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))


    def groups(self) -> DataFrame:
        """(id, group_id, members): the connected groups of rows, by their least id; a row that is near no other is a group of its own."""
        labels = components(self.links.select("a", "b"))
        labelled = self.members.join(labels, "_class", "left").select("_id", F.coalesce("label", "_class").alias("label"))
        sizes = labelled.groupBy("label").agg(F.min("_id").alias("group_id"), F.count("*").alias("members"))
        return labelled.join(sizes, "label").select(F.col("_id").alias("id"), "group_id", "members")


def components(edges: DataFrame) -> DataFrame:
    """(_class, label): the least node of each node's component; nodes without an edge are left out.

    Alternating large and small stars (Kiveris et al. 2014): each round a join and two aggregations of the edges, a number of rounds logarithmic in the
    longest path; only the number of changed edges comes to the driver.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        turned = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        down = turned.groupBy("u").agg(F.min("v").alias("m"))
        small = turned.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(down.select("u", F.col("m").alias("v")))
        fresh = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        if not fresh.exceptAll(now).limit(1).count() and not now.exceptAll(fresh).limit(1).count():
            break
        now = fresh
    return fresh.select(F.col("u").alias("_class"), F.col("v").alias("label")).union(fresh.select(F.col("v").alias("_class"), F.col("v").alias("label"))).distinct()


def near_texts(df: DataFrame, key: str = "segment_row_id", text: str = "content") -> Near:
    """Texts of at least 200 characters, after lower-casing and joining blanks, with likeness >= 0.6 of their 8-grams.

    Null keys and null, empty or short texts take no part; rows repeated in full count once; other columns are not read; an empty table gives no row.
    """
    return Near(df, key, text, 8, 0.6, 200)


def near_names(df: DataFrame, key: str = "doc_id", name: str = "filename") -> Near:
    """Names without the part from the last dot on, lower-cased, of at least 16 characters, with likeness >= 0.7 of their 3-grams; else as near_texts."""
    stem = F.regexp_replace(F.col(name), r"(?s)\.[^.]*\z", "")
    return Near(df.select(F.col(key), stem.alias("_stem")), key, "_stem", 3, 0.7, 16, blanks=False, dense=True)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = near_texts(read(spark, sf_dir, "doc_segments")).pairs()
    names = near_names(read(spark, sf_dir, "documents")).pairs()
    return texts.select(F.lit("segment").alias("kind"), "id_a", "id_b").union(names.select(F.lit("filename").alias("kind"), "id_a", "id_b"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_texts(read(spark, sf_dir, "doc_segments")).classes().withColumnRenamed("id", "segment_row_id")


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_texts(read(spark, sf_dir, "doc_segments")).groups().withColumnRenamed("id", "segment_row_id")


def p1_name_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_names(read(spark, sf_dir, "documents")).classes().withColumnRenamed("id", "doc_id")


def p1_name_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_names(read(spark, sf_dir, "documents")).groups().withColumnRenamed("id", "doc_id")


QUERIES = {"p1_found": p1_found, "p1_classes": p1_classes, "p1_groups": p1_groups, "p1_name_classes": p1_name_classes, "p1_name_groups": p1_name_groups}
SQL: dict[str, str] = {}
