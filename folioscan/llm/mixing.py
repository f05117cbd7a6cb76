"""Problem 8: mixing sources to target weights.

The cube method (Deville and Tille 2004; fast flight of Chauvet and Tille 2006). Each source gets an expected number of copies per document, its
share of the wanted total over its tokens; the whole part is taken for sure and the fraction is an inclusion probability. The flight phase takes
three open documents of a source at a time and moves their probabilities along the null space of the two constraints (tokens and documents),
until one of them is 0 or 1, so both totals stay exact. It runs in every stratum of a source on its own, in the order of the keys; strata are taken by the
hash of the key, as many as the number of the source's documents asks for, so the draw depends on tables and seed only, not on partitions. The few
documents each stratum leaves open are flown again per source, and the last few are decided in the landing phase by the least deviation from the target tokens.
"""

from __future__ import annotations

import base64
import math
import random
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import cut, read, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern by which the public byte-level tokenizers part text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Sources a mixture may have; their table is read by the driver.
MOST_SOURCES = 100_000
NEAR = 1e-9
#: Share of a source's wanted tokens above which a document is drawn before the flight.
GREAT = 0.03
#: Share of the targets that very small sources may miss: none, unless mix() is told otherwise.
SHORT = 0.0
#: Documents of a source that are left to the landing phase, besides the two of the flight.
LANDED = 8
#: Documents of a stratum.
STRATUM = 20_000


def encoder(path: str = TOKENIZER):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, source: str, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of each text that is not null; source lower-cased and trimmed."""
    rows = spread(df.where(F.col(key).isNotNull() & F.col(text).isNotNull() & F.col(source).isNotNull()).select(F.col(key).cast("long"), F.lower(F.trim(source)), F.col(text)))

    def count(batches):
        e = encoder(path)
        for batch in batches:
            n = [len(x) for x in e.encode_ordinary_batch(batch.column(2).to_pylist(), num_threads=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    return rows.mapInArrow(count, "doc_id long, source string, tokens long")


class Flight:
    """The open documents of one source, at most `keep`, two at least, between two steps."""

    def __init__(self, seed: int, keep: int = 2):
        self.keep = keep
        self.open: list[list] = []  # [probability, tokens, id]
        self.random = random.Random(seed)

    def step(self, p: float, tokens: int, who) -> list[tuple]:
        """Takes in a document; returns the documents decided by that, as (id, tokens, taken)."""
        self.open.append([p, tokens, who])
        decided = self._settled()
        while len(self.open) > self.keep:
            a, b, c = self.open[:3]
            # orthogonal to (1, 1, 1) and to the tokens
            u = [b[1] - c[1], c[1] - a[1], a[1] - b[1]]
            if not any(u):
                u = [1, -1, 0]
            up = min((1 - x[0]) / v if v > 0 else -x[0] / v for x, v in zip((a, b, c), u) if v)
            down = min(x[0] / v if v > 0 else (x[0] - 1) / v for x, v in zip((a, b, c), u) if v)
            move = up if self.random.random() * (up + down) < down else -down
            for x, v in zip((a, b, c), u):
                x[0] += move * v
            decided += self._settled()
        return decided

    def _settled(self) -> list[tuple]:
        done = [x for x in self.open if x[0] < NEAR or x[0] > 1 - NEAR]
        if done:
            self.open = [x for x in self.open if NEAR <= x[0] <= 1 - NEAR]
        return [(x[2], x[1], x[0] > 0.5) for x in done]

    def land(self) -> list[tuple]:
        """Decides the rest by the least deviation of the tokens, ties by that of the documents."""
        n = len(self.open)
        want, count = (sum(x[0] * (x[1], 1)[i] for x in self.open) for i in (0, 1))
        best = min(range(1 << n), key=lambda m: (abs(sum(x[1] for i, x in enumerate(self.open) if m >> i & 1) - want), abs(m.bit_count() - count)))
        done = [(x[2], x[1], bool(best >> i & 1)) for i, x in enumerate(self.open)]
        self.open = []
        return done


class Mixture:
    """Tokens per source, wanted total and rates; documents draws, shares reports."""

    def __init__(self, docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 42, path: str = TOKENIZER, short: float = SHORT):
        self.seed = seed
        wanted = targets.where("source is not null and target_share > 0").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.sum("target_share").cast("double").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("most"))
        rows = wanted.limit(MOST_SOURCES + 1).collect()
        if len(rows) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        self.targets = {r["source"]: (r["share"], max(0, r["most"])) for r in rows}
        spark = docs.sparkSession
        known = spark.createDataFrame([(s,) for s in self.targets] or [("",)], "source string")
        counted = token_counts(docs, "doc_id", "text", "source", path).where("tokens > 0")
        once = counted.join(F.broadcast(known), "source", "left_semi").groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("x"))
        self.tokens = cut(once.select("doc_id", "x.source", "x.tokens").sortWithinPartitions("doc_id"))
        self.have = {r["source"]: (r["tokens"], r["docs"]) for r in self.tokens.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).toLocalIterator()}
        live = {s: (share, most) for s, (share, most) in self.targets.items() if s in self.have and most > 0}
        whole = sum(share for share, _ in live.values())
        self.share = {s: share / whole for s, (share, _) in live.items()}
        # up to this total a source can have its share; sources that fall short by then make up at most `short` of all shares
        level = sorted((most * self.have[s][0] / self.share[s], s) for s, (_, most) in live.items())
        limit, left = 0.0, short + NEAR
        for limit, s in level:  # noqa: B007
            left -= self.share[s]
            if left < 0:
                break
        self.total = limit if total is None else float(total)
        self.rate = {s: min(float(live[s][1]), self.share[s] * self.total / self.have[s][0]) for s in live}
        # A document of more than GREAT of its source's wanted tokens would stay open to the end of the flight and could not be balanced any more, so
        # these are drawn first, each by its own probability, and the rate of the others makes up for what came out, where they can.
        want = {s: r * self.have[s][0] for s, r in self.rate.items()}
        bound = spark.createDataFrame([(s, GREAT * w, self.rate[s]) for s, w in want.items()] or [("", 0.0, 0.0)], "source string, bound double, rate double")
        chance = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
        great = self.tokens.join(F.broadcast(bound), "source").where("tokens > bound").withColumn("whole", F.floor(F.col("rate") + NEAR))
        self.great = great.withColumn("copies", (F.col("whole") + (chance < F.col("rate") - F.col("whole")).cast("int")).cast("int"))
        self.bound = {}
        for r in self.great.groupBy("source").agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("copies")).alias("drawn")).toLocalIterator():
            s, most = r["source"], live[r["source"]][1]
            rest, need = self.have[s][0] - r["t"], want[s] - r["drawn"]
            if rest > 0 and 0 <= need <= most * rest and rest * self.rate[s] >= 0.25 * want[s]:
                self.bound[s], self.rate[s] = GREAT * want[s], need / rest
        self.share = {s: t / max(sum(want.values()), NEAR) for s, t in want.items()}

    def draw(self) -> DataFrame:
        """(doc_id, source, tokens, copies) of the documents taken."""
        rate, seed, bound = self.rate, self.seed, self.bound
        schema = "doc_id long, source string, tokens long, copies int, open double"

        def whole(r: float) -> tuple[int, float]:
            n = math.floor(r + NEAR)
            return n, max(0.0, r - n)

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.float64()))], ["doc_id", "source", "tokens", "copies", "open"])

        def fly(table: pa.Table) -> pa.Table:
            o = table.sort_by("doc_id")
            source, stratum = table.column("source")[0].as_py(), table.column("stratum")[0].as_py()
            (sure, p), most = whole(rate[source]), bound.get(source, math.inf)
            flight, out = Flight(zlib.crc32(f"{seed} {source} {stratum}".encode()), LANDED + 2), []
            for who, tokens in zip(o.column("doc_id").to_pylist(), o.column("tokens").to_pylist()):
                if tokens <= most:
                    out += [(i, source, t, sure + taken, None) for i, t, taken in flight.step(p, tokens, who) if sure + taken]
            return pa.Table.from_batches([batch(out + [(x[2], source, x[1], sure, x[0]) for x in flight.open])])

        def land(table: pa.Table) -> pa.Table:
            rows = sorted(table.to_pylist(), key=lambda r: r["doc_id"])
            flight, done = Flight(zlib.crc32(f"{seed} {rows[0]['source']}".encode())), []
            # the last ones are not flown but decided together with what the flight leaves
            for r in rows[:-LANDED]:
                done += flight.step(r["open"], r["tokens"], r["doc_id"])
            flight.open += [[r["open"], r["tokens"], r["doc_id"]] for r in rows[-LANDED:]]
            done += flight.land()
            source, sure = rows[0]["source"], rows[0]["copies"]
            return pa.Table.from_batches([batch([(i, source, t, sure + taken, None) for i, t, taken in done if sure + taken])])

        # a stratum's size is bounded by the counts known, whatever share of the rows a source has
        counts = self.tokens.sparkSession.createDataFrame([(s, max(1, math.ceil(self.have[s][1] / STRATUM))) for s, r in rate.items() if r] or [("", 1)], "source string, strata int")
        dealt = self.tokens.join(F.broadcast(counts), "source").withColumn("stratum", F.pmod(F.xxhash64("doc_id"), F.col("strata")).cast("int")).drop("strata")
        flown = cut(dealt.groupBy("source", "stratum").applyInArrow(fly, schema))
        # at most LANDED + 2 open documents of each stratum
        rest = flown.where("open is not null").groupBy("source").applyInArrow(land, schema)
        first = self.great.where(F.col("source").isin(list(bound)) & (F.col("copies") > 0)).select("doc_id", "source", "tokens", "copies")
        return flown.where("open is null").union(rest).select("doc_id", "source", "tokens", "copies").union(first)

    def shares(self, drawn: DataFrame) -> DataFrame:
        """(source, target_share, feasible_share, documents, copies, tokens, actual_share, deviation): one row per target; a source without documents has 0.

        deviation: actual_share less target_share.
        """
        spark = drawn.sparkSession
        plan = spark.createDataFrame([(s, float(share), float(self.share.get(s, 0.0))) for s, (share, _) in self.targets.items()], "source string, target_share double, feasible_share double")
        got = drawn.groupBy("source").agg(F.count("*").alias("documents"), F.sum("copies").cast("long").alias("copies"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"))
        all_ = got.agg(F.sum("tokens").alias("all"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        joined = plan.join(got, "source", "left").join(F.broadcast(all_))  # all_ is one row
        actual = F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0))
        return joined.select("source", "target_share", F.round("feasible_share", 6).alias("feasible_share"), zero("documents"), zero("copies"), zero("tokens"), F.round(actual, 6).alias("actual_share"), F.round(actual - F.col("target_share"), 6).alias("deviation"))


def mix(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 42, path: str = TOKENIZER, short: float = SHORT) -> Mixture:
    """Draw documents so that each source of targets makes up its share of all tokens, none taken more than its max_repeats times.

    total: the wanted tokens; by default the most at which every source with documents can have its share within max_repeats. With `short` above 0
    it is the most at which the sources that cannot, for all of their documents taken max_repeats times, make up at most `short` of all shares. Those are taken whole, sources without documents get nothing, and the others keep their proportions; feasible_share
    is what then is possible for each. Documents with null or empty text, null key or a source that is no target are not drawn; rows repeated under one
    key count once, with the least source; sources are compared without case and outer blanks; a source given twice has the sum of its shares; a null max_repeats counts as 1. Equal token counts leave the constraints
    exact. Other columns are not read. Same tables and seed, same draw, however the rows are partitioned.
    """
    return Mixture(docs, targets, total, seed, path, short)


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "source_targets")).draw()


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "source_targets"))
    return m.shares(m.draw())


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares}
SQL: dict[str, str] = {}
