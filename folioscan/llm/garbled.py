"""Problem 2: text garbled by a wrong character encoding.

Clean words are counted over the whole corpus: words with letters beyond ASCII, runs of such characters inside them, and pairs of adjoining ideographs.
Each is written in one encoding and read in another, along every chain of CHAINS, which gives the table of garbled forms (form, original, chain).
A form that is itself a usual word of the corpus is dropped by a join with the counts, unless it is so only by lines that repeat. The documents' tokens (words, runs, words
with ideographs between their letters, and text beyond ASCII in the lengths the forms of ideographs have) are then hash-joined with the table; what
matches, and every replacement character, is garbled. The table stays distributed: a filter of fixed size, made of its hashes, keeps all but a few of the
tokens that match nothing from being shuffled, and a record's matches are judged together, however large the table is.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import points as P
from .tables import Sieve, cut, prune, read, spread

# Fixed values: (written, read) of each step of a chain; ansi is Windows-1252 with its five undefined bytes kept as control characters.
CHAINS = (
    (("utf-8", "ansi"),),
    (("utf-8", "latin-1"),),
    (("utf-8", "cp437"),),
    (("utf-8", "cp850"),),
    (("utf-8", "mac_roman"),),
    (("utf-8", "gb18030"),),
    (("utf-8", "big5"),),
    (("gb18030", "latin-1"),),
    (("gb18030", "ansi"),),
    (("gb18030", "big5"),),
    (("gb18030", "utf-8"),),
    (("big5", "latin-1"),),
    (("big5", "ansi"),),
    (("big5", "gb18030"),),
    (("big5", "utf-8"),),
    (("ansi", "cp437"),),
    (("ansi", "cp850"),),
    (("ansi", "mac_roman"),),
    (("ansi", "utf-8"),),
    (("ansi", "gb18030"),),
    (("ansi", "big5"),),
    (("cp437", "ansi"),),
    (("cp850", "ansi"),),
    (("mac_roman", "ansi"),),
    (("utf-8", "ansi"), ("utf-8", "ansi")),
    (("utf-8", "latin-1"), ("utf-8", "latin-1")),
)
#: A garbled form is dropped if it occurs more than USUAL times as often as its original in distinct lines; if it stands in no more distinct lines than
#: the original, it is kept where its count over all lines is within USUAL too. A word that occurs less than CLEAN times can have no form that occurs
#: and is kept, so it need not be garbled.
USUAL = 0.25
CLEAN = math.ceil(1 / USUAL)
LOST = 0xFFFD
WIDE = re.compile("[\u3000-\u303f\u3400-\u9fff\uf900-\ufaff\uff00-\uffef\U00020000-\U0003ffff]")


def write(text: str, encoding: str) -> bytes:
    if encoding != "ansi":
        return text.encode(encoding)
    return b"".join(c.encode("latin-1") if ord(c) in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else c.encode("cp1252") for c in text)


def decode(data: bytes, encoding: str) -> str:
    if encoding != "ansi":
        return data.decode(encoding, "replace")
    return "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in data)


def garble(text: str, chain) -> str | None:
    """The form of text after the chain; None if it cannot be written so."""
    try:
        for wrote, got in chain:
            text = decode(write(text, wrote), got)
    except UnicodeError:
        return None
    return text


def restore(text: str, chain) -> str | None:
    """The text before the chain, if the chain leads from it to exactly this text."""
    out = text
    try:
        for wrote, got in reversed(chain):
            out = write(out, got).decode("cp1252" if wrote == "ansi" else wrote)
    except UnicodeError:
        return None
    return out if "�" not in text and garble(out, chain) == text else None


def shape(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(beyond ASCII, ideograph or full-width mark, part of a word of letters)."""
    high = cp >= 0x80
    wide = (cp >= 0x3000) & (cp <= 0x303F) | (cp >= 0x3400) & (cp <= 0x9FFF) | (cp >= 0xFF00) & (cp <= 0xFFEF) | (cp >= 0xF900) & (cp <= 0xFAFF) | (cp >= 0x20000)
    word = (high & ~wide) | (cp >= 65) & (cp <= 90) | (cp >= 97) & (cp <= 122)
    return high, wide, word


def stretches(flag: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the longest runs of flagged characters inside a row."""
    if not len(flag):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(flag) + 1, bool)
    edge[off] = True
    edge[1:-1] |= flag[1:] != flag[:-1]
    edge[[0, -1]] = True
    at = np.flatnonzero(edge)
    keep = flag[at[:-1]]
    return at[:-1][keep], at[1:][keep]


def tokens(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of words with a character beyond ASCII, of the runs of such characters that are not the whole word, and of words of Latin letters
    and ideographs: some chains turn an accented letter, or it and the next one, into an ideograph."""
    high, wide, word = shape(cp)
    s, e = stretches(word, off)
    count = np.concatenate([[0], np.cumsum(high)])
    some = count[e] > count[s]
    s, e = s[some], e[some]
    rs, re_ = stretches(high & ~wide, off)
    ideograph = wide & (cp >= 0x3400) & ((cp < 0xFF00) | (cp >= 0x20000))
    ms, me = stretches(word | ideograph, off)
    letters, signs = (np.concatenate([[0], np.cumsum(x)]) for x in (word & ~high, ideograph))
    mixed = (letters[me] - letters[ms] > 1) & (signs[me] > signs[ms])
    ms, me = ms[mixed], me[mixed]
    o = np.lexsort((np.r_[e, re_, me], np.r_[s, rs, ms]))
    s, e = np.r_[s, rs, ms][o], np.r_[e, re_, me][o]
    new = np.r_[True, (s[1:] != s[:-1]) | (e[1:] != e[:-1])] if len(s) else np.zeros(0, bool)
    return s[new], e[new]


def vocabulary(texts: DataFrame) -> DataFrame:
    """(token, n, d): the counts of words, runs, ideographs and pairs of them over all texts, and over their distinct lines.

    No token crosses a line, so n does not depend on the lines; d does not depend on how often a text or most of it is stored again.
    """
    text = texts.columns[0]
    # only lines with a character beyond ASCII hold tokens
    lines = texts.where(F.length(text) != F.octet_length(text)).select(F.explode(F.split(text, "\n")).alias("_line")).where(F.length("_line") != F.octet_length("_line"))
    lines = lines.groupBy("_line").agg(F.count("*").alias("copies"))

    def count(batches):
        pairs: dict[int, list[int]] = {}
        words: dict[str, list[int]] = {}
        for batch in batches:
            copies = batch.column(1).to_numpy()
            for a, b, cp, off in P.chunks(batch.column(0)):
                _, wide, _ = shape(cp)
                times = copies[a:b]
                row = P.rows_of(off)
                first = np.zeros(len(cp) + 1, bool)
                first[off] = True
                two = np.flatnonzero(wide[:-1] & wide[1:] & ~first[1:-1]) if len(cp) > 1 else np.zeros(0, np.int64)
                one = np.flatnonzero(wide)
                for key, at in ((cp[two].astype(np.int64) << 21 | cp[two + 1].astype(np.int64), two), (cp[one].astype(np.int64), one)):
                    u, code, d = np.unique(key, return_inverse=True, return_counts=True)
                    n = np.bincount(code, times[row[at]], len(u)).astype(np.int64)
                    for k, x, y in zip(u.tolist(), n.tolist(), d.tolist()):
                        add(pairs, k, x, y)
                s, e = tokens(cp, off)
                _, at, code, d = np.unique(P.spans(P.prefix(cp), s, e), return_index=True, return_inverse=True, return_counts=True)
                n = np.bincount(code, times[row[s]] if len(s) else s, len(at)).astype(np.int64)
                for i, j, x, y in zip(s[at].tolist(), e[at].tolist(), n.tolist(), d.tolist()):
                    add(words, cp[i:j].tobytes().decode("utf-32-le"), x, y)
            if len(pairs) + len(words) > 500_000:
                yield batch_of(pairs, words)
                pairs, words = {}, {}
        yield batch_of(pairs, words)

    return lines.mapInArrow(count, "token string, n long, d long").groupBy("token").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def add(sums: dict, key, n: int, d: int) -> None:
    old = sums.setdefault(key, [0, 0])
    old[0] += n
    old[1] += d


def batch_of(pairs: dict[int, list[int]], words: dict[str, list[int]]) -> pa.RecordBatch:
    names = [(chr(k >> 21) if k >> 21 else "") + chr(k & 0x1FFFFF) for k in pairs] + list(words)
    counts = [*pairs.values(), *words.values()]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[i] for c in counts], pa.int64()) for i in (0, 1))], ["token", "n", "d"])


def forms(words: DataFrame) -> DataFrame:
    """(form, original, chain): the garbled forms of the clean words that are not usual words themselves; of several originals the most usual."""

    def make(batches):
        for batch in batches:
            out = []
            for token, n, d in zip(*(c.to_pylist() for c in batch.columns)):
                if "�" in token or len(token) == 1 and WIDE.match(token):
                    continue
                gram = bool(WIDE.match(token))
                for i, chain in enumerate(CHAINS):
                    form = garble(token, chain)
                    # a form of one character is no evidence, nor is one of ASCII; with a lost character it is found by that
                    if form and form != token and len(form) > 1 and not form.isascii():
                        out.append((form, token, i, n, d, gram))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()))], ["form", "original", "chain", "n", "d", "gram"])

    made = words.where(F.col("n") >= CLEAN).repartition("token").mapInArrow(make, "form string, original string, chain int, n long, d long, gram boolean")
    best = made.groupBy("form", "gram").agg(F.max(F.struct("d", "n", (-F.col("chain")).alias("c"), "original")).alias("x"))
    best = best.select("form", "gram", F.col("x.original").alias("original"), (-F.col("x.c")).alias("chain"), F.col("x.n").alias("n"), F.col("x.d").alias("d"))
    # a form is usual if it, a pair of ideographs in it or a lone ideograph in it is: else garbled words that are counted as clean would turn clean
    # text into forms; garbled text itself, stored many times, must not make it so, hence the distinct lines
    wide = r"[\u3000-\u303f\u3400-\u9fff\uf900-\ufaff\uff00-\uffef]"
    pairs = F.filter(F.transform(F.sequence(F.lit(1), F.length("form") - 1), lambda i: F.substring(F.col("form"), i, F.lit(2))), lambda p: p.rlike(wide + "{2}"))
    lone = F.regexp_extract_all("form", F.lit(f"(?<!{wide})({wide})(?!{wide})"), F.lit(1))
    # among Latin letters an ideograph is no usual one, however often it stands elsewhere
    within = F.when(~F.col("gram") & F.col("form").rlike("[A-Za-z]"), F.array("form")).otherwise(F.concat(F.array("form"), pairs, lone))
    parts = best.select("form", "gram", "original", "chain", "n", "d", F.explode(F.array_distinct(within)).alias("token"))
    counts = words.select("token", F.col("n").alias("own"), F.col("d").alias("own_d"))
    own = parts.join(counts, "token", "left").groupBy("form", "gram", "original", "chain", "n", "d").agg(*(F.max(F.coalesce(c, F.lit(0))).alias(c) for c in ("own", "own_d")))
    return own.where((F.col("own_d") <= USUAL * F.col("d")) | (F.col("own") <= USUAL * F.col("n")) & (F.col("own_d") <= F.col("d"))).select("form", "original", "chain", "gram")


def kinded(h: np.ndarray, gram) -> np.ndarray:
    """Forms of words match whole words and runs, forms of ideographs any place of their length: two kinds of hashes."""
    return P.mix(h ^ np.where(gram, np.uint64(1), np.uint64(0)))


def hashed(table: DataFrame) -> DataFrame:
    """(hash, size, gram, chain) of the forms."""

    def add_hash(batches):
        for batch in batches:
            gram = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, b, cp, off in P.chunks(batch.column(0)):
                h = kinded(P.spans(P.prefix(cp), off[:-1], off[1:]), gram[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.diff(off).astype(np.int32)), batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a)], ["hash", "size", "gram", "chain"])

    return table.select("form", "gram", "chain").mapInArrow(add_hash, "hash long, size int, gram boolean, chain int")


def passing(cp: np.ndarray, off: np.ndarray, sieve: Sieve, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the tokens that may be forms."""
    sums = P.prefix(cp)
    s, e = tokens(cp, off)
    h = kinded(P.spans(sums, s, e), False)
    i = sieve.passes(h)
    out = [(s[i], e[i], h[i])]
    high = cp >= 0x80
    count = np.concatenate([[0], np.cumsum(high)])
    row = P.rows_of(off)
    for n in sizes:
        i = np.flatnonzero(high[: max(0, len(cp) - n + 1)])
        # the second byte of a Big5 or GB character can be ASCII, so half of the characters may be
        i = i[(count[i + n] - count[i] >= (n + 1) // 2) & (row[i] == row[i + n - 1])] if len(i) else i
        h = kinded(P.spans(sums, i, i + n), True)
        some = sieve.passes(h)
        out.append((i[some], i[some] + n, h[some]))
    return tuple(np.concatenate([x[k] for x in out]) for k in range(3))


def matches(rows: DataFrame, key: str) -> DataFrame:
    """(key, _h, start, end, chain) of the tokens that are garbled forms. rows: key, _h, _text."""
    table = cut(hashed(forms(cut(vocabulary(rows.select("_text"))))))
    # a few numbers: the lengths that ideographs have after a chain
    sizes = sorted(r[0] for r in table.where("gram").select("size").distinct().collect())
    shared = rows.sparkSession.sparkContext.broadcast(Sieve(table.select("hash")).words)

    def scan(batches):
        sieve = object.__new__(Sieve)
        sieve.words = shared.value
        for batch in batches:
            for a, _, cp, off in P.chunks(batch.column(2)):
                s, e, h = passing(cp, off, sieve, sizes)
                row = np.searchsorted(off, s, "right") - 1
                at = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array((s - off[row]).astype(np.int32)), pa.array((e - off[row]).astype(np.int32)), pa.array(h.view(np.int64))], [key, "_h", "start", "end", "hash"])

    held = rows.mapInArrow(scan, f"{key} long, _h long, start int, end int, hash long")
    return held.join(table.select("hash", "chain"), "hash").select(key, "_h", "start", "end", "chain")


def usual(df: DataFrame, key: str, text: str) -> DataFrame:
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    return spread(rows.select(F.col(key).cast("long").alias(key), F.xxhash64(text).alias("_h"), F.col(text).alias("_text")))


def garbled(df: DataFrame, key: str = "segment_row_id", text: str = "content") -> DataFrame:
    """(key) of the rows whose text holds a garbled token or a replacement character.

    Null and empty texts hold none; rows repeated in full give one row; null keys are left out; other columns are not read.
    """
    rows = usual(df, key, text)
    lost = rows.where(F.contains("_text", F.lit(chr(LOST)))).select(key)
    return matches(rows, key).select(key).union(lost).distinct()


def islands(group: np.ndarray, s: np.ndarray, e: np.ndarray, gap: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, start, end, tokens): tokens of a group that overlap, or leave at most `gap` characters between them, as one stretch."""
    o = np.lexsort((e, s, group))
    group, s, e = group[o], s[o], e[o]
    if not len(group):
        return group, s, e, s
    # the running greatest end inside a group: groups are far apart on the shifted axis
    big = int(e.max()) + gap + 2
    rank = np.cumsum(np.r_[False, group[1:] != group[:-1]])
    far = np.maximum.accumulate(e + rank * big)
    new = np.flatnonzero(np.r_[True, s[1:] + rank[1:] * big > far[:-1] + gap])
    return group[new], s[new], far[np.r_[new[1:], len(s)] - 1] - rank[new] * big, np.diff(np.r_[new, len(s)])


def widths(chain) -> list[tuple[int, int]]:
    """How a stretch may be longer or shorter than its tokens at both ends, the longest first: a token ends with a word, a stretch anywhere.

    Where both encodings have two bytes for a character any text can be turned, so such a stretch is not lengthened.
    """
    two = {"gb18030", "big5"}
    most = 0 if all(w in two and g in two for w, g in chain) else 3
    return sorted(((i, j) for i in range(-2, most + 1) for j in range(-2, most + 1)), key=lambda x: -sum(x))


def repair(text: str, found: list[dict]) -> tuple[str, bool]:
    """The text with its garbled stretches undone, each only if garbling gives exactly it again, and whether none is left. found: chain, hits, spans."""
    done: list[tuple[int, int, str]] = []
    left = "\ufffd" in text
    # the chain that explains most of the text comes first; no stretch reaches over a lost character
    for f in sorted(found, key=lambda f: (-sum(x["end"] - x["start"] for x in f["spans"]), -f["hits"], f["chain"])):
        chain = CHAINS[f["chain"]]
        for s, e in ((x["start"] + m.start(), x["start"] + m.end()) for x in f["spans"] for m in re.finditer("[^\ufffd]+", text[x["start"] : x["end"]])):
            if any(a < e and s < b for a, b, _ in done):
                continue
            for i, j in widths(chain):
                a, b = max(0, s - i), min(len(text), e + j)
                if a >= b or any(x < b and a < y for x, y, _ in done) or "\n" in text[a:b] and "\n" not in text[s:e]:
                    continue
                out = restore(text[a:b], chain)
                if out is not None:
                    done.append((a, b, out))
                    break
            else:
                left = True
    for a, b, out in sorted(done, reverse=True):
        text = text[:a] + out + text[b:]
    return text, not left


def stretched(tokens_: list[dict]) -> list[dict]:
    """The matches of a record by chain, adjoining ones as one stretch, as repair() takes them."""
    chain, s, e = (np.array([x[c] for x in tokens_], np.int64) for c in ("chain", "start", "end"))
    group, first, last, n = islands(chain, s, e)
    out: dict[int, dict] = {}
    for c, a, b, k in zip(group.tolist(), first.tolist(), last.tolist(), n.tolist()):
        f = out.setdefault(c, {"chain": c, "hits": 0, "spans": []})
        f["hits"] += k
        f["spans"].append({"start": a, "end": b})
    return list(out.values())


def restored(df: DataFrame, key: str = "segment_row_id", text: str = "content") -> DataFrame:
    """(key, restored, complete) of the garbled rows: chains that explain most characters first; complete is false where characters were lost.

    Nulls, empty texts and repeated rows as in garbled(). The matches of one record are read together, as many as its length allows.
    """
    rows = usual(df, key, text)
    found = matches(rows, key).groupBy(key, "_h").agg(F.collect_set(F.struct("chain", "start", "end")).alias("found"))
    lost = rows.where(F.contains("_text", F.lit(chr(LOST)))).select(key, "_h").withColumn("found", F.lit(None).cast("array<struct<chain:int,start:int,end:int>>"))
    found = cut(found.union(lost).groupBy(key, "_h").agg(F.max("found").alias("found")))
    held = prune(rows, found, key).distinct().join(found, [key, "_h"])

    def undo(batches):
        for batch in batches:
            done = [repair(t, stretched(f or [])) for t, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.bool_())], [key, "restored", "complete"])

    return held.select(key, "_text", "found").mapInArrow(undo, f"{key} long, restored string, complete boolean")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled(read(spark, sf_dir, "doc_segments"))


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restored(read(spark, sf_dir, "doc_segments"))


QUERIES = {"p2_found": p2_found, "p2_restored": p2_restored}
SQL: dict[str, str] = {}
