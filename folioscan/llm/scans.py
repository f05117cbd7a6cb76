"""Problem 5: noise in text from scanned pages.

An averaged-perceptron character editor (Collins 2002). For each place of a word, or of three ideographs, that could be a misrecognition it chooses
between keep and replace, delete or insert operations, and for each line end with a hyphen mark between joining with and without the mark; a second
perceptron with page-position features tells running headers, footers and page numbers from body lines. All are trained here, on noise put into clean
words and lines of the corpus, from bounded samples (TRAIN_WORDS, TRAIN_LINES). What may be misread for what is a list of fixed values.

What an edit must lead to is known from corpus counts: words of segments that are not page or image segments are clean. Edits depend on the word alone,
so they are made once for each distinct suspicious word, distributed. Edits, counts of recurring lines and of broken words stay distributed tables: each
scanned record asks for the hashes that a filter of fixed size lets pass, a join answers, and the record is judged and repaired with all of its answers.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import points as P
from .leaks import classes
from .tables import Sieve, cut, read, sampled, spread

SCANNED = ("page", "image")
# What a scan shows, and what was printed. HARD signs are no letters.
HARD = {"0": ("o", "O"), "5": ("s", "S"), "9": ("g",), "1": ("l", "i", "I"), "|": ("l", "i", "I"), "!": ("i", "l", "I")}
SOFT = (("rn", "m"), ("vv", "w"), ("VV", "W"), ("ii", "u"), ("m", "rn"), ("b", "h"), ("c", "e"), ("f", "t"), ("d", "cl"), ("cl", "d"), ("tl", "d"), ("li", "h"), ("h", "b"), ("e", "c"), ("t", "f"))
#: First letter of what a hard sign may be, and the shapes of soft places, for their number; and one writing for all that may be misread for each other.
PLAIN = str.maketrans({a: b[0] for a, b in HARD.items()})
SHAPES = tuple(a for a, _ in SOFT)
SKELETON = str.maketrans({"0": "o", "O": "o", "5": "s", "S": "s", "9": "g", "1": "l", "|": "l", "!": "l", "i": "l", "I": "l", "e": "c", "t": "c", "f": "c", "V": "v", "m": "rn", "w": "vv", "W": "vv", "u": "ll", "b": "ll", "h": "ll", "d": "cl"})
IDEOGRAPHS = {"用": "月", "入": "人", "曾": "會会", "都": "部", "申": "中", "田": "由", "木": "未本", "貝": "員", "贝": "员", "二": "三", "土": "工", "末": "未", "頂": "項", "顶": "项", "已": "己", "日": "曰目", "干": "千", "侯": "候", "白": "自", "人": "入"}
MARKS = "-‐¬­"
#: A clean word occurs so often in segments that are not scans; training samples; size of the bit map of clean words.
CLEAN, TRAIN_WORDS, TRAIN_LINES, MAP_BITS = 3, 20_000, 4_000, 22
WEIGHTS = 1 << 17


# --- the character editor


def listable(word: str) -> bool:
    """Whether variants() lists all edited words; of others, which have too many, the clean ones are found by skeleton()."""
    plain = word.translate(PLAIN)
    return len(word) <= 40 and sum(c in HARD for c in word) <= 4 and sum(plain.count(a) for a in SHAPES) <= 12


def variants(word: str) -> dict[str, tuple]:
    """Edited words with their operations (place, shown, printed): all hard signs are replaced, and up to two soft places. None if they are not listable."""
    hard = [i for i, c in enumerate(word) if c in HARD]
    out: dict[str, tuple] = {}
    if not listable(word):
        return out
    for choice in product(*(HARD[word[i]] for i in hard)):
        first = tuple((i, word[i], c) for i, c in zip(hard, choice))
        base = list(word)
        for i, _, c in first:
            base[i] = c
        joined = "".join(base)
        sites = [(m, a, b) for a, b in SOFT for m in _all(joined, a) if m not in hard or len(a) > 1]
        for n in (0, 1, 2):
            for some in combinations(sites, n):
                if n == 2 and _overlap(*some):
                    continue
                if not first and not some:
                    continue
                text = joined
                for m, a, b in sorted(some, reverse=True):
                    text = text[:m] + b + text[m + len(a) :]
                out.setdefault(text, first + some)
    return out


def skeleton(word: str) -> str:
    """The same for a word and for all that its operations can lead to."""
    return word.translate(SKELETON)


def operations(shown: str, printed: str, soft: int = 2) -> tuple | None:
    """The operations that lead from one word to the other as in variants(), with as few soft places as can be; None if none do."""
    at: list[dict] = [{} for _ in range(len(shown) + 3)]
    at[0][0, 0] = None
    for i, c in enumerate(shown):
        for (j, used), _ in at[i].items():
            if printed[j : j + 1] and (printed[j] in HARD[c] if c in HARD else printed[j] == c):
                at[i + 1].setdefault((j + 1, used), (i, j, used, ((i, c, printed[j]),) if c in HARD else (), ()))
            for a, b in SOFT if used < soft else ():
                span = shown[i : i + len(a)]
                if printed.startswith(b, j) and len(span) == len(a) and span not in HARD and all(y in HARD.get(x, x) for x, y in zip(span, a)):
                    first = tuple((i + n, x, y) for n, (x, y) in enumerate(zip(span, a)) if x in HARD)
                    at[i + len(a)].setdefault((j + len(b), used + 1), (i, j, used, first, ((i, a, b),)))
    used = next((u for u in range(soft + 1) if (len(printed), u) in at[len(shown)]), None)
    if used is None or shown == printed:
        return None
    first, some, i, j = (), (), len(shown), len(printed)
    while i:
        i, j, used, hard, more = at[i][j, used]
        first, some = hard + first, more + some
    return first + some


def _all(text: str, part: str) -> list[int]:
    found, i = [], text.find(part)
    while i >= 0:
        found.append(i)
        i = text.find(part, i + 1)
    return found


def _overlap(x: tuple, y: tuple) -> bool:
    (a, p, _), (b, q, _) = sorted((x, y))
    return a + len(p) > b


def bucket(log: float) -> int:
    return int(max(-3, min(9, round(log))))


def signs(word: str, op: tuple, own: int, own_clean: int, target: int) -> list[str]:
    """Features of an operation: the characters around its place, and what the counts say."""
    i, a, b = op
    w = f"^{word}$"
    i += 1
    kind = f"{a}>{b}"
    ratio = bucket(math.log2((target + 0.5) / (own + 0.5)))
    return [
        f"k{kind}", f"r{ratio}", f"c{bucket(math.log2(own_clean + 0.5))}", f"t{bucket(math.log2(target + 0.5) / 2)}", f"rk{ratio}{kind}", f"n{min(len(word), 8)}",
        f"l{w[i - 1 : i]}{kind}", f"x{kind}{w[i + len(a) : i + len(a) + 1]}", f"h{a in HARD}{ratio}", f"m{any(c in HARD for c in word)}",
    ]


def slot(name: str) -> int:
    return zlib.crc32(name.encode()) % WEIGHTS


def verdict(weights: np.ndarray, word: str, ops: tuple, own: int, own_clean: int, target: int) -> float:
    """How much the operations together are better than keep."""
    return float(np.mean([sum(weights[slot(s)] for s in signs(word, op, own, own_clean, target)) for op in ops]))


def garble_word(word: str, rng: random.Random) -> str:
    """A clean word as a scan might show it."""
    shown: dict[str, list[str]] = {}
    for a, b in (*((a, x) for a, xs in HARD.items() for x in xs), *SOFT[:10]):
        shown.setdefault(b, []).append(a)
    for _ in range(rng.choice((1, 1, 1, 2))):
        sites = [(i, b) for b in shown for i in _all(word, b)]
        if sites:
            i, b = rng.choice(sites)
            word = word[:i] + rng.choice(shown[b]) + word[i + len(b) :]
    return word


def misread(text: str) -> list[tuple[str, str, str]]:
    """(as shown, shown sign, printed sign) for three ideographs whose middle one may be misread."""
    return [(text[0] + shown + text[2], shown, text[1]) for shown, printed in IDEOGRAPHS.items() if text[1] in printed]


def options_of(word: str) -> dict[str, tuple]:
    """Edited words with their operations: of three ideographs the middle one, else as variants()."""
    if word[0] < "⺀":
        return variants(word)
    return {word[0] + c + word[2]: ((1, word[1], c),) for c in IDEOGRAPHS.get(word[1], "")} if len(word) == 3 else {}


def train_words(clean: dict[str, int], rounds: int = 3, seed: int = 3) -> np.ndarray:
    """Averaged perceptron over the operations on garbled words (right: the edit back) and on clean and unseen words (right: keep)."""
    rng = random.Random(seed)
    cases = []
    for w in sorted(clean):
        if len(w) < 2 or not any(c.isalpha() for c in w):
            continue
        g = garble_word(w, rng)
        own = rng.choice((1, 1, 1, 2, max(1, clean[w] // 200)))
        for text, ops in variants(g).items() if g != w else ():
            if text in clean:
                cases.append((g, ops, own, clean.get(g, 0), clean[text], text == w))
        for text, ops in variants(w).items():
            if text in clean:
                # clean words are kept; a rare one is not sure to be in the clean counts
                cases.append((w, ops, clean[w], clean[w], clean[text], False))
    return averaged([([slot(s) for op in ops for s in signs(word, op, own, own_clean, target)], right) for word, ops, own, own_clean, target, right in cases], rng, rounds)


def sign_features(shown: str, printed: str, own: int, target: int) -> list[str]:
    """Features of a misread ideograph: which, and how often the three signs stand with the one and with the other."""
    ratio = max(-8, min(16, round(2 * math.log2((target + 0.5) / (own + 0.5)))))
    return [f"s{shown}{printed}", f"sr{ratio}", f"sq{ratio // 2}", f"su{ratio > 4}", f"st{bucket(math.log2(target + 0.5) / 2)}{ratio > 3}"]


def train_signs(clean: dict[str, int], rounds: int = 3, seed: int = 4) -> np.ndarray:
    """Averaged perceptron over misread ideographs: put into clean text (right: replace), and clean ones beside a sign they resemble (right: keep)."""
    rng = random.Random(seed)
    cases = []
    for w in (w for w in sorted(clean) if len(w) == 3 and w[0] >= "⺀"):
        n = clean[w]
        for _, shown, printed in misread(w):
            own = rng.choice((1, 1, 1, 2, 3, 5, max(1, n // 200)))
            if own * 5 <= n:
                cases.append(([slot(s) for s in sign_features(shown, printed, own, n)], True))
        for printed in IDEOGRAPHS.get(w[1], ""):
            cases.append(([slot(s) for s in sign_features(w[1], printed, n, rng.randint(0, 3 * n))], False))
    return averaged(cases, rng, rounds)


def averaged(cases: list, rng: random.Random, rounds: int) -> np.ndarray:
    weights, total, step = np.zeros(WEIGHTS), np.zeros(WEIGHTS), 1
    for _ in range(rounds):
        rng.shuffle(cases)
        for at, right in cases:
            score = weights[at].sum()
            if (score > 0) != right or abs(score) < 0.5:
                change = 1.0 if right else -1.0
                np.add.at(weights, at, change)
                np.add.at(total, at, change * step)
            step += 1
    return weights - total / step


def break_signs(mark: str, plain: int, hyphened: int, capital: bool) -> list[str]:
    """Features of a word broken at a line end: its mark, and how often it stands elsewhere without and with a hyphen."""
    ratio = bucket(math.log2((plain + 0.5) / (hyphened + 0.5)))
    known = f"{min(plain, 1)}{min(hyphened, 1)}"
    return [f"b{mark}", f"br{ratio}", f"brm{ratio}{mark}", f"bk{known}", f"bkm{known}{mark}", f"bc{capital}{mark}", f"bp{bucket(math.log2(plain + 0.5))}", f"bh{bucket(math.log2(hyphened + 0.5))}"]


def train_breaks(words: dict[str, int], compounds: dict[str, int], rounds: int = 3, seed: int = 9) -> np.ndarray:
    """Averaged perceptron over line ends: words broken by any mark (right: join) and compounds broken at their hyphen (right: keep it)."""
    rng = random.Random(seed)
    cases = []
    for w in sorted(words):
        if len(w) > 3:
            n = words[w] if rng.random() < 0.8 else 0
            cases.append(([slot(s) for s in break_signs(rng.choice(MARKS + "---"), n, 0, False)], True))
    for c in sorted(compounds):
        a, _, b = c.partition("-")
        if a and b:
            n = compounds[c] if rng.random() < 0.9 else 0
            plain = words.get(a + b, 0)
            cases.append(([slot(s) for s in break_signs("-", plain, n, b[:1].isupper())], n <= plain))
    return averaged(cases, rng, rounds)


# --- lines

LINE_SIGNS, FORMS = 15, 512


def digits_of(cp: np.ndarray) -> np.ndarray:
    return (cp >= 48) & (cp <= 57) | (cp >= 0xFF10) & (cp <= 0xFF19)



def line_signs(cp: np.ndarray, off: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, held: np.ndarray, edge: np.ndarray, other: np.ndarray) -> np.ndarray:
    """[lines, LINE_SIGNS] feature numbers: form of the line, its place on the page, and how often its key recurs, where, and outside of scans."""
    kind, _ = classes()
    n = end - start
    safe = np.minimum(start, max(len(cp) - 1, 0))
    last = cp[np.maximum(np.minimum(end, len(cp)) - 1, 0)]
    digit = digits_of(cp)
    letters = np.concatenate([[0], np.cumsum((kind[cp] > 0) & ~digit)])
    digits = np.concatenate([[0], np.cumsum(digit)])
    low = np.concatenate([[0], np.cumsum((cp >= 97) & (cp <= 122))])
    first_line = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
    last_line = np.r_[row[1:] != row[:-1], True] if len(row) else np.zeros(0, bool)
    alone = first_line & last_line
    a, d, l = letters[end] - letters[start], digits[end] - digits[start], low[end] - low[start]
    stop = np.isin(last, np.array([ord(c) for c in ".!?。！？,;:，；：、）)”’"], np.uint32))
    number = (d > 0) & (a <= 7) & (n <= 20) & (d + a <= 12)
    place = np.where(alone, 3, np.where(first_line, 0, np.where(last_line, 1, 2)))
    starts_low = (cp[safe] >= 97) & (cp[safe] <= 122)
    ends_digit = digits_of(last)
    capital = (l == 0) & (a > 5)
    wide = cp[safe] >= 0x2E80
    log = lambda x: np.minimum(np.log2(x + 1).astype(np.int64), 6)
    share = np.where(held > 0, np.minimum((edge * 4) // np.maximum(held, 1), 4), 5)
    size = np.minimum(n // 8, 8)
    # the form of a short line with digits: its characters, each number as one sign
    first_digit = digit & ~np.r_[False, digit[:-1]]
    kept = ~digit | first_digit
    count = np.concatenate([[0], np.cumsum(kept)])
    form = P.spans(P.prefix(np.where(digit, np.uint32(48), cp)[kept]), count[start], count[end]) % np.uint64(FORMS)
    form = np.where((d > 0) & (n <= 20), 256 + form.astype(np.int64), 255)
    out = [form, place, 8 + stop, 16 + number * 4 + place, 32 + log(held), 40 + np.minimum(log(other), 3), 48 + share, 56 + size, 72 + starts_low, 80 + ends_digit * 2 + stop, 88 + capital, 96 + (held > 2) * 8 + (other > 0) * 4 + (share > 1) * 2 + stop, 128 + wide * 16 + (d == n) * 8 + (d > 0) * 4 + (a == 0) * 2 + stop,
        160 + (held > 2) * 16 + number * 8 + stop * 4 + ends_digit * 2 + starts_low, 192 + np.minimum(size, 7) * 4 + (held > 2) * 2 + stop]
    return np.stack(out, 1)


def line_keys(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal for lines with the same letters in the same order, whatever case, digits, blanks and marks."""
    kind, low = classes()
    keep = (kind[cp] > 0) & ~digits_of(cp)
    count = np.concatenate([[0], np.cumsum(keep)])
    return P.spans(P.prefix(low[cp[keep]]), count[start], count[end])


def lines(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the lines that are not blank, without blanks at their ends."""
    if not len(cp):
        return (np.zeros(0, np.int64),) * 3
    brk = np.flatnonzero(cp == 10)
    start = np.unique(np.r_[off[:-1][np.diff(off) > 0], brk + 1])
    start = start[start < len(cp)]
    nxt = np.searchsorted(brk, start)
    end = np.where(nxt < len(brk), np.r_[brk, len(cp)][nxt], len(cp))
    row = np.searchsorted(off, start, "right") - 1
    end = np.minimum(end, off[row + 1])
    blank = (cp == 32) | (cp == 9) | (cp == 13)
    text = np.flatnonzero(~blank & (cp != 10))
    if not len(text):
        return (np.zeros(0, np.int64),) * 3
    a, b = np.searchsorted(text, start), np.searchsorted(text, end)
    some = b > a
    return text[a[some]], text[b[some] - 1] + 1, row[some]


TITLES = ("Annual Report", "Monthly Digest", "Staff Handbook", "Minutes of the Board", "Chapter Two", "Jahresbericht", "Rapport annuel", "年度報告", "會議手冊", "Technical Notes", "Site Survey", "Proceedings")
NUMBERS = ("{}", "- {} -", "p. {}", "Page {} of {}", "[{}]", "{}/{}", "第 {} 頁", "第{}頁／共{}頁", "S. {}")


def train_lines(texts: list[str], rounds: int = 4, seed: int = 5) -> np.ndarray:
    """Averaged perceptron over lines of pages made from clean texts, wrapped, with headers, footers and page numbers put in."""
    rng = random.Random(seed)
    signs_, right = [], []
    for text in texts:
        width = rng.randint(30, 90)
        body = []
        for para in text.split("\n"):
            step = width // 2 if para[:1] > "⺀" else width
            while len(para) > step:
                at = para.rfind(" ", 1, step)
                at = at if at > 0 else step
                body.append(para[:at])
                para = para[at:].strip()
            if para:
                body.append(para)
        page = [(x, False) for x in body]
        recurs = []
        for where in (0, len(page), rng.randint(0, len(page))):
            if rng.random() < 0.35:
                line = rng.choice(NUMBERS).replace("{}", str(rng.choice((rng.randint(1, 99), rng.randint(1, 400)))), 1).replace("{}", "99")
                if rng.random() < 0.5:
                    line = rng.choice(TITLES) + rng.choice(("", "", f", No. {rng.randint(1, 40)}", f" {rng.randint(1, 99)}", f"   {rng.randint(1, 99)}", f", No. 3   {rng.randint(1, 99)}"))
                    line = line.upper() if rng.random() < 0.3 else line
                page.insert(where, (line, True))
        text = "\n".join(x for x, _ in page)
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        off = np.array([0, len(cp)])
        s, e, row = lines(cp, off)
        label = [bool(t) for x, t in page if x.strip()]
        if len(label) != len(s):
            continue
        # titles recur, mostly at an edge; of body lines only some do, short ones most, and those stand elsewhere too
        recurs = np.array([(rng.choice((4, 12, 40, 200)) if sum(c.isalpha() for c in text[s_:e_]) > 7 else rng.choice((0, 0, 4, 40, 200))) if t else rng.choice((0, 0, 0, 4, 12, 40)) if e_ - s_ < 24 else rng.choice((0, 0, 0, 0, 0, 0, 4)) for t, s_, e_ in zip(label, s, e)])
        edge = np.array([int(r * (rng.uniform(0.4, 1) if t else rng.random())) for r, t in zip(recurs, label)])
        # lines without letters share one key, which stands everywhere
        bare = [t and not any(c.isalpha() for c in text[s_:e_]) for t, s_, e_ in zip(label, s, e)]
        often = rng.choice((0, 0, 3, 200))
        recurs = np.where(bare, often, recurs)
        edge = np.where(bare, int(often * rng.uniform(0.3, 0.9)), edge)
        other = np.array([(rng.choice((0, 3, 7)) if often else 0) if x else 0 if t or not r else rng.choice((0, 1, 3)) for r, t, x in zip(recurs, label, bare)])
        signs_.append(line_signs(cp, off, s, e, row, recurs, edge, other))
        right += label
    weights, total, step = np.zeros(256 + FORMS), np.zeros(256 + FORMS), 1
    if signs_:
        every, right = np.concatenate(signs_), np.array(right)
        order = np.arange(len(every))
        shuffle = np.random.default_rng(seed)
        for _ in range(rounds):
            shuffle.shuffle(order)
            for i in order.tolist():
                at = every[i]
                score = weights[at].sum()
                if (score > 0) != right[i] or abs(score) < 1:
                    change = 1.0 if right[i] else -1.0
                    weights[at] += change
                    total[at] += change * step
                step += 1
    return weights - total / step


# --- tokens of the corpus


def words_of(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of words: letters and digits but ideographs, and ! or | between them or before them, with at least one letter."""
    kind, _ = classes()
    if not len(cp):
        return (np.zeros(0, np.int64),) * 2
    alnum = kind[cp] == 1
    digit = (cp >= 48) & (cp <= 57)
    letter = alnum & ~digit
    sign = (cp == 33) | (cp == 124)
    before = np.r_[False, letter[:-1]]
    open_ = np.r_[True, (cp[:-1] == 32) | (cp[:-1] == 10)]
    after = np.r_[letter[1:], False]
    part = alnum | sign & after & (before | open_)
    edge = np.zeros(len(cp) + 1, bool)
    edge[off] = True
    edge[1:-1] |= part[1:] != part[:-1]
    edge[[0, -1]] = True
    at = np.flatnonzero(edge)
    keep = part[at[:-1]]
    s, e = at[:-1][keep], at[1:][keep]
    count = np.concatenate([[0], np.cumsum(letter)])
    some = count[e] > count[s]
    # parts of words beside a lost character, a frame sign or a symbol of the upper half of Latin-1 come from a wrong decoding, not from a scan
    odd = np.r_[(cp == 0xFFFD) | (cp >= 0x2500) & (cp <= 0x259F) | np.isin(cp, np.frombuffer("¢£¤¥¦¨©®¯°±²³´µ¶¸¹".encode("utf-32-le"), np.uint32)), False]
    some &= ~odd[s - 1] & ~odd[e]
    return s[some], e[some]


def trigrams_of(cp: np.ndarray, off: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Starts of three ideographs or marks inside a row, the middle one among the centres."""
    row = P.rows_of(off)
    i = np.flatnonzero(centres[cp[1:-1]]) if len(cp) > 2 else np.zeros(0, np.int64)
    i = i[(row[i] == row[i + 2])]
    return i[(cp[i] >= 0x2E80) & (cp[i + 2] >= 0x2E80)]


def centre_table() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    for c in {*IDEOGRAPHS, *"".join(IDEOGRAPHS.values())}:
        out[ord(c)] = True
    return out


def breaks_of(cp: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Numbers of the words that end in a hyphen mark at a line end and go on in the next line with a letter."""
    kind, _ = classes()
    mark = np.zeros(0x110000, bool)
    mark[[ord(c) for c in MARKS]] = True
    n = len(cp)
    i = np.flatnonzero(e + 2 < n)
    i = i[mark[cp[e[i]]] & (cp[e[i] + 1] == 10)]
    return i[(kind[cp[e[i] + 2]] == 1) & ~((cp[e[i] + 2] >= 48) & (cp[e[i] + 2] <= 57))]


def counted(texts: DataFrame) -> DataFrame:
    """(token, held, other, held_d): counts of words, hyphened words and ideograph trigrams in scans and elsewhere, and over the distinct texts of scans. texts: scan boolean, _text.

    held_d does not depend on how often a scan is stored again.
    """
    centres = centre_table()
    texts = texts.groupBy("scan", "_text").agg(F.count("*").alias("copies"))

    def count(batches):
        sums: dict[str, list[int]] = {}
        for batch in batches:
            scan, copies = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            for a, b, cp, off in P.chunks(batch.column(1)):
                s, e = words_of(cp, off)
                hyphen = np.flatnonzero((s[1:] == e[:-1] + 1) & (cp[np.minimum(e[:-1], max(len(cp) - 1, 0))] == 45)) if len(s) > 1 else np.zeros(0, np.int64)
                tri = trigrams_of(cp, off, centres)
                s, e = np.r_[s, s[hyphen], tri], np.r_[e, e[hyphen + 1] if len(hyphen) else e[:0], tri + 3]
                h = P.spans(P.prefix(cp), s, e)
                row = np.searchsorted(off, s, "right") - 1
                where, times = (scan[a:b][row].astype(np.int64), copies[a:b][row]) if len(s) else (s, s)
                _, first, code = np.unique(h, return_index=True, return_inverse=True)
                held, total, once = (np.bincount(code, v, len(first)).astype(np.int64) for v in (where * times, times, where))
                for x, y, k, n, d in zip(s[first].tolist(), e[first].tolist(), held.tolist(), total.tolist(), once.tolist()):
                    w = cp[x:y].tobytes().decode("utf-32-le")
                    old = sums.setdefault(w, [0, 0, 0])
                    old[0] += k
                    old[1] += n - k
                    old[2] += d
            if len(sums) > 300_000:
                yield _counts(sums)
                sums = {}
        yield _counts(sums)

    return texts.mapInArrow(count, "token string, held long, other long, held_d long").groupBy("token").agg(*(F.sum(c).alias(c) for c in ("held", "other", "held_d")))


def _counts(sums: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *(pa.array([v[i] for v in sums.values()], pa.int64()) for i in range(3))], ["token", "held", "other", "held_d"])


def line_counts(texts: DataFrame) -> DataFrame:
    """(key, held, edge, other): how often lines with this key stand in scans, at the top or bottom there, and elsewhere; only what recurs in scans."""

    def count(batches):
        for batch in batches:
            scan = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, cp, off in P.chunks(batch.column(1)):
                s, e, row = lines(cp, off)
                short = e - s <= 80
                key = line_keys(cp, s, e)
                edge = (np.r_[True, row[1:] != row[:-1]] | np.r_[row[1:] != row[:-1], True]) if len(row) else np.zeros(0, bool)
                where = scan[a:b][row].astype(bool) if len(row) else edge
                key, edge, where = key[short], edge[short], where[short]
                u, code = np.unique(key, return_inverse=True)
                held, at, total = np.bincount(code, where, len(u)), np.bincount(code, where & edge, len(u)), np.bincount(code, minlength=len(u))
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), *(pa.array(x.astype(np.int64)) for x in (held, at, total - held))], ["key", "held", "edge", "other"])

    sums = texts.mapInArrow(count, "key long, held long, edge long, other long").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("held", "edge", "other")))
    return sums.where("held > 2")


def corrections(tokens: DataFrame, weights) -> DataFrame:
    """(token, right): the words and trigrams that the editor changes. weights: broadcast of the editor's for words and for ideographs."""
    spark = tokens.sparkSession
    clean = tokens.where(F.col("other") >= CLEAN).select(F.col("token").alias("right"), F.col("other").alias("target"))
    mask = (1 << MAP_BITS) - 1
    occupied = np.zeros(1 << MAP_BITS, bool)  # at most 2**MAP_BITS buckets, whatever the corpus
    for r in clean.select(F.crc32("right").bitwiseAND(mask).cast("int").alias("b")).distinct().toLocalIterator():
        occupied[r[0]] = True
    shared = spark.sparkContext.broadcast(np.packbits(occupied))

    def propose(batches):
        known = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            out = []
            for word, held, other in zip(*(c.to_pylist() for c in batch.columns)):
                for text, ops in options_of(word).items():
                    if known[zlib.crc32(text.encode()) & mask]:
                        out.append((word, held, other, text, [f"{i},{a},{b}" for i, a, b in ops]))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string())))], ["token", "held", "other", "right", "ops"])

    # words that stand elsewhere as often as in scans are no misrecognitions
    suspects = tokens.where((F.col("held") > 0) & (F.col("other") * 10 <= F.col("held")) & ~F.contains("token", F.lit("-"))).repartition("token")
    suspects = suspects.select("token", F.col("held_d").alias("held"), "other")
    proposed = "token string, held long, other long, right string, ops array<string>"
    listed = suspects.mapInArrow(propose, proposed)

    def shape(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([skeleton(w) for w in batch.column(0).to_pylist()], pa.string())], [*batch.schema.names, "skeleton"])

    def unlisted(batches):
        for batch in batches:
            keep = [i for i, w in enumerate(batch.column(0).to_pylist()) if w[0] < "⺀" and not listable(w)]
            yield batch.take(pa.array(keep, pa.int64()))

    def align(batches):
        for batch in batches:
            found = [operations(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist())]
            keep = pa.array([i for i, x in enumerate(found) if x], pa.int64())
            ops = pa.array([[f"{i},{a},{b}" for i, a, b in x] for x in found if x], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(c.take(keep) for c in batch.columns), ops], [*batch.schema.names, "ops"])

    # words with too many edits to be listed meet the clean words of their skeleton
    many = suspects.mapInArrow(unlisted, "token string, held long, other long").mapInArrow(shape, "token string, held long, other long, skeleton string")
    shapes = clean.select("right").where(~F.contains("right", F.lit("-"))).mapInArrow(shape, "right string, skeleton string")
    met = many.join(shapes, "skeleton").select("token", "held", "other", "right").mapInArrow(align, proposed)
    made = listed.union(met).join(clean, "right")

    def decide(batches):
        w = weights.value
        for batch in batches:
            token, held, other, right, target, ops = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("token", "held", "other", "right", "target", "ops"))
            scores = []
            for t, h, o, n, op in zip(token, held, other, target, ops):
                parsed = tuple((int(x[0]), x[1], x[2]) for x in (s.split(",") for s in op))
                if t[0] < "⺀":
                    scores.append(verdict(w[0], t, parsed, h + o, o, n))
                else:  # of several signs that may be right the most usual one is taken
                    good = w[1][[slot(s) for s in sign_features(parsed[0][1], parsed[0][2], h + o, n)]].sum() > 0
                    scores.append(float(n) if good else -1.0)
            yield pa.RecordBatch.from_arrays([pa.array(token, pa.string()), pa.array(right, pa.string()), pa.array(scores, pa.float64())], ["token", "right", "score"])

    judged = made.mapInArrow(decide, "token string, right string, score double").where("score > 0")
    return judged.groupBy("token").agg(F.max(F.struct("score", "right")).alias("x")).select("token", F.col("x.right").alias("right"))


# --- what a record asks, and what it does with the answers

FIX, LINE, WORD = 0, 1, 2
ANSWERS = "kind int, hash long, token string, right string, held long, edge long, other long"


def broken(cp: np.ndarray, off: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the two words of each break; the second starts two characters after the first one's end."""
    i = breaks_of(cp, s, e)
    row = np.searchsorted(off, s[i], "right") - 1
    j = np.searchsorted(s, e[i] + 2)
    ok = (j < len(s)) & (e[i] + 2 < off[row + 1])
    i, j = i[ok], j[ok]
    ok = s[j] == e[i] + 2
    return i[ok], j[ok]


def questions(cp: np.ndarray, off: np.ndarray, sieve: Sieve, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, kind, hash) a text asks for: words and ideographs that may have an edit, lines that may recur, broken words with and without a hyphen."""
    sums = P.prefix(cp)
    s, e = words_of(cp, off)
    # as they stand, and as they will stand when broken words and lines are joined
    i, j = broken(cp, off, s, e)
    one, two = (s[i], e[i]), (s[j], e[j])
    plain, hyphened = P.joined(sums, one, two), P.joined(sums, one, two, "-")
    wide = cp >= 0x2E80
    kept = np.ones(len(cp), bool)
    kept[1:-1] = ~((cp[1:-1] == 10) & wide[:-2] & wide[2:])
    place = np.flatnonzero(kept)
    tri = trigrams_of(cp[kept], np.searchsorted(place, off), centres)
    at, h = np.r_[s, s[i], place[tri]], np.r_[P.spans(sums, s, e), plain, P.spans(P.prefix(cp[kept]), tri, tri + 3)]
    some = sieve.passes(h)
    at, h, kind = at[some], h[some], np.full(len(some), FIX)
    at, h, kind = np.r_[at, s[i], s[i]], np.r_[h, plain, hyphened], np.r_[kind, np.full(2 * len(i), WORD)]
    ls, le, _ = lines(cp, off)
    key = line_keys(cp, ls, le)
    i = sieve.passes(key)
    at, h, kind = np.r_[at, ls[i]], np.r_[h, key[i]], np.r_[kind, np.full(len(i), LINE)]
    row = np.searchsorted(off, at, "right") - 1
    o = np.lexsort((h, kind, row))
    row, kind, h = row[o], kind[o], h[o]
    new = np.r_[True, (row[1:] != row[:-1]) | (kind[1:] != kind[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
    return row[new], kind[new], h[new]


class Answers:
    """The answers to the records of a batch, found by row, kind and hash."""

    def __init__(self, lists: pa.ListArray):
        at = lists.offsets.to_numpy().astype(np.int64)
        self.rows = pa.RecordBatch.from_struct_array(lists.flatten())
        row = np.repeat(np.arange(len(lists)), np.diff(at))
        kind, h = (self.rows.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        key = self._key(row, kind, h.view(np.uint64))
        self.order = np.argsort(key)
        self.keys = key[self.order]
        self.counts = np.stack([self.rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (4, 5, 6)], 1) if len(h) else np.zeros((0, 3), np.int64)
        self.at = at - at[0]

    @staticmethod
    def _key(row: np.ndarray, kind, h: np.ndarray) -> np.ndarray:
        return P.mix(h ^ P.mix(row * 4 + kind))

    def find(self, row: np.ndarray, kind: int, h: np.ndarray) -> np.ndarray:
        """Number of the answer, -1 where there is none."""
        if not len(self.keys) or not len(h):
            return np.full(len(h), -1, np.int64)
        key = self._key(row, kind, h)
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.order[i], -1)

    def numbers(self, row: np.ndarray, kind: int, h: np.ndarray) -> np.ndarray:
        """(held, edge, other), 0 where there is no answer."""
        i = self.find(row, kind, h)
        return np.where((i >= 0)[:, None], self.counts[np.maximum(i, 0)], 0) if len(self.counts) else np.zeros((len(h), 3), np.int64)

    def words(self, row: int) -> tuple[dict[str, str], dict[str, int]]:
        """The edits, and the counts of broken words, of one record."""
        part = self.rows.slice(self.at[row], self.at[row + 1] - self.at[row]).to_pylist()
        return {x["token"]: x["right"] for x in part if x["kind"] == FIX}, {x["token"]: x["other"] for x in part if x["kind"] == WORD}


class Pages:
    """The trained weights of lines and of line ends, and what is done by them."""

    def __init__(self, line_weights: np.ndarray, break_weights: np.ndarray):
        self.line_weights, self.break_weights, self.centres = line_weights, break_weights, centre_table()

    def furniture(self, cp: np.ndarray, off: np.ndarray, answers: Answers, first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, row, is furniture) of the lines; first: the batch's number of row 0."""
        s, e, row = lines(cp, off)
        count = answers.numbers(row + first, LINE, line_keys(cp, s, e))
        sign = line_signs(cp, off, s, e, row, count[:, 0], count[:, 1], count[:, 2])
        return s, e, row, (self.line_weights[sign].sum(1) > 0) & (e - s <= 80)

    def joins(self, mark: str, plain: int, hyphened: int, capital: bool) -> bool:
        return float(self.break_weights[[slot(s) for s in break_signs(mark, plain, hyphened, capital)]].sum()) > 0

    def affected(self, cp: np.ndarray, off: np.ndarray, answers: Answers, first: int) -> np.ndarray:
        """Rows with a sign of a scanned page."""
        sums = P.prefix(cp)
        s, e = words_of(cp, off)
        tri = trigrams_of(cp, off, self.centres)
        at, h = np.r_[s, tri], np.r_[P.spans(sums, s, e), P.spans(sums, tri, tri + 3)]
        row = np.searchsorted(off, at, "right") - 1
        bad = row[answers.find(row + first, FIX, h) >= 0]
        i, j = broken(cp, off, s, e)
        one, two, row = (s[i], e[i]), (s[j], e[j]), np.searchsorted(off, s[i], "right") - 1
        plain, hyphened = (answers.numbers(row + first, WORD, P.joined(sums, one, two, x))[:, 2] for x in ("", "-"))
        mark, capital = cp[e[i]], (cp[s[j]] >= 65) & (cp[s[j]] <= 90)
        cut_ = np.array([self.joins(chr(m), p, q, c) for m, p, q, c in zip(mark.tolist(), plain.tolist(), hyphened.tolist(), capital.tolist())], bool)
        _, _, lrow, is_ = self.furniture(cp, off, answers, first)
        return np.unique(np.r_[bad, row[cut_] if len(cut_) else row, lrow[is_]])

    def repair(self, text: str, answers: Answers, row: int) -> str:
        """Continuous paragraphs: no furniture, broken words joined, misrecognised ones replaced, wrapped lines joined."""
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        fixes, counts = answers.words(row)
        s, e, _, is_ = self.furniture(cp, np.array([0, len(cp)]), answers, row)
        for a, b in reversed([(a, b) for a, b, x in zip(s.tolist(), e.tolist(), is_.tolist()) if x]):
            tail = re.match(r"[ \t]*\n?", text[b:]).end()
            text = text[:a] + text[b + tail :]

        def join(m: re.Match) -> str:
            gone = self.joins(m[2], counts.get(m[1] + m[3], 0), counts.get(f"{m[1]}-{m[3]}", 0), m[3][:1].isupper())
            return m[1] + ("" if gone else m[2]) + m[3]

        text = re.sub(rf"(\w+)([{MARKS}])\n(\w+)", join, text)
        text = re.sub(r"([⺀-￯])\n(?=[⺀-￯])", r"\1", text)
        text = re.sub(r"(?<!\n)\n(?!\n|[•#|])", " ", text)
        text = re.sub(r"[\w!|]*\w", lambda m: fixes.get(m[0], m[0]), text)
        for c in IDEOGRAPHS:
            if c in text:
                text = re.sub(rf"(?<=(.)){c}(?=(.))", lambda m, c=c: fixes.get(m[1] + c + m[2], "x" + c)[1], text)
        return text.strip()


def hash_of(df: DataFrame, *columns: str) -> DataFrame:
    """df with the hash of its column token."""

    def add_hash(batches):
        for batch in batches:
            parts = [P.spans(P.prefix(cp), off[:-1], off[1:]) for _, _, cp, off in P.chunks(batch.column(0))]
            h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h.view(np.int64))], [*batch.schema.names, "hash"])

    some = df.select("token", *columns)
    return some.mapInArrow(add_hash, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in some.schema) + ", hash long")


def fit(df: DataFrame, text: str, kind: str) -> tuple[DataFrame, Pages]:
    """Train the perceptrons, decide on the suspicious words, and return what records may ask for (ANSWERS) and the weights."""
    spark = df.sparkSession
    rows = spread(df.where(F.col(text).isNotNull()).select(F.coalesce(F.col(kind).isin(*SCANNED), F.lit(False)).alias("scan"), F.col(text).alias("_text")))
    tokens = cut(counted(rows))
    clean = tokens.where(F.col("other") >= CLEAN)
    hyphen, wide = F.contains("token", F.lit("-")), F.col("token").rlike("^[⺀-￿]")
    words, signs_, compounds = ({r[0]: r[1] for r in sampled(clean.where(c).select("token", "other"), TRAIN_WORDS, "token").toLocalIterator()} for c in (~hyphen & ~wide, wide, hyphen & ~wide))
    editor = spark.sparkContext.broadcast((train_words(words), train_signs(signs_)))
    pages = [r[0] for r in sampled(rows.where("not scan").select("_text"), TRAIN_LINES, "_text").toLocalIterator()]
    weights = train_lines([t for t in pages if len(t) > 80])
    zero = F.lit(0).cast("long")
    fixes = hash_of(corrections(tokens, editor), "right").select(F.lit(FIX).alias("kind"), "hash", "token", "right", zero.alias("held"), zero.alias("edge"), zero.alias("other"))
    none = F.lit(None).cast("string")
    keys = line_counts(rows).select(F.lit(LINE).alias("kind"), F.col("key").alias("hash"), none.alias("token"), none.alias("right"), "held", "edge", "other")
    known = hash_of(tokens.where("other > 0 and not substring(token, 1, 1) >= '⺀'"), "other").select(F.lit(WORD).alias("kind"), "hash", "token", none.alias("right"), zero.alias("held"), zero.alias("edge"), "other")
    return cut(fixes.union(keys)).union(known), Pages(weights, train_breaks(words, compounds))


def answered(df: DataFrame, key: str, text: str, kind: str) -> tuple[DataFrame, Pages]:
    """(key, _h, _text, _found): the scanned records, each with the answers to what it asks."""
    table, pages = fit(df, text, kind)
    rows = spread(df.where(F.col(key).isNotNull() & F.col(text).isNotNull() & F.col(kind).isin(*SCANNED)).select(F.col(key).cast("long").alias(key), F.xxhash64(text).alias("_h"), F.col(text).alias("_text")))
    shared = df.sparkSession.sparkContext.broadcast(Sieve(table.where(F.col("kind") != WORD).select("hash")).words)
    centres = pages.centres

    def ask(batches):
        sieve = object.__new__(Sieve)
        sieve.words = shared.value
        for batch in batches:
            for a, _, cp, off in P.chunks(batch.column(2)):
                row, what, h = questions(cp, off, sieve, centres)
                at = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(what.astype(np.int32)), pa.array(h.view(np.int64))], [key, "_h", "kind", "hash"])

    asked = rows.mapInArrow(ask, f"{key} long, _h long, kind int, hash long")
    found = asked.join(table, ["kind", "hash"]).groupBy(key, "_h").agg(F.collect_set(F.struct("kind", "hash", "token", "right", "held", "edge", "other")).alias("_found"))
    empty = F.array().cast(f"array<struct<{', '.join(':'.join(c.split()) for c in ANSWERS.split(', '))}>>")
    return rows.join(found, [key, "_h"], "left").select(key, "_h", "_text", F.coalesce("_found", empty).alias("_found")), pages


def scanned(df: DataFrame, key: str = "segment_row_id", text: str = "content", kind: str = "segment_type") -> DataFrame:
    """(key) of page and image rows that show a broken word, a misrecognised character, a running line or a page number.

    Null and empty texts, null keys and other kinds give no row; rows repeated in full give one row; an empty table gives none.
    """
    rows, pages = answered(df, key, text, kind)
    held = df.sparkSession.sparkContext.broadcast(pages)

    def scan(batches):
        for batch in batches:
            answers = Answers(batch.column(3))
            for a, _, cp, off in P.chunks(batch.column(2)):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(held.value.affected(cp, off, answers, a) + a))], [key])

    return rows.mapInArrow(scan, f"{key} long").distinct()


def repaired(df: DataFrame, key: str = "segment_row_id", text: str = "content", kind: str = "segment_type") -> DataFrame:
    """(key, repaired) of every page and image row, as continuous paragraphs; null texts stay null, rows with a null key stay as
    they are; clean rows only lose their line wraps."""
    rows, pages = answered(df, key, text, kind)
    held = df.sparkSession.sparkContext.broadcast(pages)

    def mend(batches):
        for batch in batches:
            answers = Answers(batch.column(3))
            out = [held.value.repair(t, answers, i) for i, t in enumerate(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [key, "repaired"])

    nulls = df.where(F.col(kind).isin(*SCANNED) & (F.col(key).isNull() | F.col(text).isNull())).select(F.col(key).cast("long"), F.col(text).alias("repaired"))
    return rows.mapInArrow(mend, f"{key} long, repaired string").union(nulls)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(read(spark, sf_dir, "doc_segments"))


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(read(spark, sf_dir, "doc_segments"))


QUERIES = {"p5_found": p5_found, "p5_repaired": p5_repaired}
SQL: dict[str, str] = {}
