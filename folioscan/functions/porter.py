"""The Porter stemmer (M. F. Porter, 'An algorithm for suffix stripping', Program 14, 1980), for ASCII words; other words are their own stems."""

from __future__ import annotations

from functools import lru_cache

# Suffix rules of the published steps, (suffix, replacement).
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
VOWELS = "aeiou"


def _pattern(word: str) -> str:
    """v or c for each letter; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in VOWELS or c == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return _pattern(stem).count("vc")


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return len(word) > 2 and _pattern(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _first(word: str, rules, least: int) -> str:
    """The rule with the longest fitting suffix decides, whether its condition holds or not."""
    fit = max((r for r in rules if word.endswith(r[0])), key=lambda r: len(r[0]), default=None)
    if fit is None:
        return word
    stem = word[: len(word) - len(fit[0])]
    return stem + fit[1] if _measure(stem) > least else word


@lru_cache(65536)
def stem(word: str) -> str:
    word = word.lower()
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = ""
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and "v" in _pattern(word[: -len(end)]):
                cut = word[: -len(end)]
                break
    if cut:
        word = cut
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _pattern(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and "v" in _pattern(word[:-1]):
        word = word[:-1] + "i"
    word = _first(word, STEP2, 0)
    word = _first(word, STEP3, 0)
    fit = max((s for s in STEP4 if word.endswith(s)), key=len, default=None)
    if fit:
        base = word[: len(word) - len(fit)]
        if _measure(base) > 1 and (fit != "ion" or base[-1:] in ("s", "t")):
            word = base
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or _measure(base) == 1 and not _short(base):
            word = base
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


#: Endings tried to write out the words of one stem where the corpus vocabulary is not at hand.
ENDINGS = ("", "s", "es", "ed", "d", "e", "ing", "er", "ers", "or", "ors", "ation", "ations", "ion", "ions", "ment", "ments", "able", "ive", "al", "ally", "ly", "ness", "y", "ies", "ied", "ity", "ance", "ence", "ate", "ates", "ated", "ating", "ism", "ist", "ize", "ized")


def family(word: str) -> list[str]:
    """Words with the stem of word that ENDINGS can make from the word or its stem."""
    root = stem(word)
    bases = {word.lower(), root, root + root[-1:], root[:-1] + "y" if root.endswith("i") else root}
    return sorted({b + e for b in bases for e in ENDINGS if stem(b + e) == root} | {word.lower()})
