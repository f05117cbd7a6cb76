"""Script folding: every Traditional character as its Simplified one, one to one, so offsets stay."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Code points whose folding is asked of the JVM's ICU, which Spark ships.
RANGES = ((0x3400, 0x9FFF), (0x20000, 0x2A6DF))
_tables: dict[int, tuple[str, str]] = {}


def table(spark: SparkSession) -> tuple[str, str]:
    """(traditional, simplified) strings of equal length. Characters are folded alone (a separator stops phrase rules); chains are resolved."""
    jvm = spark.sparkContext._jvm
    if id(jvm) not in _tables:
        source = [chr(i) for a, b in RANGES for i in range(a, b + 1)]
        change = jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified")
        done = change.transliterate("\n".join(source)).split("\n")
        pairs = {a: b for a, b in zip(source, done, strict=True) if a != b and len(b) == 1}
        final = {}
        for a, b in pairs.items():
            seen = {a}
            while b in pairs and b not in seen:
                seen.add(b)
                b = pairs[b]
            final[a] = b
        _tables[id(jvm)] = ("".join(final), "".join(final.values()))
    return _tables[id(jvm)]


def fold(column, spark: SparkSession | None = None) -> Column:
    """The folded text as one JVM translate."""
    a, b = table(spark or SparkSession.active())
    return F.translate(F.col(column) if isinstance(column, str) else column, a, b)


def fold_text(text: str, spark: SparkSession | None = None) -> str:
    return text.translate(dict(zip(map(ord, (t := table(spark or SparkSession.active()))[0]), t[1], strict=True)))


def class_pattern(text: str, spark: SparkSession | None = None) -> str:
    """A regular expression for text in which each character stands for all with its folding."""
    import re

    a, b = table(spark or SparkSession.active())
    simple = dict(zip(a, b, strict=True))
    back: dict[str, list[str]] = {}
    for x, y in simple.items():
        back.setdefault(y, []).append(x)
    out = ""
    for c in text:
        y = simple.get(c, c)
        same = sorted({y, *back.get(y, [])})
        out += re.escape(c) if len(same) == 1 else "[" + "".join(same) + "]"
    return out
