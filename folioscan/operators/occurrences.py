"""Occurrences: where the positive terms of a query stand, merged where they overlap."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.porter import stem
from ..plans.querylang import QueryError

SPANS = "array<struct<start:int,end:int,terms:array<string>>>"


def literal_positions(column, term: str) -> Column:
    """0-based starts of a literal that cannot overlap itself, without regard to case, all in the JVM: one running sum over the pieces between the hits."""
    text = F.lower(F.col(column) if isinstance(column, str) else column)
    pieces = F.split(text, F.lit("(?s)\\Q" + term.lower() + "\\E"), F.lit(-1))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    step = lambda a, x: F.struct((a["at"] + F.length(x) + len(term)).alias("at"), F.array_append(a["starts"], a["at"] + F.length(x)).alias("starts"))
    # what follows the last hit is no hit
    return F.aggregate(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), none, step, lambda a: a["starts"])


def merge_islands(df: DataFrame, key: list[str]) -> DataFrame:
    """(key, start, end): overlapping intervals of a key as one; adjacent ones stay apart; equal empty ones are one."""
    by = W.partitionBy(*key).orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1))
    same = (F.col("start") == F.col("end")) & (F.lag("start").over(by) == F.col("start")) & (F.lag("end").over(by) == F.col("end"))
    fresh = F.when(before.isNull() | ((F.col("start") >= before) & ~F.coalesce(same, F.lit(False))), 1).otherwise(0)
    island = df.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy(*key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def streams(text: str, terms: list[dict], deadline: float | None = None) -> Iterator[tuple[int, int, str]]:
    """All (start, end, term); literals may overlap themselves, stems and phrases do not. terms: kind literal, stem, phrase or regex; term; pattern."""
    for t in terms:
        if t["kind"] == "stem":
            want = stem(t["term"])
            for m in re.finditer(r"(?<![A-Za-z])[A-Za-z]+", text):
                if stem(m[0]) == want:
                    yield m.start(), m.end(), t["term"]
        elif t["kind"] == "phrase":
            words = [stem(w) for w in t["term"].split()]
            shape = re.compile(r"\W+".join([r"([A-Za-z]+)"] * len(words)))
            at = 0
            while m := shape.search(text, at):
                if all(stem(g) == w for g, w in zip(m.groups(), words, strict=True)) and (m.start() == 0 or not (text[m.start() - 1].isascii() and text[m.start() - 1].isalpha())):
                    yield m.start(), m.end(), t["term"]
                    at = m.end()
                else:
                    at = m.end(1)
        elif t["kind"] == "regex":
            import regex

            try:
                left = None if deadline is None else max(0.001, deadline - time.monotonic())
                for m in regex.finditer(t["pattern"], text, flags=t.get("flags", 0), timeout=left):
                    yield m.start(), m.end(), t["term"]
            except TimeoutError:
                raise QueryError("regex_timeout") from None
        else:
            for m in re.finditer(f"(?=({t['pattern']}))", text, t.get("flags", 0)):
                yield m.start(1), m.end(1), t["term"]


def merged(text: str, terms: list[dict], deadline: float | None = None) -> list[tuple[int, int, list[str]]]:
    """Overlapping hits as one with all of their terms; adjacent hits stay apart; equal empty hits are one."""
    out: list[list] = []
    for start, end, term in sorted(streams(text, terms, deadline)):
        if out and (start < out[-1][1] or (start, end) == (out[-1][0], out[-1][1])):
            out[-1][1] = max(out[-1][1], end)
            if term not in out[-1][2]:
                out[-1][2].append(term)
        else:
            out.append([start, end, [term]])
    return [(a, b, c) for a, b, c in out]


def occurrences(df: DataFrame, terms: list[dict], positive: str | None = None, seconds: float | None = None) -> DataFrame:
    """df with spans: the merged hits in content. positive: a column with the terms that count in a row; seconds: budget of a task for regular expressions.

    A null content has no hits. Offsets are code points.
    """
    columns = df.columns

    def find(batches):
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("content")).to_pylist()
            some = batch.column(batch.schema.get_field_index(positive)).to_pylist() if positive else [None] * len(text)
            end = None if seconds is None else time.monotonic() + seconds
            spans = [[] if t is None else [{"start": a, "end": b, "terms": c} for a, b, c in merged(t, terms if p is None else [x for x in terms if x["term"] in p], end)] for t, p in zip(text, some, strict=True)]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("terms", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], [*columns, "spans"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(find, f"{fields}, spans {SPANS}")


def with_sources(df: DataFrame) -> DataFrame:
    """spans exploded, each with its ordinal in the document and the sources it touches; several sources are a range."""
    by = W.partitionBy("doc_id").orderBy("segment_row_id", "start", "end")
    rows = df.select("doc_id", "segment_row_id", "segment_type", "segment_id", "sources", F.explode("spans").alias("s")).select("*", "s.start", "s.end", "s.terms").drop("s")
    touching = F.filter(F.coalesce("sources", F.array().cast(df.schema["sources"].dataType)), lambda x: (x["start"] < F.greatest(F.col("end"), F.col("start") + 1)) & (x["end"] > F.col("start")))
    rows = rows.withColumn("_t", touching)
    kind = F.when(F.size("_t") > 1, F.lit("range")).otherwise(F.coalesce(F.try_element_at("_t", F.lit(1))["kind"], F.col("segment_type")))
    place = F.when(F.size("_t") > 0, F.array_join(F.transform("_t", lambda x: x["location"]), " → ")).otherwise(F.col("segment_id"))
    return rows.withColumn("ordinal", F.row_number().over(by)).withColumn("source_kind", kind).withColumn("location", place).drop("_t", "sources")
