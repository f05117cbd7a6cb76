"""Vector scores: cosine against one query vector, top-k, threshold, reuse after a rebuild, and a hashing encoder."""

from __future__ import annotations

import hashlib
import json
import math
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP = 1000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(vector: str, query: list[float]) -> Column:
    """0 for a zero vector; a zero query is an error; null for a null vector or one of another length."""
    norm = math.sqrt(sum(x * x for x in query))
    if not norm:
        raise ValueError("the query vector is zero")
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.col(vector)
    own = F.sqrt(dot(v, v))
    return F.when(F.size(v) == len(query), F.when(own == 0, 0.0).otherwise(dot(v, q) / (own * norm)))


def nearest(df: DataFrame, key: str, vector: str, query: list[float], k: int = TOP, least: float | None = None) -> DataFrame:
    """(key, score) of the k best, ties by the smaller key; scores that are NaN or null take no part."""
    scored = df.select(key, cosine(vector, query).alias("score")).where(F.col("score").isNotNull() & ~F.isnan("score"))
    if least is not None:
        scored = scored.where(F.col("score") >= least)
    return scored.orderBy(F.desc("score"), key).limit(k)


def reuse(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """(segment_row_id, reused): which segments keep their vectors and which must be encoded."""
    have = chunks.where("segment_row_id is not null").select("segment_row_id").distinct().withColumn("reused", F.lit(True))
    return segments.select("segment_row_id").distinct().join(have, "segment_row_id", "left").select("segment_row_id", F.coalesce("reused", F.lit(False)).alias("reused"))


class HashEncoder:
    """A deterministic stand-in for a model: hashed character trigrams, unit length. It has no semantic quality."""

    dimensions, max_tokens, model_id = 64, 512, "hash-encoder-64"

    def encode(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dimensions
            for i in range(max(1, len(t) - 2)):
                h = int.from_bytes(hashlib.blake2b(t[i : i + 3].encode(), digest_size=8).digest(), "big")
                v[h % self.dimensions] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out

    def token_count(self, text: str) -> int:
        return len(text.split())


def encode(df: DataFrame, key: str, text: str, encoder, prefix: str = "passage: ", batch: int = 16) -> DataFrame:
    """(key, vector): the encoder is shipped once and called with batches."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            texts = [prefix + (t or "") for t in b.column(1).to_pylist()]
            done = [v for i in range(0, len(texts), batch) for v in encoder.encode(texts[i : i + batch])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.list_(pa.float32()))], [key, "vector"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, vector array<float>")


def model_id(folder: str) -> str:
    """The identity of a model folder: where it is, and the sizes and times of its files."""
    root = os.path.realpath(folder)
    files = sorted(os.path.join(d, f) for d, _, names in os.walk(root) for f in names)
    rows = [(os.path.relpath(f, root), (s := os.stat(f)).st_size, s.st_mtime_ns) for f in files]
    return hashlib.sha256(json.dumps([root, rows]).encode()).hexdigest()


class OnnxEncoder:
    """A text encoder from a folder with model.onnx and tokenizer.json, the same on every executor; means of the last states, of unit length.

    The session is made where it is first used, so the object travels as a path.
    """

    max_tokens = 512

    def __init__(self, folder: str):
        if not all(os.path.isfile(os.path.join(folder, f)) for f in ("model.onnx", "tokenizer.json")):
            raise ValueError("an encoder's folder holds model.onnx and tokenizer.json")
        self.folder, self.model_id, self._made = folder, model_id(folder), None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": None}

    def _parts(self):
        if self._made is None:
            import onnxruntime
            from tokenizers import Tokenizer

            self._made = (Tokenizer.from_file(os.path.join(self.folder, "tokenizer.json")), onnxruntime.InferenceSession(os.path.join(self.folder, "model.onnx")))
        return self._made

    def token_count(self, text: str) -> int:
        return len(self._parts()[0].encode(text).ids)

    def encode(self, texts: list[str]) -> list[list[float]]:
        import numpy as np

        tokenizer, model = self._parts()
        ids = [tokenizer.encode(t).ids[: self.max_tokens] for t in texts]
        wide = max(map(len, ids), default=1)
        mask = np.array([[1] * len(x) + [0] * (wide - len(x)) for x in ids], np.int64)
        given = {"input_ids": np.array([x + [0] * (wide - len(x)) for x in ids], np.int64), "attention_mask": mask, "token_type_ids": np.zeros_like(mask)}
        states = model.run(None, {i.name: given[i.name] for i in model.get_inputs()})[0]
        mean = (states * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)
        return (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)).tolist()
