"""Embedding and reranking models as arguments: anything with `encode`; what ships is a deterministic hashing embedder."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Embedder(Protocol):
    """A model: `name` tells models apart, `encode` gives one row of numbers a text."""

    name: str
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed counts of words and word pairs in `dim` hash buckets, as unit vectors; an empty text is the zero vector."""

    def __init__(self, dim: int = 768):
        self.name, self.dim = f"hashing-{dim}", dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, t in zip(out, texts, strict=True):
            w = re.findall(r"\w+", t.lower())
            for token in [*w, *map(" ".join, zip(w, w[1:], strict=False))]:
                h = crc32(token.encode())
                row[h % self.dim] += 1.0 if h >> 31 else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)


#: Models already loaded in this worker, by name: another name never gets an earlier model.
_LOADED: dict[str, Embedder] = {}


def loaded(make: Callable[[], Embedder], name: str) -> Embedder:
    if name not in _LOADED:
        _LOADED[name] = make()
    return _LOADED[name]


def with_prefix(text: Column, role: str, model: str) -> Column:
    """`query: ` or `passage: ` before the text for models that were trained so (e5), else the text."""
    if role not in ("query", "passage"):
        raise ValueError(role)
    return F.concat(F.lit(f"{role}: "), text) if "e5" in model.lower() else text


def embed(df: DataFrame, keys: list[str], text: str, make: Callable[[], Embedder] = HashingEmbedder, name: str = "hashing-768", role: str = "passage", batch: int = 32) -> DataFrame:
    """Columns `keys`, embedding (array<float>) and embedding_model of every row; null for a null text.

    The model is loaded once a worker and called with `batch` texts. Filter and anti-join before: every row costs a call.
    """
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("embedding", T.ArrayType(T.FloatType(), False)), T.StructField("embedding_model", T.StringType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(make, name)
        for b in it:
            texts = b.column(b.num_columns - 1)
            for at in range(0, b.num_rows, batch):
                part = texts.slice(at, batch).to_pylist()
                known = [i for i, t in enumerate(part) if t is not None]
                vectors: list[np.ndarray | None] = [None] * len(part)
                for i, v in zip(known, model.encode([part[i] for i in known]) if known else [], strict=True):
                    vectors[i] = v
                kind = pa.list_(pa.field("element", pa.float32(), nullable=False))
                yield pa.RecordBatch.from_arrays([*(c.slice(at, batch) for c in b.columns[:-1]), pa.array(vectors, kind), pa.array([name if v is not None else None for v in vectors])], schema=pa.schema([*(b.schema.field(i) for i in range(b.num_columns - 1)), pa.field("embedding", kind), pa.field("embedding_model", pa.string())]))

    return df.select(*keys, with_prefix(F.col(text), role, name).alias("_text")).mapInArrow(run, schema)
