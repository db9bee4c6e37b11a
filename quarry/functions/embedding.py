"""Embedders turn texts into vectors; any object with `model`, `dim` and `embed(list of texts)` will do.

The default needs no model: hashed bags of words. Texts are embedded in Arrow
batches on the executors.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    model: str
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashedWords:
    """Word counts in `dim` buckets, by the first 32 bits of each word's md5."""

    def __init__(self, dim: int = 64, remember: int = 200_000):
        self.dim, self.model, self.remember = dim, f"hashed-words-{dim}", remember
        self.buckets: dict[str, int] = {}

    def bucket(self, word: str) -> int:
        found = self.buckets.get(word)
        if found is None:
            found = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dim
            if len(self.buckets) < self.remember:
                self.buckets[word] = found
        return found

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts, strict=True):
            for word, n in Counter(re.findall(r"[a-z0-9]+", text.lower())).items():
                row[self.bucket(word)] += n
        return out


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms == 0, 1, norms)


class TooLong(ValueError):
    """An embedder's refusal of a text that exceeds its context."""


def embed_within(text: str, embedder: Embedder, tries: int = 3) -> np.ndarray:
    """Vector of one text; where it is refused as too long, of its first 70 %, up to `tries` times."""
    for left in range(tries, -1, -1):
        try:
            return embedder.embed([text])[0]
        except TooLong:
            if not left:
                raise
            text = text[: int(len(text) * 0.7)]
    raise AssertionError


def embed_all(texts: list[str], embedder: Embedder) -> np.ndarray:
    """Unit vectors; texts are cut one by one only where the embedder refuses some of them."""
    try:
        vectors = embedder.embed(texts)
    except TooLong:
        vectors = np.array([embed_within(t, embedder) for t in texts]).reshape(len(texts), -1)
    return unit_rows(vectors)


def embed(text: Column, embedder: Embedder, exact: bool = False) -> Column:
    """Unit vectors of a text column, as floats or with `exact` as doubles; null and empty texts give the zero vector of an empty text."""
    kind = np.float64 if exact else np.float32

    def run(texts: pa.Array) -> pa.Array:
        vectors = embed_all([x or "" for x in texts.to_pylist()], embedder).astype(kind)
        return pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), embedder.dim).cast(pa.list_(pa.from_numpy_dtype(kind)))

    return F.arrow_udf(run, "array<double>" if exact else "array<float>").asNondeterministic()(text)


def embed_query(text: str, embedder: Embedder) -> list[float]:
    return embed_all([text], embedder)[0].tolist()
