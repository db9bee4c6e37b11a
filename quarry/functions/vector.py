"""Vectors as array columns; sums run in double."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Rows of a matrix product at a time, so that what a task holds is bounded by this and the other side.
TILE = 256


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def _matrix(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the right width as a matrix, and which rows these are."""
    sizes = np.array([-1 if n is None else n for n in pc.list_value_length(vectors).to_pylist()], np.int64)
    good = np.flatnonzero(sizes == width)
    flat = vectors.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(good), width), good


def matrix_of(vectors: pa.Array) -> np.ndarray:
    """Vectors of one width, none null, as rows of a matrix."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def similarities(vector: Column, queries: Sequence[Sequence[float]]) -> Column:
    """Array of the inner products of a vector column with each of some given vectors: all of a query tree by one product for each Arrow batch. Null where the column is null or of another width."""
    matrix = np.array(queries, np.float64).reshape(len(queries), -1).T

    def score(vectors: pa.Array) -> pa.Array:
        rows, good = _matrix(vectors, matrix.shape[0])
        ends = np.zeros(len(vectors), bool)
        ends[good] = True
        offsets = np.append(0, np.cumsum(ends) * matrix.shape[1]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array((rows @ matrix).ravel()), mask=pa.array(~ends))

    return F.arrow_udf(score, "array<double>").asNondeterministic()(vector)


def best_similarity(vector: Column, queries: Sequence[Sequence[float]]) -> Column:
    """Largest inner product of a vector column with any of some given vectors, one matrix product for each Arrow batch.

    Null where the column is null or of another width. Marked non-deterministic,
    so that a filter on the score does not make Spark compute it twice.
    """
    matrix = np.array(queries, np.float64).reshape(len(queries), -1).T

    def score(vectors: pa.Array) -> pa.Array:
        rows, good = _matrix(vectors, matrix.shape[0])
        out = np.full(len(vectors), np.nan)
        for i in range(0, len(good), TILE):
            out[good[i : i + TILE]] = (rows[i : i + TILE] @ matrix).max(1)
        return pa.array(out, mask=np.isnan(out))

    return F.arrow_udf(score, "double").asNondeterministic()(vector)


def similarity(vector: Column, query: Sequence[float]) -> Column:
    return best_similarity(vector, [query])
