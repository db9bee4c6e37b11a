"""`top_k(TABLE(SELECT * FROM chunks) PARTITION BY (corpus), 'text', 5)`: retrieval as a table function over any table that has vectors.

The function is asked for its schema by `analyze`, so it takes whatever columns the
table has and gives them back, without the vectors, with `score` and `rank`. It scores the rows
of a partition some thousand at a time and holds the best k of them, no more. Spark brings the
rows of a partition together in one task; of a large corpus the best are taken of
parts of it first, by a second call inside (see `top_k_statement`).
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

VECTOR = "embedding"
LEFT_OUT = (VECTOR, "score", "rank")
BATCH = 2048


def register_top_k(spark: SparkSession, name: str, vector: Callable[[str], Sequence[float]], ties: str = "chunk_index") -> None:
    """Table function `name(TABLE(t) PARTITION BY ..., text, k)`. `vector` gives a text's unit vector; of equal scores the smaller `ties` column comes first."""

    class TopK:
        def __init__(self):
            self.held: list[tuple] = []  # (vector, row without it) not yet scored
            self.best: list[tuple] = []  # (-score, tie, row, score), the k best so far
            self.query, self.k = np.zeros(0), 0

        @staticmethod
        def analyze(rows: AnalyzeArgument, text: AnalyzeArgument, k: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable or VECTOR not in rows.dataType.names:
                raise ValueError(f"the first argument must be a table with a column {VECTOR}")
            if not isinstance(text.value, str) or not isinstance(k.value, int) or k.value < 1:
                raise ValueError("the second argument must be a text, the third a number of rows")
            kept = [f for f in rows.dataType.fields if f.name not in LEFT_OUT]
            return AnalyzeResult(StructType([*kept, StructField("score", DoubleType()), StructField("rank", IntegerType())]))

        def eval(self, row: Row, text: str, k: int):
            if not self.k:
                self.k, self.query = k, np.array(vector(text), np.float64)
            found = row[VECTOR]
            if found is not None and len(found) == len(self.query):
                names = row.__fields__
                self.held.append((found, tuple(v for n, v in zip(names, row, strict=True) if n not in LEFT_OUT), row[ties] if ties in names else 0))
                if len(self.held) >= BATCH:
                    self.fold()

        def fold(self):
            scores = (np.array([h[0] for h in self.held], np.float64) @ self.query).tolist()
            found = [(-s, tie is None, tie, i, row) for i, (s, (_, row, tie)) in enumerate(zip(scores, self.held, strict=True))]
            self.best = heapq.nsmallest(self.k, [*self.best, *found], key=lambda x: x[:2] if x[1] else x[:3])
            self.held = []

        def terminate(self):
            if self.held:
                self.fold()
            for rank, (score, *_, row) in enumerate(self.best, 1):
                yield (*row, -score, rank)

    spark.udtf.register(name, udtf(TopK, useArrow=True))


def top_k_statement(name: str, table: str, text: str, k: int, by: str = "corpus", parts: int = 16) -> str:
    """SQL for the k best rows of each value of `by`: of `parts` parts of it first, so a value of any number of rows is spread over tasks."""
    said = "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
    few = f"SELECT * EXCEPT (rank) FROM {name}(TABLE(SELECT *, {VECTOR} AS _kept, pmod(xxhash64({VECTOR}), {parts}) AS _part FROM {table}) PARTITION BY ({by}, _part), {said}, {k})"
    return f"SELECT * EXCEPT (_kept, _part) FROM {name}(TABLE(SELECT *, _kept AS {VECTOR} FROM ({few})) PARTITION BY ({by}), {said}, {k})"
