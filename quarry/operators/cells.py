"""Vectors in cells around pivots, and bounds on what a cell can hold: exact searches that read some cells only.

Of a cell are known the largest angle to its pivot and the smallest and largest
length. By the triangle inequality no vector of it is nearer to a query than the
query's angle to the pivot less the cell's own, so its inner product with the
query is bounded, whatever the lengths are. Cells that cannot reach a minimum
score, or the k-th score so far, are not read. How many this spares depends on
the vectors: much where they lie in groups, next to nothing where they point evenly
into many dimensions; results are the same.

Pivots are vectors of the table itself, at most `most` of them, found on a sample
of 16 for each; they and a summary of each cell are all that the driver holds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from quarry.functions.vector import TILE, matrix_of
from quarry.operators import retrieve

MOST = 512
#: Above what rounding does to a bound.
SLACK = 1e-7
CELL = "struct<cell:int,angle:double,norm:double>"


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def _units(x: np.ndarray) -> np.ndarray:
    size = _lengths(x)[:, None]
    return x / np.where(size == 0, 1, size)


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angles between rows of x and unit pivots; those of a zero vector are right angles."""
    return np.arccos(np.clip(_units(x) @ pivots.T, -1, 1))


@dataclass
class Cells:
    """Unit pivots as rows, and by cell the largest angle and the range of lengths; `pivot_rows` are the vectors that the pivots were."""

    pivot_rows: np.ndarray
    angle: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    @property
    def pivots(self) -> np.ndarray:
        return _units(self.pivot_rows)

    def bounds(self, x: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """For each row of x and each cell, a number that no inner product of the two exceeds. `at` are the angles to the pivots where they are known."""
        nearest = np.cos(np.maximum(0, (angles(x, self.pivots) if at is None else at) - self.angle))
        return _lengths(x)[:, None] * np.where(nearest >= 0, self.high * nearest, self.low * nearest) + SLACK


def choose(rows: DataFrame, most: int = MOST, vector: str = "embedding", rounds: int = 6) -> Cells | None:
    """Pivots for the vectors of a table, about two times the root of their number and `most` at most; None if there are none."""
    rows = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0))
    n = rows.count()
    if not n:
        return None
    k = max(1, min(most, int(2 * n**0.5)))
    share = int(min(1.0, 16 * k / n) * (1 << 30))
    drawn = rows.where(F.pmod(F.xxhash64(vector, F.lit(5)), F.lit(1 << 30)) <= share).select(vector).limit(24 * k).toArrow()
    drawn = drawn if drawn.num_rows else rows.select(vector).limit(k).toArrow()
    x = np.unique(matrix_of(drawn.column(0).combine_chunks()), axis=0)
    units = _units(x)
    centres = units[np.random.default_rng(3).permutation(len(x))[:k]]
    for _ in range(rounds):
        own = (units @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, units)
        centres = np.where(_lengths(sums)[:, None] > 0, _units(sums), centres)
    return Cells(x[np.unique((units @ centres.T).argmax(0))])


def place(vector: Column, cells: Cells) -> Column:
    """Struct of the nearest pivot's cell, the angle to it, and the vector's length; null for a null vector."""
    pivots = cells.pivots

    def run(vectors: pa.Array) -> pa.Array:
        good = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
        cell, angle, norm = np.zeros(len(vectors), np.int32), np.zeros(len(vectors)), np.zeros(len(vectors))
        x = matrix_of(vectors.take(pa.array(good))) if len(good) else np.zeros((0, pivots.shape[1]))
        for i in range(0, len(good), TILE):
            at, some = angles(x[i : i + TILE], pivots), good[i : i + TILE]
            cell[some], angle[some], norm[some] = at.argmin(1), at.min(1), _lengths(x[i : i + TILE])
        mask = np.ones(len(vectors), bool)
        mask[good] = False
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(angle), pa.array(norm)], names=["cell", "angle", "norm"], mask=pa.array(mask))

    return F.arrow_udf(run, CELL).asNondeterministic()(vector)


def extents(placed: GroupedData) -> DataFrame:
    """(cell, angle, low, high, n) of rows (cell, angle, norm) grouped by cell."""
    return placed.agg(F.max("angle").alias("angle"), F.min("norm").alias("low"), F.max("norm").alias("high"), F.count("*").alias("n"))


def summed(cells: Cells, rows: list) -> tuple[Cells, np.ndarray]:
    """`cells` with the extents of rows (cell, angle, low, high, n), and the number of vectors in each; of an empty cell nothing is expected."""
    angle, low, high, n = np.zeros(len(cells.pivot_rows)), np.zeros(len(cells.pivot_rows)), np.zeros(len(cells.pivot_rows)), np.zeros(len(cells.pivot_rows), np.int64)
    for r in rows:
        angle[r["cell"]], low[r["cell"]], high[r["cell"]], n[r["cell"]] = r["angle"], r["low"], r["high"], r["n"]
    return Cells(cells.pivot_rows, angle, low, high), n


class VectorIndex:
    """Chunks stored by corpus and cell.

    <path>/chunks/corpus=<name>/cell=<number>/..., <path>/cells (corpus, cell, angle, low, high, n), <path>/pivots (cell, pivot).
    Chunks without a vector are not in it, as no search finds them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        rows = sorted(spark.read.parquet(f"{self.path}/pivots").collect())
        self.cells = Cells(np.array([r["pivot"] for r in rows], np.float64))

    @classmethod
    def build(cls, chunks: DataFrame, path: str, most: int = MOST) -> VectorIndex:
        """Writes the chunks by corpus and cell; Spark splits large cells over several tasks and files, sorted by the angle to the pivot."""
        spark, path = chunks.sparkSession, path.rstrip("/")
        cells = choose(chunks, most)
        if cells is None:
            raise ValueError("no vectors to index")
        pivots = [(i, p.tolist()) for i, p in enumerate(cells.pivot_rows)]
        spark.createDataFrame(pivots, "cell int, pivot array<double>").write.mode("overwrite").parquet(f"{path}/pivots")
        placed = chunks.where("embedding is not null").withColumn("_at", place(F.col("embedding"), cells)).select("*", "_at.*").drop("_at")
        placed.hint("rebalance", "corpus", "cell").sortWithinPartitions("corpus", "cell", "angle").write.mode("overwrite").partitionBy("corpus", "cell").parquet(f"{path}/chunks")
        index = cls(spark, path)
        extents(index.chunks().groupBy("corpus", "cell")).write.mode("overwrite").parquet(f"{path}/cells")
        return index

    def chunks(self) -> DataFrame:
        stored = self.spark.read.parquet(f"{self.path}/chunks")
        return self.spark.read.schema(_typed(stored)).parquet(f"{self.path}/chunks")

    def reachable(self, query: Sequence[float], corpora: Sequence[str] | None = None) -> list[dict]:
        """corpus, cell, n, bound of each cell of the corpora asked for, the most promising first."""
        found = self.spark.read.parquet(f"{self.path}/cells")
        rows = (found if corpora is None else found.where(F.col("corpus").isin(*corpora))).collect()  # a row for each cell of these corpora
        x = np.array([query], np.float64)
        at = angles(x, self.cells.pivots)
        out = []
        for r in rows:
            own = Cells(self.cells.pivot_rows[[r["cell"]]], np.array([r["angle"]]), np.array([r["low"]]), np.array([r["high"]]))
            out.append({"corpus": r["corpus"], "cell": r["cell"], "n": r["n"], "bound": float(own.bounds(x, at[:, [r["cell"]]])[0, 0])})
        return sorted(out, key=lambda r: -r["bound"])

    def read(self, asked: list[dict]) -> DataFrame:
        """Chunks of these cells; the others' partitions are not read."""
        by_corpus: dict[str, list[int]] = {}
        for r in asked:
            by_corpus.setdefault(r["corpus"], []).append(r["cell"])
        wanted = F.lit(False)
        for corpus, own in by_corpus.items():
            wanted = wanted | ((F.col("corpus") == corpus) & F.col("cell").isin(*own))
        return self.chunks().where(wanted)

    def search(self, query: Sequence[float], min_score: float, corpora: Sequence[str] | None = None) -> DataFrame:
        """As `retrieve.search_rows`, from the cells that can reach `min_score`."""
        asked = [r for r in self.reachable(query, corpora) if r["bound"] >= min_score]
        return retrieve.search_rows(self.read(asked), query, None, min_score)

    def cells_for_top_k(self, query: Sequence[float], k: int, corpora: Sequence[str] | None = None) -> list[dict]:
        """The cells that can hold one of the k best chunks of their corpus: of each corpus the most promising k chunks' cells are scored first, and only cells that can reach the k-th score of these are left."""
        every = self.reachable(query, corpora)
        first, held = [], {}
        for r in every:
            if held.get(r["corpus"], 0) < k:
                held[r["corpus"]] = held.get(r["corpus"], 0) + r["n"]
                first.append(r)
        if len(first) == len(every):
            return every
        scored = retrieve.top_k_per_corpus(retrieve.score_chunks(self.read(first), query), k)
        least = {r["corpus"]: r["least"] for r in scored.where(F.col("rank") == k).select("corpus", F.col("score").alias("least")).collect()}
        return [r for r in every if r["bound"] >= least.get(r["corpus"], -np.inf)]

    def top_k_per_corpus(self, query: Sequence[float], k: int, corpora: Sequence[str] | None = None) -> DataFrame:
        return retrieve.top_k_per_corpus(retrieve.score_chunks(self.read(self.cells_for_top_k(query, k, corpora)), query), k)


def _typed(stored: DataFrame):
    """The schema with corpora as strings, whatever their names look like in folders."""
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    kinds = {"corpus": StringType(), "cell": IntegerType()}
    return StructType([StructField(f.name, kinds.get(f.name, f.dataType)) for f in stored.schema])
