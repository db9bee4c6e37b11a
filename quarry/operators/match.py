"""Vectors against vectors: best match and all close pairs, exactly.

The right side goes to the tasks while it is small, in bytes, which is seen
first. Beyond that it is dealt into cells around pivots (see `cells`), cells into
bundles of about `block` vectors, and a left vector goes to the bundles that can
hold what is asked for, by the triangle inequality: a score of the minimum, or
one as good as the best pivot, as pivots are vectors of the right side. Bundles that
no left vector can reach make no task. Blocks grow with the sides, up to `BLOCK`, so
that rows are sent to few of them. Both sides of a task are bounded, and products
are formed some hundred rows at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quarry.functions.embedding import Embedder, embed
from quarry.functions.vector import TILE, best_similarity, matrix_of
from quarry.operators import cells as C

BLOCK = 10_000
#: Of vectors sent to every task, in bytes of doubles: ten thousand of 100 dimensions.
SENT_BYTES = 8_000_000
#: Into more parts than these a side is cut only where its blocks have `BLOCK` rows.
PARTS = 64


def few_vectors(rows: DataFrame, block: int = BLOCK, most_bytes: int = SENT_BYTES) -> np.ndarray | None:
    """The distinct embeddings as rows, if there are at most `block` of them and `most_bytes`; None where there are more."""
    found = rows.where("embedding is not null").select("embedding").distinct().limit(block + 1).toArrow()
    if found.num_rows > block:
        return None
    x = matrix_of(found.column(0).combine_chunks()) if found.num_rows else np.zeros((0, 0))
    return x if x.nbytes <= most_bytes else None


def some_vectors(rows: DataFrame, most: int = BLOCK, most_bytes: int = SENT_BYTES) -> np.ndarray:
    """About an eighth of the embeddings as rows, drawn by their hash, at most `most` of them and `most_bytes`."""
    rows = rows.where("embedding is not null").select("embedding")
    n = rows.count()
    share = int(min(1 / 8, most / max(n, 1)) * (1 << 30))
    found = rows.where(F.pmod(F.xxhash64("embedding", F.lit(7)), F.lit(1 << 30)) < share).distinct().limit(most).toArrow()
    x = matrix_of(found.column(0).combine_chunks()) if found.num_rows else np.zeros((0, 0))
    return x[: most_bytes // max(1, x[:1].nbytes)]


# ---- bundles


def room(n: int, block: int) -> int:
    """Rows of a block of a side of n: `block`, or more where that would be too many blocks, as each row of one side is sent to every block of the other."""
    return max(block, min(BLOCK, -(-n // PARTS)))


@dataclass
class Bundles:
    """Cells of the right side in bundles: the bundle of each cell, into how many parts each bundle is cut, and its number of vectors."""

    cells: C.Cells
    of_cell: np.ndarray
    parts: np.ndarray
    n: np.ndarray


def bundle(found: C.Cells, n: np.ndarray, block: int) -> Bundles:
    """Cells that lie near each other share a bundle of `block` vectors; a cell of more is one of its own, in parts."""
    pivots, left, at, chain = found.pivots, set(range(len(n))), 0, []
    while left:
        left.remove(at)
        chain.append(at)
        rest = np.fromiter(left, np.int64, len(left))
        at = int(rest[(pivots[rest] @ pivots[at]).argmax()]) if len(rest) else 0
    of_cell, sizes = np.zeros(len(n), np.int64), [0]
    for c in chain:
        if sizes[-1] and sizes[-1] + n[c] > block:
            sizes.append(0)
        of_cell[c] = len(sizes) - 1
        sizes[-1] += int(n[c])
    sizes = np.array(sizes)
    return Bundles(found, of_cell, np.maximum(1, -(-sizes // block)), sizes)


def deal(right: DataFrame, block: int, most: int = C.MOST) -> Bundles | None:
    """Pivots, extents and bundles of the right side; None if it has no vectors."""
    found = C.choose(right, most)
    if found is None:
        return None
    placed = right.where("embedding is not null").select(C.place(F.col("embedding"), found).alias("at")).select("at.*")
    found, n = C.summed(found, C.extents(placed.groupBy("cell")).collect())  # a row for each cell
    return bundle(found, n, room(int(n.sum()), block))


def reached(vector: Column, bundles: Bundles, min_score: float | None) -> Column:
    """Array of the bundles that can hold a partner of `min_score`; without that, one as good as the best pivot."""
    pivot_rows, kinds = bundles.cells.pivot_rows, len(bundles.parts)
    member = np.zeros((len(bundles.of_cell), kinds))
    member[np.arange(len(bundles.of_cell)), bundles.of_cell] = 1

    def run(vectors: pa.Array) -> pa.Array:
        out = []
        for i in range(0, len(vectors), TILE):
            x = matrix_of(vectors.slice(i, TILE))
            least = (x @ pivot_rows.T).max(1, keepdims=True) - C.SLACK if min_score is None else min_score
            out.append((bundles.cells.bounds(x) >= least) @ member > 0)
        hits = np.vstack(out) if out else np.zeros((0, kinds), bool)
        offsets = np.append(0, np.cumsum(hits.sum(1))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.nonzero(hits)[1].astype(np.int32)))

    return F.arrow_udf(run, "array<int>").asNondeterministic()(vector)


def _number(values: Sequence[int], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), at + 1)


def pairs_of_blocks(left: DataFrame, bundles: Bundles, min_score: float | None, block: int) -> tuple[np.ndarray, int, int]:
    """(into how many parts the left vectors of each bundle are cut, pairs of blocks that are made, and that there would be without pruning)."""
    counts = left.select(F.explode(reached(F.col("embedding"), bundles, min_score)).alias("bundle")).groupBy("bundle").count().collect()  # a row for each bundle
    m = np.zeros(len(bundles.parts), np.int64)
    for r in counts:
        m[r["bundle"]] = r["count"]
    cut = -(-m // room(int(m.max()), block))
    return cut, int((cut * bundles.parts).sum()), int(-(-left.count() // block) * bundles.parts.sum())


def _meet(left: DataFrame, right: DataFrame, bundles: Bundles, min_score: float | None, block: int, spread: list[str], run, schema: str) -> DataFrame:
    """run(left rows, right rows) -> rows of `schema`, for each pair of blocks that can hold what is asked for. `spread` are the columns that deal out rows within a bundle, on the left and the right."""
    cut, _, _ = pairs_of_blocks(left, bundles, min_score, block)
    salt = [F.xxhash64("embedding", c) if c else F.xxhash64("embedding") for c in spread]
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    mine = left.withColumn("_bundle", F.explode(reached(F.col("embedding"), bundles, min_score)))
    mine = mine.withColumn("_cut", F.pmod(salt[0], F.greatest(_number(cut, F.col("_bundle")), F.lit(1)))).withColumn("_part", every(_number(bundles.parts, F.col("_bundle"))))
    theirs = right.withColumn("_bundle", _number(bundles.of_cell, C.place(F.col("embedding"), bundles.cells)["cell"]))
    theirs = theirs.where(_number(cut, F.col("_bundle")) > 0).withColumn("_part", F.pmod(salt[1], _number(bundles.parts, F.col("_bundle"))))
    theirs = theirs.withColumn("_cut", every(_number(cut, F.col("_bundle"))))
    keys = ["_bundle", "_cut", "_part"]
    columns, nothing = [left.columns, right.columns], to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def each(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return nothing
        return run(a.select(columns[0]).combine_chunks(), b.select([f"_right_{c}" for c in columns[1]]).rename_columns(columns[1]).combine_chunks())

    # names of its own for the right side, as both may come from one table
    theirs = theirs.select(*keys, *[F.col(c).alias(f"_right_{c}") for c in columns[1]])
    typed = [x.withColumns({k: F.col(k).cast("long") for k in keys}) for x in (mine, theirs)]
    return typed[0].groupBy(*keys).cogroup(typed[1].groupBy(*keys)).applyInArrow(each, schema)


# ---- joins


def best_match(left: DataFrame, right: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct `embedding`s of `left` with `similarity`, the largest inner product with any of `right`; none where `right` is empty. Rows without an embedding are left out."""
    left, right = (x.where("embedding is not null").select("embedding").distinct() for x in (left, right))
    vectors = few_vectors(right, block)
    if vectors is not None:
        return left.withColumn("similarity", best_similarity(F.col("embedding"), vectors)) if len(vectors) else left.limit(0).withColumn("similarity", F.lit(0.0))
    return _best(left, right, None, block)


def best_above(left: DataFrame, right: DataFrame, min_score: float, block: int = BLOCK) -> DataFrame:
    """As `best_match`, only for vectors whose best reaches `min_score`, and by cells whatever the size of `right` is."""
    left, right = (x.where("embedding is not null").select("embedding").distinct() for x in (left, right))
    return _best(left, right, min_score, block).where(F.col("similarity") >= min_score)


def _best(left: DataFrame, right: DataFrame, min_score: float | None, block: int) -> DataFrame:
    bundles = deal(right, block)
    if bundles is None:
        return left.limit(0).withColumn("similarity", F.lit(0.0))

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        kind = pa.schema([("embedding", mine.schema.field("embedding").type), ("similarity", pa.float64())])
        vectors, matrix = mine.column("embedding").combine_chunks(), matrix_of(theirs.column("embedding").combine_chunks()).T
        best = np.concatenate([(matrix_of(vectors.slice(i, TILE)) @ matrix).max(1) for i in range(0, len(vectors), TILE)])
        return pa.Table.from_arrays([vectors, pa.array(best)], schema=kind)

    kind = left.schema["embedding"].dataType.simpleString()
    met = _meet(left, right, bundles, min_score, block, ["", ""], run, f"embedding {kind}, similarity double")
    return met.groupBy("embedding").agg(F.max("similarity").alias("similarity"))


def vector_key(vector: Column) -> Column:
    """128 bits that stand for a vector where rows meet by it."""
    return F.struct(F.xxhash64(F.lit(17), vector).alias("a"), F.xxhash64(F.lit(29), vector).alias("b"))


def close_pairs(left: DataFrame, right: DataFrame, min_score: float, block: int = 4096) -> DataFrame:
    """left (doc_id, embedding), right (item_id, embedding) -> item_id, doc_id, score of each pair that reaches `min_score`. For a stated query set on the right."""
    left, right = left.select("doc_id", "embedding").where("embedding is not null"), right.select("item_id", "embedding").where("embedding is not null")
    asked = right.limit(block + 1).toArrow().combine_chunks()
    n = asked.num_rows
    items = asked.column("item_id").combine_chunks()
    matrix = matrix_of(asked.column("embedding").combine_chunks()).T if n else np.zeros((0, 0))
    if n > block or matrix.nbytes > SENT_BYTES:
        return close_pairs_by_cells(left, right, min_score, block)

    def scan(batches):
        for batch in batches if n else ():
            yield from _close(batch.column(0), batch.column(1), items, matrix, min_score)

    return left.mapInArrow(scan, _close_schema(left, right))


def close_pairs_by_cells(left: DataFrame, right: DataFrame, min_score: float, block: int = 4096) -> DataFrame:
    """As `close_pairs`, for a right side of any size."""
    left, right = left.select("doc_id", "embedding").where("embedding is not null"), right.select("item_id", "embedding").where("embedding is not null")
    schema, bundles = _close_schema(left, right), deal(right, block)
    if bundles is None:
        return left.sparkSession.createDataFrame([], schema)

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        ids, vectors, items = mine.column("doc_id").combine_chunks(), mine.column("embedding").combine_chunks(), theirs.column("item_id").combine_chunks()
        kind = pa.schema([("item_id", items.type), ("doc_id", ids.type), ("score", pa.float64())])
        return pa.Table.from_batches(_close(ids, vectors, items, matrix_of(theirs.column("embedding").combine_chunks()).T, min_score), kind)

    return _meet(left, right, bundles, min_score, block, ["doc_id", "item_id"], run, schema)


def _close_schema(left: DataFrame, right: DataFrame) -> str:
    kinds = {c: x.schema[c].dataType.simpleString() for x, c in ((left, "doc_id"), (right, "item_id"))}
    return f"item_id {kinds['item_id']}, doc_id {kinds['doc_id']}, score double"


def _close(ids: pa.Array, vectors: pa.Array, items: pa.Array, matrix: np.ndarray, min_score: float):
    for i in range(0, len(vectors), TILE):
        scores = matrix_of(vectors.slice(i, TILE)) @ matrix
        row, item = np.nonzero(scores >= min_score)
        yield pa.RecordBatch.from_arrays([items.take(pa.array(item)), ids.take(pa.array(row + i)), pa.array(scores[row, item])], names=["item_id", "doc_id", "score"])


def search_texts(texts: DataFrame, queries: DataFrame, min_score: float, embedder: Embedder, block: int = 4096) -> DataFrame:
    """texts (doc_id, text), queries (item_id, text) -> item_id, doc_id, score of each pair that reaches `min_score`; each text is embedded once for all of a block of queries."""
    left = texts.select("doc_id", embed(F.col("text"), embedder, exact=True).alias("embedding"))
    right = queries.select("item_id", embed(F.col("text"), embedder, exact=True).alias("embedding"))
    return close_pairs(left, right, min_score, block)
