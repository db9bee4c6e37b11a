"""Set operators keyed by passage (corpus, location): scores differ between queries, so whole rows never match.

Where a key repeats, the highest score stands; of equal scores that of the first
set, then the smaller chunk index. Word pieces of one long line share a location
and so count as one passage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.vector import best_similarity
from quarry.operators.match import BLOCK, best_above, few_vectors, some_vectors, vector_key
from quarry.schema import KEY


def _best(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row a key: highest score, then lowest `_ord`, then lowest chunk index; a hash aggregate with map-side combine."""
    rest = [c for c in columns if c not in KEY]
    rank = F.struct(F.col("score"), -F.col("_ord"), -F.coalesce(F.col("chunk_index"), F.lit(0)) if "chunk_index" in columns else F.lit(0))
    best = rows.groupBy(*KEY).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
    return best.select(*[F.col(c) if c in KEY else F.col(f"_row.{c}").alias(c) for c in columns])


def dedupe(rows: DataFrame) -> DataFrame:
    return _best(rows.withColumn("_ord", F.lit(0)), rows.columns)


def union(sets: list[DataFrame]) -> DataFrame:
    """All passages of any set: one shuffle for any number of sets."""
    tagged = [s.withColumn("_ord", F.lit(i)) for i, s in enumerate(sets)]
    return _best(reduce(DataFrame.unionByName, tagged), sets[0].columns)


def union_all(sets: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, sets)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of `a` whose passage is not in `b`; repeats inside `a` stay."""
    return a.join(b.select(*KEY), KEY, "left_anti").select(*a.columns)


def semantic_difference(a: DataFrame, b: DataFrame, threshold: float = 0.7, block: int = BLOCK) -> DataFrame:
    """`difference`, less rows whose cosine with any row of `b` is `threshold` or more.

    Both sides carry unit `embedding`s; rows without one stay. The exact
    difference comes first, as it is cheap.
    """
    left, few = difference(a, b), few_vectors(b, block)
    if few is not None:
        near = left.withColumn("_near", best_similarity(F.col("embedding"), few)) if len(few) else left.withColumn("_near", F.lit(None).cast("double"))
        return near.where(F.col("_near").isNull() | (F.col("_near") < threshold)).select(*a.columns)
    return semantic_difference_by_cells(left, b, threshold, block)


def semantic_difference_by_cells(a: DataFrame, b: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Rows of `a` without a row of `b` at `threshold` or nearer, for sides of any size; rows meet by a hash of their vectors.

    One near row is enough to drop a row, so a bounded part of `b` goes to every
    task first; what that leaves meets all of `b`.
    """
    some = some_vectors(b)
    if len(some):
        first = best_similarity(F.col("embedding"), some)
        a = a.withColumn("_near", first).where(F.col("_near").isNull() | (F.col("_near") < threshold)).drop("_near")
    near = best_above(a, b, threshold, block).select(vector_key(F.col("embedding")).alias("_key"))
    return a.withColumn("_key", vector_key(F.col("embedding"))).join(near, "_key", "left_anti").select(*a.columns)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Passages in both sets, each with its row of the higher score (of `a` where equal)."""
    both = dedupe(a).select(*KEY).join(dedupe(b).select(*KEY), KEY)
    return union([a, b]).join(both, KEY, "left_semi").select(*a.columns)


def intersect_all(sets: list[DataFrame]) -> DataFrame:
    """Passages in all sets: one aggregate counts the sets of each passage."""
    columns = sets[0].columns
    tagged = reduce(DataFrame.unionByName, [s.withColumn("_ord", F.lit(i)) for i, s in enumerate(sets)])
    everywhere = tagged.groupBy(*KEY).agg(F.countDistinct("_ord").alias("n")).where(F.col("n") == len(sets)).select(*KEY)
    return _best(tagged, columns).join(everywhere, KEY, "left_semi").select(*columns)


class Leaves:
    """Several sets of one scan, met by passage in one shuffle with map-side combine: which sets have the passage as bits, and each set's best row.

    A set expression is then a condition on the bits with the row that stands for
    it, the best of the sets that take part; nothing is gathered. The rows of one
    set less others, its repeats too, are picked by `rows_of`. Operators that count
    repeated rows need `Passages`.
    """

    WORD = 62

    def __init__(self, tagged: DataFrame, n: int):
        self.columns, self.tagged = [c for c in tagged.columns if c != "_ord"], tagged
        early = -F.coalesce(F.col("chunk_index"), F.lit(0)) if "chunk_index" in self.columns else F.lit(0)
        rest = [c for c in self.columns if c not in [*KEY, "score"]]
        # fields in the order in which rows are preferred: score, first set, first chunk
        row = F.struct("score", (-F.col("_ord")).alias("_first"), early.alias("_early"), *rest)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_ord") % self.WORD)
        self.words = {f"_bits{w}": F.bit_or(F.when(F.floor(F.col("_ord") / self.WORD) == w, bit).otherwise(F.lit(0).cast("long"))) for w in range(-(-n // self.WORD))}
        self.rows = tagged.groupBy(*KEY).agg(*[bits.alias(name) for name, bits in self.words.items()], *[F.max(F.when(F.col("_ord") == i, row)).alias(f"_row{i}") for i in range(n)])

    def of(self, i: int) -> tuple[Column, Column]:
        return F.col(f"_bits{i // self.WORD}").bitwiseAND(F.lit(1 << i % self.WORD)) != 0, F.col(f"_row{i}")

    @staticmethod
    def _best(sets: tuple) -> Column:
        return F.greatest(*[row for _, row in sets]) if len(sets) > 1 else sets[0][1]

    def union(self, *sets: tuple[Column, Column]) -> tuple[Column, Column]:
        return reduce(lambda a, b: a | b, [there for there, _ in sets]), self._best(sets)

    def intersect(self, *sets: tuple[Column, Column]) -> tuple[Column, Column]:
        there = reduce(lambda a, b: a & b, [there for there, _ in sets])
        return there, F.when(there, self._best(sets))

    def difference(self, a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
        return a[0] & ~b[0], F.when(~b[0], a[1])

    def _fields(self, extra: list[str]) -> list[Column]:
        return [F.col(c) if c in [*KEY, *extra] else F.col(f"_row.{c}").alias(c) for c in [*extra, *self.columns]]

    def select(self, chosen: tuple[Column, Column]) -> DataFrame:
        """The result of an expression over sets as rows."""
        return self.rows.where(chosen[0]).select(*KEY, chosen[1].alias("_row")).select(*self._fields([]))

    def rows_of(self, i: int, but: list[tuple[Column, Column]]) -> DataFrame:
        """All rows of set `i` whose passage none of the others has."""
        passage = Window.partitionBy(*KEY)
        known = self.tagged.withColumns({name: bits.over(passage) for name, bits in self.words.items()})
        return known.where((F.col("_ord") == i) & reduce(lambda a, b: a & b, [~there for there, _ in but])).select(*self.columns)

    def select_many(self, chosen: list[tuple[Column, Column]]) -> DataFrame:
        """The results of several expressions, `tree` saying of which each row is."""
        hits = F.filter(F.array(*[F.when(there, F.struct(F.lit(i).alias("tree"), row.alias("row"))) for i, (there, row) in enumerate(chosen)]), lambda x: x.isNotNull())
        out = self.rows.select(*KEY, F.explode(hits).alias("_hit")).select(*KEY, F.col("_hit.tree").alias("tree"), F.col("_hit.row").alias("_row"))
        return out.select(*self._fields(["tree"]))


class Passages:
    """Several sets of one scan, met by passage in one shuffle; set operators are then column expressions.

    `tagged` has the rows of all sets, `_ord` saying of which. Each set is an array
    of its rows of a passage, mostly one or none; the pieces of one long line are
    as many as it has.
    """

    def __init__(self, tagged: DataFrame):
        self.columns = [c for c in tagged.columns if c != "_ord"]
        early = -F.coalesce(F.col("chunk_index"), F.lit(0)) if "chunk_index" in self.columns else F.lit(0)
        rest = [c for c in self.columns if c not in [*KEY, "score"]]
        # fields in the order in which rows are preferred: score, first set, first chunk
        row = F.struct("score", (-F.col("_ord")).alias("_first"), early.alias("_early"), *rest)
        self.rows = tagged.groupBy(*KEY).agg(F.collect_list(row).alias("_rows"))

    def of(self, i: int) -> Column:
        return F.filter("_rows", lambda r: r["_first"] == -i)

    @staticmethod
    def _best(rows: Column) -> Column:
        return F.when(F.size(rows) > 0, F.array(F.array_max(rows))).otherwise(rows)

    def union(self, *sets: Column) -> Column:
        return self._best(F.concat(*sets))

    def intersect(self, *sets: Column) -> Column:
        every = F.lit(True)
        for s in sets:
            every = every & (F.size(s) > 0)
        return F.when(every, self._best(F.concat(*sets))).otherwise(F.slice("_rows", 1, 0))

    def difference(self, a: Column, b: Column) -> Column:
        return F.when(F.size(b) == 0, a).otherwise(F.slice("_rows", 1, 0))

    def union_all(self, *sets: Column) -> Column:
        return F.concat(*sets)

    def difference_all(self, a: Column, b: Column) -> Column:
        """Rows of `a` less as many as `b` has, the best first."""
        return F.slice(F.sort_array(a, asc=False), F.size(b) + 1, F.size(a))

    def select(self, rows: Column) -> DataFrame:
        """The result of an expression over sets as rows."""
        out = self.rows.select(*KEY, F.explode(rows).alias("_row"))
        return out.select(*[F.col(c) if c in KEY else F.col(f"_row.{c}").alias(c) for c in self.columns])
