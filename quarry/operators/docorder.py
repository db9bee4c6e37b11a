"""Document order, merging of neighbours, and rebuilding of source text.

Merging works in document order whatever the order of its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import location

ORDER = ["corpus", "source", "line_start", "chunk_index"]
#: Lines of a file that one task numbers the ranges of.
BLOCK_LINES = 100_000


def document_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*ORDER)


def _islands(rows: DataFrame, keys: list[str], lines: int) -> DataFrame:
    """Numbers runs of touching line ranges: a range that starts behind the furthest line so far, plus one, opens a run.

    The ranges of a file are dealt into blocks of `lines` lines. Each block is
    summed up by its furthest line, then by the runs that it opens; scans over the
    sums, one row a block, give every block what lies before it, so no task holds a
    file. `rows` is read three times, by one shuffle where Spark finds the same plan.
    """
    # names that are never null, so that joins and windows share one partitioning
    file = {f"_file{i}": F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for i, k in enumerate(keys)}
    block = [*file, "_block"]
    rows = rows.withColumns({**file, "_block": F.floor(F.col("line_start") / lines)}).repartition(*block)
    inside = Window.partitionBy(*block).orderBy("line_start", "line_end", "chunk_index")
    earlier = Window.partitionBy(*file).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    reach = rows.groupBy(*block).agg(F.max("line_end").alias("_far")).select(*block, F.max("_far").over(earlier).alias("_reached"))
    so_far = F.greatest("_reached", F.max("line_end").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.join(reach, block).withColumn("_opens", F.when(so_far.isNull() | (F.col("line_start") > so_far + 1), 1).otherwise(0))
    opened = rows.groupBy(*block).agg(F.sum("_opens").alias("_n")).select(*block, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_opened"))
    island = F.col("_opened") + F.sum("_opens").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(opened, block).withColumn("island", island).drop("_opens", "_opened", "_reached", *block)


def merge_adjacent(rows: DataFrame, lines: int = BLOCK_LINES) -> DataFrame:
    """Touching or overlapping passages of one file become one: widest range, highest score, texts joined by newlines."""
    said = F.array_sort(F.collect_list(F.struct("line_start", "line_end", "chunk_index", "chunk")))
    merged = _islands(rows, ["corpus", "source"], lines).groupBy("corpus", "source", "island").agg(
        F.min("chunk_index").alias("chunk_index"),
        F.min("line_start").alias("line_start"),
        F.max("line_end").alias("line_end"),
        F.max("score").alias("score"),
        F.array_join(F.transform(said, lambda x: x["chunk"]), "\n").alias("chunk"),
    )
    return merged.withColumn("location", location(F.col("source"), F.col("line_start"), F.col("line_end"))).select(
        "corpus", "source", "chunk_index", "line_start", "line_end", "location", "score", "chunk"
    )


def interval_union(rows: DataFrame, lines: int = BLOCK_LINES) -> DataFrame:
    """Line ranges of each source with touching ones joined."""
    return (
        _islands(rows, ["corpus", "source"], lines)
        .groupBy("corpus", "source", "island")
        .agg(F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"))
        .drop("island")
    )


def rebuild_text(lines: DataFrame, ranges: DataFrame, bin_lines: int = 1024) -> DataFrame:
    """lines (corpus, source, line_no, text) under joined ranges -> corpus, source, content: lines in order, a blank line between ranges.

    A range is cut at bin edges and meets the lines of its bins, whose bounds are then
    checked: as many rows as bins are touched, whatever the range's length. Ranges of
    one source do not overlap, so a line is in one at most.
    """
    bin_of = lambda c: F.floor(F.col(c) / bin_lines)
    cut = ranges.select("corpus", "source", "line_start", "line_end", F.explode(F.sequence(bin_of("line_start"), bin_of("line_end"))).alias("_bin")).where("line_start <= line_end")
    met = lines.withColumn("_bin", bin_of("line_no")).join(cut, ["corpus", "source", "_bin"]).where("line_no between line_start and line_end")
    texts = met.groupBy("corpus", "source", "line_start").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("said"))
    parts = texts.select("corpus", "source", "line_start", F.concat(F.array_join(F.transform("said", lambda x: x["text"]), "\n"), F.lit("\n")).alias("part"))
    whole = F.array_sort(F.collect_list(F.struct("line_start", "part")))
    return parts.groupBy("corpus", "source").agg(F.array_join(F.transform(whole, lambda x: x["part"]), "\n").alias("content"))
