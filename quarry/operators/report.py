"""Reports as text rows, for Spark's text writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RULE = "=" * 80


def numbered(rows: DataFrame, score: str = "score", ties: tuple[str, ...] = ("corpus", "chunk_index"), name: str = "i") -> DataFrame:
    """Numbers all rows, highest score first, in no single task: rows are numbered within bands of a ten-thousandth of score, behind the counts of the bands above."""
    banded = rows.withColumn("_band", F.coalesce(-F.floor(F.col(score) * 10_000), F.lit(1 << 60)))
    above = Window.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)  # some ten thousand bands at most
    before = banded.groupBy("_band").agg(F.count("*").alias("_n")).select("_band", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_band").orderBy(F.desc(score), *ties)
    placed = banded.withColumn("_place", F.row_number().over(inside)).join(before, "_band")
    return placed.withColumn(name, (F.col("_before") + F.col("_place")).cast("int")).drop("_band", "_before", "_place")


def chunk_report(rows: DataFrame) -> DataFrame:
    """(i, value): one section for each passage, best first."""
    text = F.format_string("## Chunk %d from %s\nLocation: %s\nScore: %.3f\n\n%s\n\n" + "-" * 80, "i", "corpus", "location", "score", "chunk")
    return numbered(rows).select("i", text.alias("value"))


def result_lines(rows: DataFrame) -> DataFrame:
    """(i, value): "[i] corpus - location (score: x)" and the passage."""
    return numbered(rows).select("i", F.format_string("[%d] %s - %s (score: %.3f)\n%s\n", "i", "corpus", "location", "score", "chunk").alias("value"))


def extraction_report(rows: DataFrame, contents: DataFrame, query: str, corpora: list[str], min_score: float, date: Column | None = None) -> DataFrame:
    """(part, value): header, a section for each source (best first, with its rebuilt text where the source is there), footer."""
    totals = rows.agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).where("n > 0")
    when = F.date_format(F.current_timestamp() if date is None else date, "yyyy-MM-dd HH:mm:ss")
    head = F.concat(
        F.lit(f"{RULE}\nEXTRACTION REPORT\n{RULE}\nQuery: {query}\nCorpora: {', '.join(corpora)}\nMinimum score: {min_score}\n"),
        F.format_string("Chunks: %d\nScores: %.3f - %.3f\nDate: %s\n%s", "n", "low", "high", when, F.lit(RULE)),
    )
    sources = rows.groupBy("corpus", "source").agg(F.max("score").alias("best"), F.count("*").alias("chunks"))
    sources = numbered(sources, "best", ("corpus", "source"), "part").join(contents, ["corpus", "source"], "left")
    section = F.format_string("\nSource: %s [%s] (%d chunks)\n\n%s", "source", "corpus", "chunks", F.coalesce("content", F.lit("")))
    foot = totals.select(F.lit(1 << 30).alias("part"), F.format_string("\n%s\nEnd of extraction: %d chunks\n%s", F.lit(RULE), "n", F.lit(RULE)).alias("value"))
    return totals.select(F.lit(0).alias("part"), head.alias("value")).unionByName(sources.select("part", section.alias("value"))).unionByName(foot)


def write_report(parts: DataFrame, path: str) -> bool:
    """Text files that follow each other by name, as the rows do by the first column; a short report is one file. Nothing is written where there are no rows."""
    if not parts.take(1):
        return False
    parts.orderBy(parts.columns[0]).select("value").write.mode("overwrite").text(path)
    return True
