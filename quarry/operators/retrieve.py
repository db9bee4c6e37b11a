"""Retrieval: exact inner-product scans, per-corpus and global top-k, quality gate, extraction."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import location
from quarry.functions.vector import similarities, similarity
from quarry.schema import RESULT


def score_chunks(chunks: DataFrame, query: Sequence[float], corpora: Sequence[str] | None = None) -> DataFrame:
    """Result rows (with embedding) of all chunks; `corpora` prunes partitions of the chunk table."""
    if corpora is not None:
        chunks = chunks.where(F.col("corpus").isin(*corpora))
    scored = chunks.withColumn("score", similarity(F.col("embedding"), query))
    return scored.withColumn("location", location(F.col("source"), F.col("line_start"), F.col("line_end"))).select(*RESULT, "embedding")


def search_rows(
    chunks: DataFrame, query: Sequence[float], corpora: Sequence[str] | None = None, min_score: float | None = 0.3, max_results: int | None = None
) -> DataFrame:
    """Every chunk that scores `min_score` or more; with `max_results` the best of these. No cap otherwise."""
    rows = score_chunks(chunks, query, corpora)
    if min_score is not None:
        rows = rows.where(F.col("score") >= min_score)
    return rows if max_results is None else rows.orderBy(F.desc("score"), "corpus", "chunk_index").limit(max_results)


def search_many(
    chunks: DataFrame, queries: Sequence[Sequence[float]], corpora: Sequence[str] | None = None, min_score: float | None = 0.3, max_results: int | None = None
) -> DataFrame:
    """The rows of several searches by one scan, `_ord` saying of which; chunks without an embedding are in none."""
    if corpora is not None:
        chunks = chunks.where(F.col("corpus").isin(*corpora))
    scored = chunks.withColumn("_scores", similarities(F.col("embedding"), queries))
    hits = F.transform("_scores", lambda x, i: F.struct(i.alias("_ord"), x.alias("score")))
    if min_score is not None:
        hits = F.filter(hits, lambda h: h["score"] >= min_score)
    rows = scored.select("*", F.explode(hits).alias("_hit")).withColumn("location", location(F.col("source"), F.col("line_start"), F.col("line_end")))
    rows = rows.select(*[F.col("_hit.score").alias(c) if c == "score" else F.col(c) for c in RESULT], "embedding", F.col("_hit._ord").alias("_ord"))
    if max_results is None:
        return rows
    best = Window.partitionBy("_ord").orderBy(F.desc("score"), "corpus", "chunk_index")  # of each task max_results at most
    return rows.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= max_results).drop("_rank")


def register_search(spark: SparkSession, name: str, chunks: str, vector: Callable[[str], Sequence[float]]) -> None:
    """Table function `name(text)` over the view `chunks` for Spark's SQL: all chunks with their score. `vector` gives a text's unit vector; in a task it is asked once for each text of a batch."""

    def score(vectors: pa.Array, texts: pa.Array) -> pa.Array:
        out, asked = [None] * len(vectors), {}
        for i, (v, t) in enumerate(zip(vectors, texts.to_pylist(), strict=True)):
            if v.is_valid and t is not None:
                if t not in asked:
                    asked[t] = np.array(vector(t), np.float64)
                out[i] = float(v.values.to_numpy(zero_copy_only=False).astype(np.float64) @ asked[t])
        return pa.array(out, pa.float64())

    spark.udf.register(f"{name}_score", F.arrow_udf(score, "double").asNondeterministic())
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(query STRING)
        RETURNS TABLE (corpus STRING, source STRING, chunk_index BIGINT, line_start BIGINT, line_end BIGINT, location STRING, score DOUBLE, chunk STRING)
        RETURN SELECT corpus, source, chunk_index, line_start, line_end, concat(source, ':', line_start, '-', line_end), {name}_score(embedding, query), chunk FROM {chunks}"""
    )


def top_k_per_corpus(rows: DataFrame, k: int) -> DataFrame:
    """The k best of each corpus; Spark keeps k rows of a corpus in each task before it shuffles."""
    best = Window.partitionBy("corpus").orderBy(F.desc("score"), "chunk_index")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def top_k(chunks: DataFrame, query: Sequence[float], k: int = 5, corpora: Sequence[str] | None = None) -> DataFrame:
    """The k best of each corpus, then the 2k best of these. A corpus with fewer chunks gives what it has."""
    best = top_k_per_corpus(score_chunks(chunks, query, corpora), k).drop("rank")
    return best.orderBy(F.desc("score"), "corpus", "chunk_index").limit(2 * k)


def quality_gate(top: DataFrame, min_score: float | None) -> DataFrame:
    """One row: quality_results, filtered_count, passed, and the message where fewer than two rows reach `min_score`; without it the gate is off."""
    good = F.lit(True) if min_score is None else F.col("score") >= min_score
    counts = top.agg(F.count_if(good).alias("quality_results"), F.count_if(~good).alias("filtered_count"))
    passed = F.lit(min_score is None) | (F.col("quality_results") >= 2)
    message = F.when(F.col("quality_results") + F.col("filtered_count") == 0, "No results found.").when(
        ~passed, F.concat(F.lit("Only "), F.col("quality_results").cast("string"), F.lit(f" result(s) reach the minimum score of {min_score}. Try a more specific query."))
    )
    return counts.withColumn("passed", passed).withColumn("message", message)


def _ranked(rows: DataFrame) -> Column:
    return F.row_number().over(Window.orderBy(F.desc("score"), "corpus", "chunk_index"))


def assemble_context(rows: DataFrame) -> DataFrame:
    """One row: passages, best first, as a prompt's sources. For the few rows of a top-k, which one task orders."""
    block = F.format_string("Source %d from %s (%s):\n%s\n\n", F.col("rank"), F.col("corpus"), F.col("location"), F.col("chunk"))
    blocks = rows.withColumn("rank", _ranked(rows)).select("rank", block.alias("block"))
    return blocks.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "").alias("context"))


def previews(rows: DataFrame, size: int = 200) -> DataFrame:
    return rows.withColumn("rank", _ranked(rows)).select("rank", "corpus", "location", F.format_string("%.3f", "score").alias("score"), F.substring("chunk", 1, size).alias("preview"))


def extraction_summary(rows: DataFrame) -> DataFrame:
    """One row: chunks, sources and score range of an extraction; zeros where it is empty."""
    return rows.agg(
        F.count("*").alias("total_chunks"),
        F.countDistinct("corpus", "source").alias("n_sources"),
        F.coalesce(F.min("score"), F.lit(0.0)).alias("min_score"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("max_score"),
    )


def by_source(rows: DataFrame) -> DataFrame:
    """Chunks and best score of each source, with per-corpus counts in the same row."""
    return rows.groupBy("corpus", "source").agg(F.count("*").alias("chunks"), F.max("score").alias("best"))


def score_statistics(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg("score").alias("avg_score"), F.max("score").alias("max_score"), F.min("score").alias("min_score"))
