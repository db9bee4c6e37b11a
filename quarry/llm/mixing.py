"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, how often the mix takes it: of all rates of at most
`most` that give each source its target of words, those of the least relative
entropy to the corpus as it is, where every document has rate 1. The solution is
exp(t * size), cut at `most`, with one tilt t for each source. The tilts solve
the convex dual by Newton steps, each one aggregate over counts of (source,
size), as documents of one size and source have one rate. A step that leaves the
bracket known so far is halved into it, so the steps settle for any sizes.

Rates become copies for each (source, size) too, largest sizes first, and what
rounding leaves is carried on to the next smaller size: a source misses its target
by about half its smallest document. Which of equally large documents get the
odd copies is settled by a hash of their ids, numbered in groups of about a thousand.

A word count, not a text, is kept of each document. Sources are a table and are
ranked, targeted and tilted there; the driver sees single numbers. In one task
come together: the sizes of one source, which are as many as there are different
sizes, and one row for each thousand documents of one size and source. Sums run
in decimals, so reruns agree.

Defined cases: a null source is one of its own and the last; null and empty texts
have size 0, rate 1 and nothing taken; null or repeated doc_ids stand for rows of
their own; an empty table gives an empty result. Columns other than doc_id, text
and source are not read.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import cut, no_rows

WEIGHTS = (5, 2, 1)
WORDS = r"[^\x20\x09-\x0D]+"
#: Sums of the dual are kept to this many places, whatever order they come in.
EXACT = "decimal(38,10)"


def in_order(rows: DataFrame, key: str) -> DataFrame:
    """`rank` from 0 by a column of distinct values, in no single task: places within sorted partitions behind the sizes of the earlier ones."""
    placed = cut(rows.orderBy(key).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_id", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(starts, "_part").withColumn("rank", F.col("_start") + within).drop("_part", "_start", "_id")


def targets(sources: DataFrame, most: int = 3, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources (key, source_size) -> with `target`: all sizes dealt out by the weights, in order of the keys and repeating, up to `most` times a source's size; what is above is dealt out anew."""
    by_rank = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    sources = cut(in_order(sources, "key").withColumn("weight", by_rank).drop("rank"))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        above = F.col("source_size") * most < F.col("weight") * F.lit(level)
        n, taken, open_weight = sources.agg(F.count_if(above), F.sum(F.when(above, F.col("source_size") * most)), F.sum(F.when(~above, F.col("weight")))).first()
        if n == full or not open_weight:
            break
        level, full = (int(total) - int(taken or 0)) / int(open_weight), n
    return sources.withColumn("target", F.least((F.col("source_size") * most).cast("double"), F.col("weight") * F.lit(level))).drop("weight")


def rate_of(tilt: Column, size: Column, scale: Column, most: int) -> Column:
    """exp(tilt * size / scale), at most `most`; 1 for documents without words."""
    return F.when(size == 0, 1.0).when(_free(tilt, size, scale, most), F.exp(tilt * size / scale)).otherwise(F.lit(float(most)))


def _free(tilt: Column, size: Column, scale: Column, most: int) -> Column:
    return tilt * size / scale < math.log(most)


def tilts(counts: DataFrame, sources: DataFrame, most: int = 3, near: float = 1e-7, steps: int = 200) -> DataFrame:
    """counts (key, size, m), sources (key, source_size, target) -> sources with `tilt` and `scale`: rates add up to the target words of each source."""
    full = F.col("target") >= F.col("source_size") * most  # all rates are `most`
    squares = F.sum(F.col("size").cast("decimal(38,0)") * F.col("size") * F.col("m"))
    mean = counts.where("size > 0").groupBy("key").agg((squares.cast("double") / F.sum(F.col("size") * F.col("m"))).alias("scale"))  # of the document of a word
    state = sources.join(mean, "key", "left").select(
        "key", "source_size", "target", F.coalesce("scale", F.lit(1.0)).alias("scale"), F.when(full, 1e12).otherwise(F.log(F.col("target") / F.col("source_size"))).alias("tilt"), F.lit(-1e12).alias("low"), F.lit(1e12).alias("high"),
        (full | (F.col("source_size") == 0)).alias("settled"),
    )
    for _ in range(steps):
        state = cut(newton_step(counts, state, most, near))
        if no_rows(state.where(~F.col("settled"))):
            return state.select("key", "source_size", "target", "scale", "tilt")
    raise RuntimeError("the dual did not settle")


def newton_step(counts: DataFrame, state: DataFrame, most: int, near: float) -> DataFrame:
    """One step of every source that is not settled: the dual's slope and curvature by an aggregate over all sizes. The step solves for the logarithm of the words taken, which bends less."""
    at = F.col("tilt"), F.col("size"), F.col("scale"), most
    rate = rate_of(*at)
    words = F.col("m") * F.col("size")
    terms = counts.join(state.where(~F.col("settled")).select("key", "tilt", "scale"), "key").select(
        "key", (words * rate).cast(EXACT).alias("taken"), F.when(_free(*at), words * rate * F.col("size") / F.col("scale")).otherwise(0.0).cast(EXACT).alias("bend")
    )
    sums = terms.groupBy("key").agg(F.sum("taken").cast("double").alias("taken"), F.sum("bend").cast("double").alias("bend"))
    slope = F.col("taken") - F.col("target")
    low = F.when(slope < 0, F.greatest("low", "tilt")).otherwise(F.col("low"))
    high = F.when(slope > 0, F.least("high", "tilt")).otherwise(F.col("high"))
    met = state.join(sums, "key", "left").withColumns({"low": F.when(F.col("settled"), F.col("low")).otherwise(low), "high": F.when(F.col("settled"), F.col("high")).otherwise(high)})
    # far from any bracket a step goes no further than doubling
    reach = F.abs("tilt") + 1
    step = F.greatest(-reach, F.least(reach, F.when(F.col("bend") > 0, F.log(F.col("target") / F.col("taken")) * F.col("taken") / F.col("bend")).otherwise(-F.signum(slope) * reach)))
    aim = F.col("tilt") + step
    inside = (aim > F.col("low")) & (aim < F.col("high"))
    done = F.col("settled") | (F.abs(slope) <= F.lit(near) * F.col("target")) | (F.col("high") - F.col("low") <= 1e-13 * reach)
    return met.withColumn("_done", F.coalesce(done, F.lit(True))).select(
        "key", "source_size", "target", "scale",
        F.when(F.col("_done"), F.col("tilt")).when(inside, aim).otherwise((F.col("low") + F.col("high")) / 2).alias("tilt"), "low", "high", F.col("_done").alias("settled"),
    )


def copies(counts: DataFrame, tilted: DataFrame, most: int = 3) -> DataFrame:
    """counts (key, size, m) -> with `rate` and `copies`, whole copies of all m documents together; what rounding leaves goes on to the next smaller size."""
    rated = counts.join(tilted.select("key", "tilt", "scale"), "key").select("key", "size", "m", rate_of(F.col("tilt"), F.col("size"), F.col("scale"), most).alias("rate"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ascending=False)
        out, left = [], 0.0
        for size, m, rate in zip(rows["size"].tolist(), rows["m"].tolist(), rows["rate"].tolist(), strict=True):
            if not size:
                out.append(m)
                continue
            asked = m * rate * size + left
            n = min(most * m, max(0, round(asked / size)))
            left = asked - n * size
            out.append(n)
        return rows.assign(copies=out)

    return rated.groupBy("key").applyInPandas(run, "key string, size long, m long, rate double, copies long")


def mix_sources(docs: DataFrame, most: int = 3, weights: tuple[int, ...] = WEIGHTS, group_rows: int = 1_000) -> DataFrame:
    """docs (doc_id, source, text) -> doc_id, size, source_size, target, rate, copies, taken: words the mix takes of the document, `copies` times its size."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("t")).alias("key")  # null behind all
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORDS)), F.lit(0)).cast("long").alias("size")
    sized = cut(docs.select("doc_id", key, size, F.monotonically_increasing_id().alias("uid")))  # written, so the ids stay
    counts = cut(sized.groupBy("key", "size").agg(F.count("*").alias("m")))
    largest = counts.agg(F.max("m")).first()[0] or 0
    sources = targets(counts.groupBy("key").agg(F.sum(F.col("size") * F.col("m")).alias("source_size")), most, weights)
    tilted = tilts(counts, sources, most)
    shares = cut(copies(counts, tilted, most))
    groups = max(1, -(-largest // group_rows))
    dealt = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "key", "size"), F.lit(groups)))
    before = Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("key", "size", "bucket").agg(F.count("*").alias("n")).select("key", "size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    starts = starts.join(shares, ["key", "size"]).join(tilted.select("key", "source_size", "target"), "key")
    inside = Window.partitionBy("key", "size", "bucket").orderBy(F.xxhash64("doc_id"), "doc_id", "uid")
    placed = dealt.withColumn("place", F.row_number().over(inside) - 1).join(starts, ["key", "size", "bucket"])
    own = F.floor(F.col("copies") / F.col("m")) + (F.col("start") + F.col("place") < F.col("copies") % F.col("m")).cast("long")
    return placed.withColumn("own", own).select("doc_id", "size", "source_size", "target", "rate", F.col("own").cast("long").alias("copies"), (F.col("own") * F.col("size")).cast("long").alias("taken"))
