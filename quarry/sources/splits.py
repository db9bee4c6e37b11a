"""Chunks of text files of any size: no row holds a file, no task needs one whole.

Spark reads lines by byte ranges. Within a range they are packed into blocks of
about a megabyte, in order. The chunker's greedy fold takes from one line to the
next only how many tokens it holds and where its chunk began, so a block is a small
function of what comes in: for ranges of tokens held, what goes out. These are scanned in
order, a few numbers for each block of a file; with what came in known, all blocks
chunk on their own, and the parts of chunks that cross blocks are put together.

The result is that of `chunk_lines` on the whole text. Files of no bytes have no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import estimate_tokens
from quarry.operators.chunk import DEFAULT_SIZE

BLOCK_BYTES = 1 << 20
BLOCKS = "path string, file_size long, split long, block int, n_lines long, n_bytes long, text string"
#: What a block makes of tokens held: for at most `most` tokens coming in, the line at which the chunk that is open at the end began (0: the one that came in, -1: none) and its tokens.
STEPS = "array<struct<most:int,start:long,tokens:int>>"
PARTS = "path string, start long, piece long, at long, line_end long, chunk string"


def read_blocks(spark: SparkSession, paths: list[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """path, file_size, split, block, n_lines, n_bytes, text: consecutive lines, in order within each byte range."""
    lines = spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary"))

    def run(batches):
        key, held, n_bytes, block = None, [], 0, 0

        def row():
            return pa.RecordBatch.from_pylist([{"path": key[0], "file_size": key[1], "split": key[2], "block": block, "n_lines": len(held), "n_bytes": n_bytes, "text": b"\n".join(held).decode()}], schema=kinds)

        for batch in batches:
            for path, size, split, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key is not None and (key != (path, size, split) or n_bytes >= block_bytes):
                    yield row()
                    block = block + 1 if key == (path, size, split) else 0
                    held, n_bytes = [], 0
                key = path, size, split
                held.append(line)
                n_bytes += len(line) + 1
        if held:
            yield row()

    kinds = pa.schema([("path", pa.string()), ("file_size", pa.int64()), ("split", pa.int64()), ("block", pa.int32()), ("n_lines", pa.int64()), ("n_bytes", pa.int64()), ("text", pa.string())])
    return lines.mapInArrow(run, BLOCKS)


def line_tokens(line: str) -> int:
    return int(len(line.split()) * 3.5)


def steps_of(tokens: list[int], size: int) -> list[tuple[int, int, int]]:
    """(most, start, tokens) of a block of lines, for rising numbers of tokens held before it; lines count from 1."""
    n = len(tokens)
    total = [0]
    for t in tokens:
        total.append(total[-1] + t)
    long = [i for i, t in enumerate(tokens) if t > size]

    def end(start: int, held: int) -> int:
        """The line that the chunk does not take any more, whose first line is `start`, or which came in with tokens."""
        over = next((i for i in long[bisect_left(long, start) :]), n)
        # the first line of a chunk always fits it
        first = start + (held < 0)
        i = bisect_left(total, size - max(held, 0) + total[start] + 1, first + 1 if first < n else n) - 1
        return min(max(i, first), over, n)

    known: list[tuple[int, int]] = [(-1, 0)] * (n + 1)  # by the line a chunk begins with, what is open at the end
    for i in range(n - 1, -1, -1):
        if tokens[i] > size:
            known[i] = known[i + 1]
        else:
            j = end(i, -1)
            known[i] = (i + 1, total[n] - total[i]) if j == n else known[j]
    out: list[tuple[int, int, int]] = []
    for held in range(size + 1):
        j = end(0, held)
        found = (held, 0, held + total[n]) if j == n else (held, *known[j])
        if out and out[-1][1:] == found[1:]:
            out[-1] = found
        elif out and out[-1][1] == found[1] == 0:  # tokens only add up: the range goes on
            out[-1] = (held, 0, total[n])
        else:
            out.append((held, found[1], total[n] if found[1] == 0 else found[2]))
    return out


def scan(blocks: pa.Table, size: int) -> pa.Table:
    """For each block of a file, in order: the line before its first, what comes in, and whether it is the last, and then ends with a line's end. Steps stay arrays of numbers, as a file may have many blocks."""
    number = {c: blocks[c].to_numpy() for c in ("split", "block", "n_lines", "n_bytes", "file_size")}
    order = np.lexsort((number["block"], number["split"]))
    steps, none = blocks["steps"].combine_chunks(), blocks["none"].combine_chunks()
    ends, most, to, more = steps.offsets.to_numpy(), *(steps.values.field(c).to_numpy() for c in ("most", "start", "tokens"))
    alone = none.field("start").to_numpy(), none.field("tokens").to_numpy()
    line, start, held, rows = 0, -1, 0, np.zeros((3, len(order)), np.int64)
    for n, i in enumerate(order.tolist()):
        rows[:, n] = line, start, held
        k = ends[i] + most[ends[i] : ends[i + 1]].searchsorted(held)
        at, tokens = (int(alone[0][i]), int(alone[1][i])) if start < 0 else (int(to[k]), int(more[k]))
        if at == 0:
            held += tokens
        else:
            start, held = (-1, 0) if at < 0 else (line + at, tokens)
        line += int(number["n_lines"][i])
    last = np.zeros(len(order), bool)
    last[-1] = number["n_bytes"].sum() == number["file_size"][0]
    names = ["path", "split", "block", "before", "start", "held", "last_of_ended"]
    return pa.Table.from_arrays([blocks["path"].combine_chunks(), *(pa.array(x) for x in (number["split"][order], number["block"][order], *rows, last))], names=names)


def parts_of(text: str, before: int, start: int, held: int, last_of_ended: bool, size: int) -> Iterator[tuple[int, int, int, int, str]]:
    """(first line of the chunk, piece, first line of the part, last line, text) of one block. `start` is the line of the chunk that is open before it, or -1."""
    lines, at = [], before + 1
    for number, line in enumerate(text.split("\n"), before + 1):
        words = line.split()
        tokens = int(len(words) * 3.5)
        if tokens > size:
            if lines:
                yield start, -1, at, number - 1, "\n".join(lines)
            step = max(1, size // 3)
            for piece, i in enumerate(range(0, len(words), step)):
                yield number, piece, number, number, " ".join(words[i : i + step])
            lines, start, held, at = [], -1, 0, number + 1
        elif start >= 0 and held + tokens > size:
            if lines:
                yield start, -1, at, number - 1, "\n".join(lines)
            lines, start, held, at = [line], number, tokens, number
        else:
            start = number if start < 0 else start
            at = at if lines else number
            lines.append(line)
            held += tokens
    end = before + text.count("\n") + 1
    if last_of_ended and start >= 0:
        lines.append("")
        at, end = at if len(lines) > 1 else end + 1, end + 1
    if lines:
        yield start, -1, at, end, "\n".join(lines)


def chunk_blocks(blocks: DataFrame, size: int = DEFAULT_SIZE, band: int = 100_000) -> DataFrame:
    """blocks (see `read_blocks`) -> path, chunk_index, line_start, line_end, chunk. `blocks` is read twice."""

    def tables(texts: pa.Array) -> pa.Array:
        made = []
        for text in texts:  # one at a time, as there may be thousands of blocks in a batch
            tokens = [line_tokens(x) for x in text.as_py().split("\n")]
            # of nothing held: as if a line of no tokens went before, but for where the chunk begins
            steps = steps_of(tokens, size)
            none = _from_nothing(tokens, size)
            made.append(pa.array([{"steps": [{"most": m, "start": s, "tokens": t} for m, s, t in steps], "none": {"start": none[0], "tokens": none[1]}}], kind))
        return pa.concat_arrays(made) if made else pa.array([], kind)

    step = [("start", pa.int64()), ("tokens", pa.int32())]
    kind = pa.struct([("steps", pa.list_(pa.struct([("most", pa.int32()), *step]))), ("none", pa.struct(step))])
    made = F.arrow_udf(tables, f"struct<steps:{STEPS},none:struct<start:long,tokens:int>>")
    small = blocks.select("path", "file_size", "split", "block", "n_lines", "n_bytes", made(F.col("text")).alias("_t")).select("*", "_t.*").drop("_t")
    states = small.groupBy("path").applyInArrow(lambda rows: scan(rows, size), "path string, split long, block int, before long, start long, held long, last_of_ended boolean")
    whole = blocks.select("path", "split", "block", "text").join(states, ["path", "split", "block"])

    def run(batches):
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            for i in range(batch.num_rows):  # the parts of one block at a time
                path, *block = (c[i].as_py() for c in batch.columns)
                rows = [(path, *part) for part in parts_of(*block, size)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["path", "start", "piece", "at", "line_end", "chunk"])

    parts = whole.select("path", "text", "before", "start", "held", "last_of_ended").mapInArrow(run, PARTS)
    said = F.array_sort(F.collect_list(F.struct("at", "chunk")))  # as many as the blocks that a chunk crosses
    chunks = parts.groupBy("path", "start", "piece").agg(F.max("line_end").alias("line_end"), F.array_join(F.transform(said, lambda x: x["chunk"]), "\n").alias("chunk"))
    kept = chunks.where(estimate_tokens(F.col("chunk")) > 0).withColumn("_band", F.floor(F.col("start") / band))
    return _numbered(kept).select("path", "chunk_index", F.col("start").cast("int").alias("line_start"), F.col("line_end").cast("int").alias("line_end"), "chunk")


def _from_nothing(tokens: list[int], size: int) -> tuple[int, int]:
    """(start, tokens) of the chunk open at a block's end, of nothing before it."""
    start, held = -1, 0
    for i, t in enumerate(tokens, 1):
        if t > size:
            start, held = -1, 0
        elif start >= 0 and held + t > size:
            start, held = i, t
        else:
            start, held = (i if start < 0 else start), held + t
    return start, held


def _numbered(chunks: DataFrame) -> DataFrame:
    """chunk_index in order of each file, by bands of lines and the counts of the bands before."""
    earlier = Window.partitionBy("path").orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    counts = chunks.groupBy("path", "_band").agg(F.count("*").alias("_n")).select("path", "_band", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("path", "_band").orderBy("start", "piece")
    return chunks.withColumn("_place", F.row_number().over(inside) - 1).join(counts, ["path", "_band"]).withColumn("chunk_index", (F.col("_before") + F.col("_place")).cast("int"))


def chunk_files(spark: SparkSession, paths: list[str], size: int = DEFAULT_SIZE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Chunks of text files, whatever their size."""
    return chunk_blocks(read_blocks(spark, paths, block_bytes), size)
