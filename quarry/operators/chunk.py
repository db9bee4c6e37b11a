"""Chunking: lines packed greedily up to a token budget, each chunk with its line range.

The fold depends on what came before, so it runs in Python over each document;
documents are independent, and Spark deals them out. A line over the budget is
split into word pieces that share its line number; blank chunks are dropped.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_SIZE = 100


def chunk_size(context_length: int | None) -> int:
    return int(0.5 * context_length) if context_length else DEFAULT_SIZE


def chunk_lines(text: str, size: int) -> list[tuple[str, int, int]]:
    """(chunk, first line, last line), lines counted from 1. A line has int(3.5 * words) tokens, a word piece 3 a word."""
    out: list[tuple[str, int, int]] = []
    held: list[str] = []
    held_tokens, start = 0, 1

    def flush(last: int) -> None:
        if held:
            out.append(("\n".join(held), start, last))

    for number, line in enumerate(text.split("\n"), 1):
        words = line.split()
        tokens = int(len(words) * 3.5)
        if tokens > size:
            flush(number - 1)
            step = max(1, size // 3)
            out += [(" ".join(words[i : i + step]), number, number) for i in range(0, len(words), step)]
            held, held_tokens, start = [], 0, number + 1
        elif held and held_tokens + tokens > size:
            flush(number - 1)
            held, held_tokens, start = [line], tokens, number
        else:
            held.append(line)
            held_tokens += tokens
    flush(text.count("\n") + 1)
    return [c for c in out if c[0].strip()]


def chunk_documents(docs: DataFrame, size: int = DEFAULT_SIZE, keys: tuple[str, ...] = ("corpus", "source"), mark: str | None = None) -> DataFrame:
    """docs (keys, text) -> keys (strings), chunk_index, line_start, line_end, chunk.

    With `mark`, a string column, every document has one more row, of chunk_index -1,
    whose chunk is the column's value.
    """
    asked = ["text"] if mark is None else ["text", mark]

    def run(batches):
        for batch in batches:
            at, rows = [], []
            said = batch.column(len(keys) + 1).to_pylist() if mark else ()
            for row, text in enumerate(batch.column(len(keys)).to_pylist()):
                found = [(i, a, b, c) for i, (c, a, b) in enumerate(chunk_lines(text or "", size))]
                if mark:
                    found.append((-1, 0, 0, said[row]))
                rows += found
                at += [row] * len(found)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string())
            kept = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(len(keys))]
            made = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[*keys, "chunk_index", "line_start", "line_end", "chunk"])

    schema = ", ".join(f"{k} string" for k in keys) + ", chunk_index int, line_start int, line_end int, chunk string"
    return docs.select(*keys, *asked).mapInArrow(run, schema)


def explode_lines(docs: DataFrame) -> DataFrame:
    """docs (corpus, source, text) -> corpus, source, line_no (from 1), text."""
    return docs.select("corpus", "source", F.posexplode(F.split("text", "\n")).alias("at", "text")).select(
        "corpus", "source", (F.col("at") + 1).alias("line_no"), "text"
    )
