"""Touching passages merged as they arrive: the open islands of a file are state, which the watermark closes.

Rows come in any order and in any batches. A row joins the islands that it touches,
which become one. When the watermark has passed the latest row of a file, its islands are
given out, as `docorder.merge_adjacent` gives them for all rows at once, and the state is
dropped. Rows that come later than the watermark allows are not taken, as everywhere in
streams.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PIECE = "struct<line_start:long,line_end:long,chunk_index:long,chunk:string>"
ISLAND = f"line_start long, line_end long, chunk_index long, score double, pieces array<{PIECE}>"
MERGED = "corpus string, source string, chunk_index long, line_start long, line_end long, location string, score double, chunk string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def join_islands(islands: list[tuple]) -> list[tuple]:
    """(first line, last line, chunk, score, pieces) of islands none of which touch, from ones that may."""
    out: list[list] = []
    for a, b, chunk, score, pieces in sorted(islands, key=lambda x: (x[0], x[1], x[2])):
        if out and a <= out[-1][1] + 1:
            last = out[-1]
            last[1], last[2], last[3] = max(last[1], b), min(last[2], chunk), max(last[3], score)
            last[4] = last[4] + list(pieces)
        else:
            out.append([a, b, chunk, score, list(pieces)])
    return [tuple(x) for x in out]


class Merging(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.islands = handle.getListState("islands", ISLAND)
        self.latest = handle.getValueState("latest", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in self.islands.get()] if self.islands.exists() else []
        held = [(int(a), int(b), int(c), float(s), [tuple(p) for p in pieces]) for a, b, c, s, pieces in held]
        before = int(self.latest.get()[0]) if self.latest.exists() else None
        at = before or 0
        for batch in rows:
            for a, b, chunk, score, text, seen in zip(*(batch[c].tolist() for c in ("line_start", "line_end", "chunk_index", "score", "chunk", "seen")), strict=True):
                held.append((int(a), int(b), int(chunk), float(score), [(int(a), int(b), int(chunk), text)]))
                at = max(at, int(seen.timestamp() * 1000))
        self.islands.put(join_islands(held))
        if before is not None and at != before:
            self.handle.deleteTimer(before)
        if at != before:
            self.latest.update((at,))
            self.handle.registerTimer(at)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        for a, b, chunk, score, pieces in self.islands.get():
            said = "\n".join(p[3] for p in sorted((tuple(p) for p in pieces), key=lambda p: p[:3]))
            out.append((key[0], key[1], chunk, a, b, f"{key[1]}:{a}-{b}", score, said))
        self.islands.clear()
        self.latest.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in MERGED.split(", ")])

    def close(self) -> None:
        pass


def merge_stream(rows: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream of (corpus, source, chunk_index, line_start, line_end, score, chunk, seen) -> merged passages, each when the watermark, `delay` behind the latest `seen`, has passed its file's last row. Needs the RocksDB state store (see `use_rocks`)."""
    asked = rows.withWatermark("seen", delay).select("corpus", "source", "seen", *[F.col(c).cast("long").alias(c) for c in ("chunk_index", "line_start", "line_end")], F.col("score").cast("double").alias("score"), "chunk")
    return asked.groupBy("corpus", "source").transformWithStateInPandas(Merging(), MERGED, "Append", "EventTime")


def use_rocks(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
