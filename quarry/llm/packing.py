"""Best-fit packing of token pieces into sequences, by exact complements first.

Only lengths matter for a packing, and a capacity of C tokens knows at most C
lengths. Spark counts the pieces of each length; from these C counts the driver
plans patterns ("so many sequences of lengths 1500 + 400 + 148"): largest pieces
first, it fills the gap exactly with a single, a pair or a triple of available
lengths, and what has no exact complement goes best-fit into the tightest gap
left. Every step uses up a length or a kind of gap, so the plan is as small as
the capacity, whatever the corpus. Spark then numbers the pieces of each length
and looks up each one's sequence and place in the plan.

Defined cases: null and empty texts are the end id alone; documents longer than
the capacity are cut into pieces of just the capacity behind a shorter first
one; repeated documents, and rows of null or equal ids, are packed each; an empty
table has no pieces. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import cut

SHIFT = np.int64(40)


class Tokens:
    """Ids of byte-level BPE as little-endian uint32 bytes.

    No token spans the place before a space that follows a non-space character,
    so a text is encoded space by space and each such chunk's ids are kept; texts
    where spaces meet other white space, or with a special token's name, are
    encoded whole.
    """

    def __init__(self, tokenizer_json: str, ranks: str, pattern: str, keep: int = 400_000):
        import base64

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=merges, special_tokens={}).encode_ordinary
        self.full = Tokenizer.from_file(tokenizer_json)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.mixed = regex.compile(r"\s \S|\s $|^ | \s").search
        self.kept: dict[str, bytes] = {}
        self.keep = keep

    def _ids(self, chunk: str) -> bytes:
        return np.array(self.fast(chunk), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.mixed(text):
            return self._ids(text)
        kept, out, lead = self.kept, [], ""
        for chunk in text.split(" "):
            ids = kept.get(chunk) if lead else None
            if ids is None:
                ids = self._ids(lead + chunk)
                if lead and len(kept) < self.keep and len(chunk) < 64:
                    kept[chunk] = ids
            out.append(ids)
            lead = " "
        return b"".join(out)


def public_tokens() -> Callable[[], Tokens]:
    import public_tokenizers

    path = public_tokenizers.path
    args = path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return lambda: Tokens(*args)


PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long, turn long"


def pieces(docs: DataFrame, tokens: Callable[[], Tokens], capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """docs (doc_id, text) -> doc_id, piece, start, length, ids_crc32, turn (the how many-th piece of its task it is, which tells equal rows apart once they are written) and, on demand, `ids` (little-endian uint32 bytes)."""
    built: dict = {}
    end = np.array([end_id], "<u4").tobytes()
    extra = [("ids", pa.binary())] if with_ids else []

    def run(batches):
        if "it" not in built:
            built["it"] = tokens()
        turn = 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = built["it"].encode(text.as_py() or "") + end
                n = len(ids) // 4
                first = n % capacity or capacity
                for i, start in enumerate([0, *range(first, n, capacity)]):
                    part = ids[4 * start : 4 * (start + (capacity if i else first))]
                    rows.append((doc_id, i, start, len(part) // 4, zlib.crc32(part), turn, *([part] * with_ids)))
                    turn += 1
            kinds = [("doc_id", batch.schema.types[0]), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("turn", pa.int64()), *extra]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], names=[k for k, _ in kinds])

    schema = PIECES.format(id=docs.schema["doc_id"].dataType.simpleString()) + ", ids binary" * with_ids
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how many such sequences) that use every piece of `counts` (length to number) once.

    Triples and pairs use up small pieces that the residuals may need more, so it
    is planned with complements of up to three, two, one and no pieces, and the plan of
    the fewest sequences stands, of equal ones that of most complements. The last is
    best-fit decreasing alone, so there are never more than by that.
    """
    found = [_plan(counts, capacity, most) for most in (3, 2, 1, 0)]
    return min(found, key=lambda patterns: sum(n for _, n in patterns))


def _plan(counts: dict[int, int], capacity: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    free = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        free[length] = n
    out: list[tuple[tuple[int, ...], int]] = []

    def take(*lengths: int) -> None:
        need = {x: lengths.count(x) for x in lengths}
        n = min(int(free[x]) // k for x, k in need.items())
        if n:
            for x, k in need.items():
                free[x] -= n * k
            out.append((lengths, n))

    def pairs(gap: int, most: int):
        """Available (b, c) with b + c = gap and c <= b <= most, largest b first."""
        b = np.arange(min(most, gap - 1), (gap + 1) // 2 - 1, -1)
        return [(int(x), gap - int(x)) for x in b[(free[b] > 0) & (free[gap - b] > 0)]] if len(b) else []

    take(capacity)
    for a in range(capacity - 1, 0, -1):
        gap = capacity - a
        if most >= 1 and free[a] and gap <= a:
            take(a, gap)
        if most >= 2 and free[a]:
            for b, c in pairs(gap, a):
                take(a, b, c)
                if not free[a]:
                    break
        if most >= 3 and free[a]:
            for b in np.flatnonzero(free[: min(a, gap - 2) + 1])[::-1].tolist():
                if not free[a]:
                    break
                for c, d in pairs(gap - b, b) if free[b] else ():
                    take(a, b, c, d)
                    if not free[a] or not free[b]:
                        break

    gaps: dict[int, list[list]] = defaultdict(list)  # room left -> [lengths, how many]
    for a in range(capacity - 1, 0, -1):
        n = int(free[a])
        while n:
            room = min((r for r, found in gaps.items() if r >= a and found), default=0)
            if room:
                lengths, there = gaps[room].pop()
                used = min(n, there)
                if there > used:
                    gaps[room].append([lengths, there - used])
                gaps[room - a].append([(*lengths, a), used])
                n -= used
            else:
                fit = min(capacity // a, n)
                gaps[capacity - fit * a].append([(a,) * fit, n // fit])
                n %= fit
    return out + [(tuple(lengths), n) for found in gaps.values() for lengths, n in found]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan as intervals: piece number `first`.. of `length` goes to sequence `sequence`.. at `offset`; sorted by length and first."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for lengths, n in patterns:
        offset = 0
        for x in lengths:
            rows.append((x, used[x], sequence, offset))
            used[x] += n
            offset += x
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << SHIFT) | table[:, 1], "first": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack(parts: DataFrame, capacity: int = 2048, group_rows: int = 1_000, spread: tuple[str, ...] = ("doc_id", "piece", "ids_crc32", "turn")) -> DataFrame:
    """parts (..., length from 1 to capacity) -> the same rows with sequence_id and offset.

    Pieces of one length are numbered in groups of about `group_rows`, which the
    `spread` columns deal out. `parts` is read three times: give it cut from its
    lineage. Columns named _quarry_group, _quarry_start, _quarry_number and
    _quarry_at are taken as the operator's own; sequence_id and offset give way.
    """
    parts = parts.drop("sequence_id", "offset")
    lengths = parts.groupBy("length").count().collect()  # at most `capacity` rows
    counts = {r["length"]: r["count"] for r in lengths}
    where = slots(plan(counts, capacity))
    groups = max(1, -(-max(counts.values(), default=0) // group_rows))
    dealt = parts.withColumn("_quarry_group", F.pmod(F.xxhash64(*spread), F.lit(groups)))
    by_group = dealt.groupBy("length", "_quarry_group").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_quarry_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_group.select("length", "_quarry_group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_quarry_start"))
    inside = Window.partitionBy("length", "_quarry_group").orderBy(*spread)
    numbered = dealt.withColumn("_quarry_number", F.row_number().over(inside) - 1).join(starts, ["length", "_quarry_group"])

    def place(length: pa.Array, number: pa.Array) -> pa.Array:
        size, n = length.to_numpy(zero_copy_only=False).astype(np.int64), number.to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.searchsorted(where["key"], (size << SHIFT) | n, side="right") - 1
        return pa.StructArray.from_arrays([pa.array(where["sequence"][at] + n - where["first"][at]), pa.array(where["offset"][at])], names=["sequence_id", "offset"])

    placed = F.arrow_udf(place, "struct<sequence_id:long,offset:long>")
    return numbered.withColumn("_quarry_at", placed("length", F.col("_quarry_start") + F.col("_quarry_number"))).select(
        *[F.col(f"`{c}`") for c in parts.columns], F.col("_quarry_at.sequence_id").alias("sequence_id"), F.col("_quarry_at.offset").alias("offset")
    )


def pack_documents(docs: DataFrame, tokens: Callable[[], Tokens], capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """docs (doc_id, text) -> the pieces with sequence_id and offset; other columns of `docs` are not kept."""
    return pack(cut(pieces(docs, tokens, capacity, end_id)), capacity).drop("turn")
