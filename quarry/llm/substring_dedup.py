"""Substring dedup: words that lie in a window already seen in an earlier document go.

Every window of `window` words gets a Rabin-Karp hash. Counting all of them
would shuffle each word of the corpus, so windows that cannot repeat are set
aside first, without loss: a window's anchor is the smallest hash of its runs of
`anchor` words, equal windows have equal anchors, and neighbouring windows
mostly share theirs, so there are some twenty times fewer anchors than words.
Only windows whose anchor occurs in several documents are counted in Spark, by
128 bits of hash. A document's window is removed where the smallest document
that has it is another; removed windows merge into maximal intervals.

Hot passages: an anchor that several documents of a batch have is known to repeat
there and then; only one row of it goes on to be counted with those of other
batches. A window goes on once for each batch, with the smallest document that
has it there (the others' windows are already settled). So a passage in a third
of all documents is a row or two for each task.

Defined cases: null and empty texts have no words; documents with less than a
window of words lose none; a repeat within one document alone stays; documents
with equal ids lose nothing to each other, and each loses what a smaller id has;
a null id counts as larger than all others, and documents without one come in
the order of 128 bits of hash of their texts, of exact copies one first.
Ids are integers; others are refused.
A row is known by its id and 64 bits of hash of the text, without an id by 128.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import RollingHash, as_bytes, integer_ids, mix, no_rows, sliding_min, word_hashes, words

ROLLING = RollingHash()
#: A row's key: `_id` is the id or, where that is null, further bits of the text's hash.
KEY = ["_null", "_id", "_k"]


def _hashes(text: bytes | None, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the words' hashes, and for each window its anchor."""
    sums = ROLLING.prefix(word_hashes(words(text)))
    if len(sums) <= window:
        return sums, np.zeros(0, np.uint64)
    return sums, sliding_min(ROLLING.windows(sums, anchor), window - anchor + 1)


def _anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """docs (_k, _text) -> (anchor, salt, n, docs): for each batch of documents and anchor the `_k` of those with it.

    Of one document it is a row to be counted, with salt 0. Of several it repeats
    for sure: a row of salt 0 without documents says so to other batches, and the
    documents stand in a row with a salt of its own.
    """

    def run(batches):
        for batch in batches:
            found, owners = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.unique(_hashes(text.as_py(), window, anchor)[1])
                found.append(own)
                owners.append(np.full(len(own), doc_id, np.int64))
            keys, ids = np.concatenate(found or [np.zeros(0, np.uint64)]), np.concatenate(owners or [np.zeros(0, np.int64)])
            order = np.lexsort((ids, keys))
            keys, ids = keys[order], ids[order]
            starts = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(keys)).astype(np.int32)), pa.array(ids))
            keys, size = keys[starts].view(np.int64), np.diff(np.append(starts, len(keys)))
            several = size > 1
            yield _rows(keys, np.where(several, ids[starts] | 1, 0), size, lists)
            yield _rows(keys[several], np.zeros(several.sum(), np.int64), size[several], pa.array([[]] * int(several.sum()), pa.list_(pa.int64())))

    def _rows(keys, salt, n, lists):
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(salt), pa.array(n.astype(np.int32)), lists], names=["anchor", "salt", "n", "docs"])

    return docs.mapInArrow(run, "anchor long, salt long, n int, docs array<long>")


def _repeated_anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(_k, anchors): of each document those that other documents have too. Should two documents meet in `_k`, both have the anchors of both, which only makes more windows to count."""
    found = _anchors(docs.select("_k", "_text"), window, anchor)
    same = Window.partitionBy("anchor", "salt")  # a row for each batch at most
    shared = found.withColumn("_n", F.sum("n").over(same)).where("_n > 1")
    each = shared.select("anchor", F.explode("docs").alias("_k"))
    return each.groupBy("_k").agg(F.collect_set("anchor").alias("anchors"))


ROW = "a long, b long, _null boolean, _id long, _k long, start int, end int, settled boolean"


def _owners(null: np.ndarray, ids: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Places of rows in the order of documents: equal for equal ids; rows without one are told apart by their keys."""
    k = np.where(null, k, 0)
    order = np.lexsort((k, ids, null))
    null, ids, k = null[order], ids[order], k[order]
    new = np.append(False, (null[1:] != null[:-1]) | (ids[1:] != ids[:-1]) | (k[1:] != k[:-1]))
    out = np.empty(len(k), np.int64)
    out[order] = np.cumsum(new[: len(k)])
    return out


def _windows(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """docs (_null, _id, _k, _text, anchors) -> windows with a shared anchor: hash (a, b), document and start; `settled` rows are intervals to remove already."""

    def run(batches):
        for batch in batches:
            keys = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:3]]
            owner = _owners(*keys)
            rows: list[list[np.ndarray]] = [[], [], [], []]
            for i, (text, shared) in enumerate(zip(batch.column(3), batch.column(4), strict=True)):
                sums, own = _hashes(text.as_py(), window, anchor)
                known = np.sort(shared.values.to_numpy().view(np.uint64))
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                starts = np.flatnonzero(known[at] == own) if len(own) else np.zeros(0, np.int64)
                if len(starts):
                    hashes = ROLLING.windows(sums, window)[starts]
                    rows[0].append(hashes)
                    rows[1].append(mix(own[starts] + np.uint64(1)))
                    rows[2].append(np.full(len(starts), i, np.int64))
                    rows[3].append(starts)
            if not rows[0]:
                continue
            a, b, at, starts = map(np.concatenate, rows)
            order = np.lexsort((starts, at, owner[at], b, a))
            a, b, at, starts = a[order], b[order], at[order], starts[order]
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            least = owner[at[np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))]]
            settled = owner[at] > least
            # places of one hash in one document share its fate, so those that touch are one interval
            a, b, own, places = (x[~settled] for x in (a, b, at, starts))
            cut = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (own[1:] != own[:-1]) | (places[1:] > places[:-1] + window))
            first = np.flatnonzero(cut)
            last = np.append(first[1:], len(own)) - 1
            yield _block(a[first], b[first], [x[own[first]] for x in keys], places[first], places[last] + window, False)
            if settled.any():
                at, starts = at[settled], starts[settled]
                order = np.lexsort((starts, at))
                at, starts = at[order], starts[order]
                cut = np.append(True, (at[1:] != at[:-1]) | (starts[1:] > starts[:-1] + window))
                first = np.flatnonzero(cut)
                last = np.append(first[1:], len(at)) - 1
                mine = [x[at[first]] for x in keys]
                yield _block(mix(mine[2].view(np.uint64)), np.zeros(len(first), np.uint64), mine, starts[first], starts[last] + window, True)

    def _block(a, b, keys, starts, ends, settled):
        columns = [a.view(np.int64), b.view(np.int64), *keys, starts.astype(np.int32), ends.astype(np.int32), np.full(len(starts), settled)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", *KEY, "start", "end", "settled"])

    return docs.mapInArrow(run, ROW)


def _intervals(rows: DataFrame) -> DataFrame:
    """(_null, _id, _k, start, end) of what goes: settled intervals, and windows whose hash a smaller document has. Rows come sorted by hash and document, so one pass with the current hash's first document will do."""

    def run(batches):
        last = None
        for batch in batches:
            a, b, null, ids, k, start, end, settled = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(a):
                continue
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            first = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
            own = np.where(null, k, 0)
            least = [x[first] for x in (null, ids, own)]
            if last is not None and (a[0], b[0]) == last[0]:
                run_end = int(np.argmax(new[1:])) + 1 if new[1:].any() else len(a)
                for x, value in zip(least, last[1], strict=True):
                    x[:run_end] = value
            last = (a[-1], b[-1]), [x[-1] for x in least]
            # they are sorted, so a document that is not the first is a larger one
            gone = settled | (null != least[0]) | (ids != least[1]) | (own != least[2])
            yield pa.RecordBatch.from_arrays([pa.array(x[gone]) for x in (null, ids, k, start, end)], names=[*KEY, "start", "end"])

    # settled rows have hashes of their own (b = 0, settled first), so no window's run takes them in
    dealt = rows.repartition(*[F.col(c) for c in ("a", "b", "settled")]).sortWithinPartitions("settled", "a", "b", *KEY)
    return dealt.mapInArrow(run, "_null boolean, _id long, _k long, start int, end int")


def tagged(docs: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """`_null`, `_id`, `_k`, `_text` and, if any are to be kept, a struct `_row` of these columns. Where none are, the shuffle of the texts by `_k` is one for all joins of a query."""
    row = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row")] if keep else []
    doc_id, text = F.col("doc_id").cast("long"), as_bytes()
    integer_ids(docs)
    key = [doc_id.isNull().alias("_null"), F.coalesce(doc_id, F.xxhash64(F.lit(1), text)).alias("_id"), F.xxhash64(doc_id, text).alias("_k")]
    return docs.select(*row, *key, text.alias("_text"))


def find_repeats(docs: DataFrame, window: int = 50, anchor: int = 12) -> DataFrame:
    """docs (doc_id, text, ...) -> key, `_gone` (array of start, end: words to remove, maximal intervals in order) for documents that lose any."""
    texts = tagged(docs)
    shared = texts.join(_repeated_anchors(texts, window, anchor), "_k").select(*KEY, "_text", "anchors")
    found = _intervals(_windows(shared, window, anchor))
    places = found.groupBy(*KEY).agg(F.collect_set(F.struct("start", "end")).alias("places"))

    def merge(batches):
        for batch in batches:
            out = []
            for places in batch.column(3).to_pylist():
                spans: list[dict] = []
                for x in sorted(places, key=lambda p: (p["start"], p["end"])):
                    if spans and x["start"] <= spans[-1]["end"]:
                        spans[-1]["end"] = max(spans[-1]["end"], x["end"])
                    else:
                        spans.append(x)
                out.append(spans)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, kind)], names=[*KEY, "_gone"])

    return places.mapInArrow(merge, "_null boolean, _id long, _k long, _gone array<struct<start:int,end:int>>")


def remove_repeats(docs: DataFrame, window: int = 50, anchor: int = 12, keep: list[str] | None = None, digest: bool = False) -> DataFrame:
    """`keep` columns of `docs` with `text` made of the words kept, joined by single spaces (unchanged where none goes), `n_words` and `n_removed`; with `digest` the text gives way to `kept_sha256` of its words."""
    from pyspark.sql.types import StructType

    last = "kept_sha256" if digest else "text"
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("text", "n_words", "n_removed", "kept_sha256")]
    rest = [c for c in keep if c != "doc_id"]  # the id is made from `_id` again, so that it need not travel beside it
    gone = find_repeats(docs, window, anchor)
    # by `_k`, as the texts are dealt already; the rest of the key is compared on the spot
    mine, theirs = tagged(docs, rest), gone.select(F.col("_k"), F.col("_null").alias("_null2"), F.col("_id").alias("_id2"), "_gone")
    same = (F.col("_id").bitwiseXOR(F.col("_id2")) == 0) & (F.col("_null").cast("int") + F.col("_null2").cast("int") != 1)
    joined = mine.join(theirs, (mine["_k"] == theirs["_k"]) & same, "left").drop(theirs["_k"])
    copy = F.lit(False)
    if not no_rows(docs.where("doc_id is null").select("doc_id")):
        # of exact copies without an id one comes first, to which the others lose all their windows
        copy = F.col("_null") & (F.row_number().over(Window.partitionBy("_k", "_null", "_id").orderBy("_k")) > 1)
    joined = joined.withColumn("_copy", copy).select(*(["_row"] if rest else []), "_null", "_id", "_text", "_gone", "_copy")
    width = len(joined.columns) - 3
    schema = StructType([*joined.schema.fields[:width], *StructType.fromDDL(f"n_words long, n_removed long, {last} string").fields])
    names = schema.names

    def run(batches):
        for batch in batches:
            counts, removed, made = [], [], []
            for text, spans, copy in zip(batch.column(width), batch.column(width + 1).to_pylist(), batch.column(width + 2).to_pylist(), strict=True):
                text = text.as_py()
                tokens = words(text)
                if copy and len(tokens) >= window:
                    spans = [{"start": 0, "end": len(tokens)}]
                left, lost, at = [], 0, 0
                for x in spans or ():
                    left += tokens[at : x["start"]]
                    at = x["end"]
                    lost += x["end"] - x["start"]
                left += tokens[at:]
                counts.append(len(tokens))
                removed.append(lost)
                if digest:
                    made.append(hashlib.sha256(b" ".join(left)).hexdigest())
                else:
                    made.append(b" ".join(left).decode() if lost else text.decode() if text is not None else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(made, pa.string())], names=names)

    doc_id = F.when(~F.col("_null"), F.col("_id")).cast(docs.schema["doc_id"].dataType).alias("doc_id")
    return joined.mapInArrow(run, schema).select(*[doc_id if c == "doc_id" else F.col(f"_row.`{c}`") for c in keep], "n_words", "n_removed", last)
