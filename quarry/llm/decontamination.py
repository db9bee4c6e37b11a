"""Benchmark decontamination by winnowing.

Words are lower-cased runs of letters, digits and non-ASCII characters. Of every
window of `window` words the smallest hash of its k-grams is the window's
fingerprint, so a span of `window` or more words that a document shares with an
item has the same fingerprint in both: none can be missed. Where fingerprints
meet, the window's Rabin-Karp hash is looked up and its words are compared, and
hits that overlap extend to the whole shared span. An item of fewer words than
a window is one window of its own length.

The items' index goes to the tasks only while the items' texts measure at most
`broadcast_bytes`. Beyond that all of it are shuffles: fingerprints of texts meet
the distinct ones of the items, windows with such a fingerprint meet the distinct
windows of the items, word for word; what goes back to a document are places and
keys of lists of items. The items' side of each join has a key once, so a
passage in a third of all documents makes no pairs and is split at run time.

Defined cases: null and empty texts have no words; an item without words never
occurs; items with the same id are one item; an item without id marks words but
is not listed; repeated documents are judged each, equal texts (128 bits of hash)
looked up once; columns named n_words, n_hit, items or spans give way to the new
ones, and those named _quarry_high, _quarry_low, _quarry_places and _quarry_items
are taken as the operator's own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import RollingHash, alnum_words, as_bytes, cut, sliding_min, with_columns_from, word_hashes

HITS = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
TEXT_KEY = ["_quarry_high", "_quarry_low"]
ROLLING = RollingHash()


def _within(sorted_values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(sorted_values) or not len(asked):
        return np.zeros(len(asked), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, asked), len(sorted_values) - 1)] == asked


def fingerprints(sums: np.ndarray, window: int, k: int) -> np.ndarray:
    """For each window of words the smallest hash of its k-grams."""
    return sliding_min(ROLLING.windows(sums, k), window - k + 1)


def _prints(sums: np.ndarray, size: int, window: int, k: int) -> np.ndarray:
    """What windows of `size` words are looked up by: their fingerprint or, if they are those of short items, their hash."""
    return fingerprints(sums, window, k) if size == window else ROLLING.windows(sums, size)


def _spans(n: int, starts: np.ndarray, sizes: np.ndarray) -> tuple[int, list[dict]]:
    """How many of n words are hit, and the maximal spans of them."""
    hit = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(starts + sizes, minlength=n + 1)[: n + 1]
    covered = (np.cumsum(hit)[:n] > 0).astype(np.int8)
    edges = np.flatnonzero(np.diff(covered, prepend=0, append=0))
    return int(covered.sum()), [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


class ItemIndex:
    """Fingerprints and windows of some items, and how documents match them. A window is a hash and a place in one buffer of all items' words."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int, k: int):
        self.window, self.k = window, k
        self.names = [name for name, _ in items]
        buffer, filled, found = [], 0, {}
        for number, (_, text) in enumerate(items):
            tokens = alnum_words(text)
            if not tokens:
                continue
            size = min(window, len(tokens))
            sums = ROLLING.prefix(word_hashes(tokens))
            ends = filled + np.cumsum([len(t) + 1 for t in tokens]) - 1
            starts = np.append(filled, ends[:-1] + 1)
            n = len(tokens) - size + 1
            found.setdefault(size, []).append((ROLLING.windows(sums, size), _prints(sums, size, window, k), starts[:n], ends[size - 1 :], np.full(n, number)))
            buffer += [b" ".join(tokens), b" "]
            filled = int(ends[-1]) + 1
        self.buffer = b"".join(buffer)
        self.at = {}
        for size, parts in found.items():
            hashes, prints, *places = map(np.concatenate, zip(*parts, strict=True))
            order = np.argsort(hashes, kind="stable")
            self.at[size] = (hashes[order], np.unique(prints), *(x[order] for x in places))

    def match(self, text: bytes | None) -> tuple[int, int, list[str], list[dict]]:
        tokens = alnum_words(text)
        n = len(tokens)
        if not n or not self.at:
            return n, 0, [], []
        sums = ROLLING.prefix(word_hashes(tokens))
        hits, names = [], set()
        for size, (known, prints, starts, ends, items) in self.at.items():
            near = np.flatnonzero(_within(prints, _prints(sums, size, self.window, self.k)))
            hashes = ROLLING.windows(sums, size)[near]
            for i, low, high in zip(near.tolist(), np.searchsorted(known, hashes).tolist(), np.searchsorted(known, hashes, "right").tolist(), strict=True):
                said = b" ".join(tokens[i : i + size])
                mine = [j for j in range(low, high) if self.buffer[starts[j] : ends[j]] == said]
                if mine:
                    hits.append((i, size))
                    names.update(self.names[items[j]] for j in mine)
        hit, spans = _spans(n, *np.array(hits).T) if hits else (0, [])
        return n, hit, sorted(names - {None}), spans


def _columns(found: list[tuple]) -> list[pa.Array]:
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
    return [pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, keep: list[str] | None = None, broadcast_bytes: int = 8 << 20
) -> DataFrame:
    """docs (doc_id, text, ...) and benchmark (item_id, text) -> `keep` columns and n_words, n_hit, items (ids as strings), spans (of words hit, end exclusive)."""
    keep = docs.columns if keep is None else keep
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), as_bytes().alias("text"))
    items = items.where(F.col("text").cast("string").rlike(r"[^\x00-/:-@\[-`{-\x7f]"))  # others have no words
    size = items.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item_id"), F.lit(0)) + 64)).first()[0] or 0  # what a row takes besides
    if size <= broadcast_bytes:
        sent = docs.sparkSession.sparkContext.broadcast([(r["item_id"], bytes(r["text"] or b"")) for r in items.collect()])
        built: dict = {}

        def match(batch: pa.RecordBatch) -> list[pa.Array]:
            if "index" not in built:
                built["index"] = ItemIndex(sent.value, window, k)
            return _columns([built["index"].match(x.as_py()) for x in batch.column(0)])

        return with_columns_from(docs, match, HITS, {"text": as_bytes()}, keep)
    return _by_shuffle(docs, items, window, k, keep)


def _item_windows(items: DataFrame, window: int, k: int) -> DataFrame:
    """items (item_id, text) -> item_id, size, print, said (the window's words)."""

    def run(batches):
        for batch in batches:
            names, sizes, prints, said = [], [], [np.zeros(0, np.uint64)], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = alnum_words(text.as_py())
                size = min(window, len(tokens))
                if size:
                    n = len(tokens) - size + 1
                    names += [name] * n
                    sizes += [size] * n
                    prints.append(_prints(ROLLING.prefix(word_hashes(tokens)), size, window, k))
                    said += [b" ".join(tokens[i : i + size]) for i in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int32()), pa.array(np.concatenate(prints).view(np.int64)), pa.array(said, pa.binary())], names=["item_id", "size", "print", "said"])

    return items.mapInArrow(run, "item_id string, size int, print long, said binary")


def _text_prints(texts: DataFrame, sizes: list[int], window: int, k: int) -> DataFrame:
    """texts (key, text) -> key, size, print: each fingerprint of a text once."""

    def run(batches):
        for batch in batches:
            rows, kinds, prints = [], [], []
            for i, text in enumerate(batch.column(2)):
                sums = ROLLING.prefix(word_hashes(alnum_words(text.as_py())))
                for size in sizes:
                    own = np.unique(_prints(sums, size, window, k))
                    rows.append(np.full(len(own), i))
                    kinds.append(np.full(len(own), size, np.int32))
                    prints.append(own)
            if prints:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(kinds)), pa.array(np.concatenate(prints).view(np.int64))], names=[*TEXT_KEY, "size", "print"])

    return texts.mapInArrow(run, "_quarry_high long, _quarry_low long, size int, print long")


def _text_windows(texts: DataFrame, window: int, k: int) -> DataFrame:
    """texts (key, text, prints: those to look at) -> key, start, size, print, said."""

    def run(batches):
        for batch in batches:
            rows, starts, kinds, prints, said = [], [], [], [], []
            for i, (text, wanted) in enumerate(zip(batch.column(2), batch.column(3).to_pylist(), strict=True)):
                tokens = alnum_words(text.as_py())
                sums = ROLLING.prefix(word_hashes(tokens))
                for size in sorted({x["size"] for x in wanted}):
                    own = _prints(sums, size, window, k)
                    here = np.flatnonzero(_within(np.sort(np.array([x["print"] for x in wanted if x["size"] == size], np.int64).view(np.uint64)), own)).tolist()
                    rows += [i] * len(here)
                    starts += here
                    kinds += [size] * len(here)
                    prints += own[here].view(np.int64).tolist()
                    said += [b" ".join(tokens[j : j + size]) for j in here]
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(starts, pa.int32()), pa.array(kinds, pa.int32()), pa.array(prints, pa.int64()), pa.array(said, pa.binary())], names=[*TEXT_KEY, "start", "size", "print", "said"])

    return texts.mapInArrow(run, "_quarry_high long, _quarry_low long, start int, size int, print long, said binary")


def _by_shuffle(docs: DataFrame, items: DataFrame, window: int, k: int, keep: list[str]) -> DataFrame:
    of_items = cut(_item_windows(items, window, k))
    asked = of_items.select("size", "print").distinct()
    sizes = sorted(r["size"] for r in asked.select("size").distinct().collect())  # at most `window` values
    # each window with the list of its items, lists known by a key of 128 bits
    lists = of_items.groupBy("size", "print", "said").agg(F.array_sort(F.collect_set("item_id")).alias("names"))
    joined_names = F.to_json("names")
    lists = lists.withColumns({"list_high": F.xxhash64(joined_names), "list_low": F.xxhash64(F.lit(1), joined_names)})
    tagged = docs.withColumn(TEXT_KEY[0], F.xxhash64(as_bytes())).withColumn(TEXT_KEY[1], F.xxhash64(F.lit(1), as_bytes()))
    texts = tagged.select(*TEXT_KEY, as_bytes().alias("_text"))
    met = _text_prints(texts, sizes, window, k).join(asked, ["size", "print"], "left_semi")
    wanted = met.groupBy(*TEXT_KEY).agg(F.collect_set(F.struct("size", "print")).alias("prints"))
    once = texts.join(wanted, TEXT_KEY).groupBy(*TEXT_KEY).agg(F.first("_text").alias("_text"), F.first("prints").alias("prints"))
    hits = _text_windows(once, window, k).join(lists.drop("names"), ["size", "print", "said"]).select(*TEXT_KEY, "start", "size", "list_high", "list_low")
    places = hits.groupBy(*TEXT_KEY).agg(F.collect_set(F.struct("start", "size")).alias("_quarry_places"))
    named = lists.select("list_high", "list_low", "names").dropDuplicates(["list_high", "list_low"])
    names = hits.select(*TEXT_KEY, "list_high", "list_low").distinct().join(named, ["list_high", "list_low"])
    names = names.groupBy(*TEXT_KEY).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("_quarry_items"))
    joined = tagged.join(places.join(names, TEXT_KEY), TEXT_KEY, "left")

    def match(batch: pa.RecordBatch) -> list[pa.Array]:
        found = []
        for text, places, names in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            n = len(alnum_words(text.as_py()))
            hit, spans = _spans(n, *np.array([(p["start"], p["size"]) for p in places]).T) if places else (0, [])
            found.append((n, hit, names or [], spans))
        return _columns(found)

    needs: dict[str, Column] = {"text": as_bytes(), "places": F.col("_quarry_places"), "names": F.col("_quarry_items")}
    return with_columns_from(joined, match, HITS, needs, keep)
