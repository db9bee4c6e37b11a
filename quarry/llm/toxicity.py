"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are lower-cased words and their beginnings of 4 bytes (stems of inflected
words). Every term of two examples or more is in the vocabulary,
whatever it says about the label; a term of one example can bring no two texts
together. Weights are (1 + ln count) * idf with document frequencies over all
documents, vectors have length one.

The examples lie in an inverted index. Lists of rare terms are read whole; those
of frequent terms are cut into blocks of examples with the largest weight of
each. What the rare terms give, and the block maxima of the others, bound every
block of examples; the blocks of the highest bounds are scored first, then just
those whose bound reaches the k-th neighbour so far, so the k nearest are exact.
Votes weigh by closeness, and isotonic regression over leave-one-out votes of
the examples calibrates them.

Fitting is bounded: about `examples` labelled rows drawn by a hash of the id.
Scoring covers every whole text. Defined cases: null and empty texts, and all
texts without a term of the vocabulary, have no neighbours and get the toxic
share among such examples; equal cosines are ordered by example; a document
with several labels counts as toxic if one says so, null labels are none;
without labels of both kinds every score is 0; columns with the names of new
ones give way to them.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import alnum_words, as_bytes, cut, with_columns_from
from quarry.llm.quality import draw

BLOCK = 64
#: Lists of this share of the examples or more are cut into blocks.
FREQUENT = 0.1
BATCH = 128
STEMS = (4,)
FLUSH = 300_000


def terms_of(word: bytes) -> list[bytes]:
    return [word, *(word[:n] + b"*" for n in STEMS if len(word) > n)]


@dataclass
class Vectors:
    """Sparse rows, one behind the other: row i has ids[at[i] : at[i + 1]], ascending, and as many weights."""

    at: np.ndarray
    ids: np.ndarray
    weights: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.at))

    def take(self, order: np.ndarray) -> Vectors:
        size = np.diff(self.at)[order]
        at = np.append(0, np.cumsum(size))
        where = np.arange(at[-1]) + np.repeat(self.at[:-1][order] - at[:-1], size)
        return Vectors(at, self.ids[where], self.weights[where])


@dataclass
class Terms:
    """Vocabulary with idf; texts to sparse unit vectors."""

    vocabulary: dict[bytes, int]
    idf: np.ndarray

    def counts(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the text's terms, ascending, and how often each occurs."""
        said = Counter(alnum_words(text))
        times = np.fromiter(said.values(), np.int64, len(said))
        parts = [(np.fromiter(map(self.vocabulary.get, said, repeat(-1)), np.int64, len(said)), times)]
        for n in STEMS:
            longer = np.fromiter(map(n.__lt__, map(len, said)), bool, len(said))
            stems = [w[:n] + b"*" for w in said if len(w) > n]
            parts.append((np.fromiter(map(self.vocabulary.get, stems, repeat(-1)), np.int64, len(stems)), times[longer]))
        ids, times = (np.concatenate(x) for x in zip(*parts, strict=True))
        known = ids >= 0
        ids, where = np.unique(ids[known], return_inverse=True)
        return ids, np.bincount(where, times[known], len(ids)).astype(np.int64)

    def vectors(self, counted: list[tuple[np.ndarray, np.ndarray]]) -> Vectors:
        at = np.cumsum([0, *(len(c[0]) for c in counted)])
        ids = np.concatenate([np.zeros(0, np.int64), *(c[0] for c in counted)])
        times = np.concatenate([np.zeros(0, np.int64), *(c[1] for c in counted)])
        weights = (1 + np.log(times)) * self.idf[ids]
        rows = np.repeat(np.arange(len(counted)), np.diff(at))
        norms = np.sqrt(np.bincount(rows, weights * weights, len(counted)))
        return Vectors(at, ids, weights / norms[rows])


class BlockMaxIndex:
    """Exact k nearest of unit vectors by cosine."""

    def __init__(self, vectors: Vectors, n_terms: int):
        self.n, self.n_blocks = len(vectors), -(-len(vectors) // BLOCK)
        rows = vectors.rows()
        size = np.bincount(vectors.ids, minlength=n_terms)
        often = size >= max(BLOCK, FREQUENT * self.n)
        self.column = np.where(often, np.cumsum(often) - 1, -1)
        self.n_columns = int(often.sum())
        column = self.column[vectors.ids]
        mine = column >= 0
        # blocks of the frequent terms' lists: weight by block, term, example
        self.blocks = np.zeros((self.n_blocks, self.n_columns, BLOCK))
        self.blocks[rows[mine] // BLOCK, column[mine], rows[mine] % BLOCK] = vectors.weights[mine]
        self.block_max = self.blocks.max(2, initial=0).T
        # the other terms' lists, each whole
        order = np.lexsort((rows[~mine], vectors.ids[~mine]))
        self.list_rows, self.list_weights = rows[~mine][order], vectors.weights[~mine][order]
        self.list_at = np.append(0, np.cumsum(np.where(often, 0, size)))

    def nearest(self, queries: Vectors, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each query (example, cosine) of the k nearest with a cosine over 0, nearest first, ties by example; -1 where there are fewer. `skip` is left out."""
        n, nb = len(queries), self.n_blocks
        if not n or not nb:
            return np.full((n, k), -1), np.zeros((n, k))
        asked, column = queries.rows(), self.column[queries.ids]
        dense = np.zeros((n, self.n_columns))
        dense[asked[column >= 0], column[column >= 0]] = queries.weights[column >= 0]
        rare = column < 0
        start, end = self.list_at[queries.ids[rare]], self.list_at[queries.ids[rare] + 1]
        length = end - start
        ends = np.cumsum(length)
        post = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + length, length)
        cell = self.list_rows[post] + np.repeat(asked[rare] * (nb * BLOCK), length)
        score = np.bincount(cell, self.list_weights[post] * np.repeat(queries.weights[rare], length), n * nb * BLOCK).astype(np.float64).reshape(n, nb, BLOCK)  # of no posting it counts in integers
        bound = score.max(2) + dense @ self.block_max
        if skip is not None:
            score[np.arange(n), skip // BLOCK, skip % BLOCK] = -np.inf
        first = min(nb, -(-k // BLOCK) + 2)
        best = np.argpartition(-bound, first - 1, axis=1)[:, :first]
        done = np.zeros((n, nb), bool)
        np.put_along_axis(done, best, True, 1)
        self._add(score, dense, done)
        so_far = np.take_along_axis(score, best[:, :, None], 1).reshape(n, -1)
        least = np.partition(so_far, -k, axis=1)[:, -k] if so_far.shape[1] > k else np.full(n, -1.0)
        more = ~done & (bound >= least[:, None] - 1e-9)
        self._add(score, dense, more)
        score[~(done | more)] = -1
        flat = score.reshape(n, -1)
        least = np.partition(flat, -k, axis=1)[:, -k] if flat.shape[1] > k else np.full(n, -1.0)
        query, row = np.nonzero((flat >= least[:, None] - 1e-11) & (flat > 1e-12))
        value = flat[query, row]
        order = np.lexsort((row, -np.round(value, 12), query))
        query, row, value = query[order], row[order], value[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        query, row, value, place = (x[place < k] for x in (query, row, value, place))
        near, cosine = np.full((n, k), -1), np.zeros((n, k))
        near[query, place], cosine[query, place] = row, value
        return near, cosine

    def _add(self, score: np.ndarray, dense: np.ndarray, wanted: np.ndarray) -> None:
        """Adds what the frequent terms give, in the wanted blocks."""
        for b in np.flatnonzero(wanted.any(0)).tolist():
            q = np.flatnonzero(wanted[:, b])
            score[q, b] += dense[q] @ self.blocks[b]


def _isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit of y on x (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        pools.append([b, 1.0, a, a])
        while len(pools) > 1 and (pools[-2][0] >= pools[-1][0] or pools[-2][3] == pools[-1][2]):
            s, n, low, high = pools.pop()
            p = pools[-1]
            p[0], p[1], p[3] = (p[0] * p[1] + s * n) / (p[1] + n), p[1] + n, high
    return np.array([v for p in pools for v in (p[2], p[3])]), np.array([v for p in pools for v in (p[0], p[0])])


@dataclass
class Model:
    terms: Terms
    examples: Vectors
    doc_ids: list
    toxic: np.ndarray
    k: int
    without: float = 0.0
    knots: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    index: BlockMaxIndex | None = None
    names: list[bytes] | None = None

    def __getstate__(self):
        """What is sent to the tasks: each builds the index again, which is larger than the vectors it is made from."""
        return self.__dict__ | {"index": None, "names": None}

    def votes(self, queries: Vectors, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each query the neighbours' vote (-1 where it has none), and the neighbours."""
        if self.index is None:
            self.index = BlockMaxIndex(self.examples, len(self.terms.vocabulary))
        near, cosine = self.index.nearest(queries, self.k, skip)
        weight = np.where(near >= 0, 1 / (1.05 - np.minimum(cosine, 1.0)), 0.0)
        total = weight.sum(1)
        return np.where(total > 0, (weight * self.toxic[near]).sum(1) / np.where(total > 0, total, 1), -1.0), near

    def score(self, texts: list[bytes | None]) -> list[tuple[float, list, list[str]]]:
        """For each text its probability, the ids of the five nearest examples, and its terms of most weight."""
        if self.names is None:
            self.names = list(self.terms.vocabulary)
        out = []
        for i in range(0, len(texts), BATCH):
            queries = self.terms.vectors([self.terms.counts(t) for t in texts[i : i + BATCH]])
            votes, near = self.votes(queries)
            known = np.clip(np.interp(votes, *self.knots), 0, 1)
            for j, (vote, probability, five) in enumerate(zip(votes.tolist(), known.tolist(), near[:, :5].tolist(), strict=True)):
                if vote < 0:
                    out.append((self.without, [], []))
                    continue
                mine = slice(queries.at[j], queries.at[j + 1])
                heavy = queries.ids[mine][np.argsort(-queries.weights[mine], kind="stable")[:3]].tolist()
                out.append((probability, [self.doc_ids[x] for x in five if x >= 0], [self.names[x].decode("utf-8", "replace") for x in heavy]))
        return out


def _vocabulary(rows: DataFrame, least: int = 2) -> dict[bytes, int]:
    """Terms of `least` rows (text) or more, in order; counted within batches before the shuffle."""

    def run(batches):
        def flush(seen):
            return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update({t for w in set(alnum_words(text.as_py())) for t in terms_of(w)})
                if len(seen) > FLUSH:
                    yield flush(seen)
                    seen = Counter()
        yield flush(seen)

    counted = rows.select(as_bytes().alias("text")).mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    # bounded by the examples
    return {t: i for i, t in enumerate(sorted(counted.where(F.col("n") >= least).select("term").toArrow().column("term").to_pylist()))}


def _document_frequencies(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, np.ndarray]:
    """Number of documents, and of those with each term of the vocabulary; over all documents."""
    size = len(vocabulary)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by the examples

    def run(batches):
        terms = Terms(sent.value, np.zeros(size))
        found = np.zeros(size + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                found[terms.counts(text.as_py())[0]] += 1
            found[size] += batch.num_rows
        have = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(found[have])], names=["term", "n"])

    counted = docs.select(as_bytes().alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size + 1, np.int64)
    out[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
    return int(out[size]), out[:size]


def train(docs: DataFrame, labels: DataFrame, allowed: Column, examples: int = 4_000, k: int = 100) -> Model | None:
    """labels (doc_id, toxic) where `allowed` (a condition on doc_id) says they may be learned from."""
    known = labels.where(allowed & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = cut(draw(docs.select("doc_id", "text").join(F.broadcast(draw(known, examples, 3)), "doc_id"), examples, 3))  # ids may have any number of rows
    kinds = {r["toxic"] for r in rows.select("toxic").distinct().collect()}
    if len(kinds) < 2:
        return None
    vocabulary = _vocabulary(rows)
    n, frequency = _document_frequencies(docs, vocabulary)
    terms = Terms(vocabulary, np.log((n + 1) / (frequency + 1)) + 1)
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def counts(batch: pa.RecordBatch) -> list:
        found = [sent.value.counts(t.as_py()) for t in batch.column(0)]
        return [pa.array([c[i].astype(np.int32) for c in found], pa.list_(pa.int32())) for i in (0, 1)]

    got = with_columns_from(rows, counts, "ids array<int>, times array<int>", {"text": as_bytes()}, ["doc_id", "toxic"]).toArrow()
    ids, times = ([x.values.to_numpy() for x in got.column(c)] for c in ("ids", "times"))
    vectors, doc_ids, toxic = terms.vectors(list(zip(ids, times, strict=True))), got.column("doc_id").to_pylist(), got.column("toxic").to_numpy().astype(np.float64)
    order = _alike(vectors, doc_ids, len(vocabulary))
    bare = np.diff(vectors.at)[order] == 0
    share = toxic[order][bare] if bare.any() else toxic
    order = order[~bare]
    model = Model(terms, vectors.take(order), [doc_ids[i] for i in order.tolist()], toxic[order], k, float((share.sum() + 0.5) / (len(share) + 1)))
    votes = np.concatenate([np.zeros(0), *(model.votes(model.examples.take(part), part)[0] for part in np.split(np.arange(len(order)), range(BATCH, len(order), BATCH)))])
    if (votes >= 0).any():
        model.knots = _isotonic(votes[votes >= 0], model.toxic[votes >= 0])
    return model


def _alike(vectors: Vectors, doc_ids: list, n_terms: int) -> np.ndarray:
    """Order of the rows in which those that agree in their heaviest frequent terms, as texts of one language do, lie together, which makes block maxima tight."""
    often = np.bincount(vectors.ids, minlength=n_terms) >= max(2, FREQUENT * len(vectors))
    rows, mine = vectors.rows(), often[vectors.ids]
    ranked = np.lexsort((vectors.ids[mine], -vectors.weights[mine], rows[mine]))
    rows, ids = rows[mine][ranked], vectors.ids[mine][ranked]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    leads = np.full((3, len(vectors)), -1, np.int64)
    for i, lead in enumerate(leads):
        lead[rows[place == i]] = ids[place == i]
    by_id = np.array(sorted(range(len(doc_ids)), key=doc_ids.__getitem__), np.int64)
    return by_id[np.lexsort(leads[::-1][:, by_id])]


def score_toxicity(docs: DataFrame, model: Model | None, threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """Adds `score`, `predicted`, and the evidence: `examples` (nearest ids) and `terms`."""
    keep = docs.columns if keep is None else keep
    new = f"score double, predicted int, examples array<{docs.schema['doc_id'].dataType.simpleString()}>, terms array<string>"
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by `examples`

    def run(batch: pa.RecordBatch) -> list:
        model = sent.value
        texts, kind = batch.column(0), batch.schema.types[1]
        found = []
        for i in range(0, len(texts), BATCH):
            part = [t.as_py() for t in texts[i : i + BATCH]]
            found += model.score(part) if model else repeat((0.0, [], []), len(part))
        scores = np.array([f[0] for f in found], np.float64)
        return [pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array([f[1] for f in found], pa.list_(kind)), pa.array([f[2] for f in found], pa.list_(pa.string()))]

    return with_columns_from(docs, run, new, {"text": as_bytes(), "id": F.col("doc_id")}, keep)
