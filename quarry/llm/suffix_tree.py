"""Language-model scoring with a probabilistic suffix tree.

A text is the byte string of its lower-cased words, each parted from the next by
one space, with an end mark; the model gives each byte's probability after the
bytes before it. Contexts of 1 to `depth` bytes (7 at most, as a run of a context
and the byte after it is one long) are counted over the whole training corpus. A
context is retained where its next-byte distribution differs from that of its
longest retained suffix by more than chance: N * KL divergence over `cost` *
ln(N) for each symbol seen. Distributions are smoothed (Witten and Bell, with
`trust` counts for each symbol seen) towards that suffix, down to half a count
for each of 256 bytes, so every text has a probability and those of all next
bytes sum to one. Scoring uses the longest retained suffix at each byte; the tree
holds what follows retained contexts and nothing else, so it grows with what the
corpus bears out.

The tree goes to the tasks in blocks of about `broadcast_entries`, mostly one. Of
more than one, each is a pass over the texts, which scores the bytes behind the
pairs of bytes that the block has; runs of the texts are never shuffled. Word counts, of the simple
model that the score is held against, stay distributed: only the `head_words`
most frequent words, a fixed number, go to the tasks; all others are joined.

Defined cases: null and empty texts are the end mark alone; a document repeated
in training counts as often; without training documents every byte has 1/256;
columns other than the id and the text are not read.
"""

from __future__ import annotations

import heapq
from collections import Counter
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import as_bytes, cut, lower_words, with_columns_from

END = b"\n"
FLUSH = 400_000
CHARS = 2_000_000
LONG_WORD = 32


def mask(n_bytes: int) -> int:
    return (1 << 8 * n_bytes) - 1


def runs(tokens: list[bytes], depth: int) -> np.ndarray:
    """For each byte of the text and its end mark: it and the `depth` bytes before as one number, the byte highest and the one farthest from it lowest, so that runs in order stay so when they are shortened; end marks stand before the text."""
    data = np.frombuffer(END * depth + b" ".join(tokens) + END, np.uint8).astype(np.uint64)
    out = np.zeros(len(data) - depth, np.uint64)
    for j in range(depth, -1, -1):
        out = (out << np.uint64(8)) | data[j : len(data) - depth + j]
    return out


def count_words(texts: DataFrame) -> DataFrame:
    """texts (_text) -> word, c; with the end mark as a word. Summed within tasks before the shuffle."""

    def run(batches):
        def rows(seen):
            return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(lower_words(text.as_py()))
                seen[END] += 1
                if len(seen) > FLUSH:
                    yield rows(seen)
                    seen = Counter()
        yield rows(seen)

    return texts.select("_text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _most_frequent(words: DataFrame, most: int) -> DataFrame:
    """Words of the highest counts, `most` at most: counts are binned by eighths of a power of two, and whole bins taken, so nothing is sorted in one task."""
    binned = words.where(F.octet_length("word") <= LONG_WORD).withColumn("bin", F.floor(F.log2("c") * 8))
    sizes = sorted(((r["bin"], r["count"]) for r in binned.groupBy("bin").count().collect()), reverse=True)  # some hundred rows
    least, total = None, 0
    for at, n in sizes:
        total += n
        if total > most:
            break
        least = at
    return binned.where(F.lit(False) if least is None else F.col("bin") >= least).select("word", "c")


def count_runs(texts: DataFrame, depth: int) -> DataFrame:
    """texts (_text) -> run, n: how often each `depth` + 1 bytes occur."""

    def run(batches):
        keys, counts, held, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def merge():
            new, n = np.unique(np.concatenate(held), return_counts=True)
            both, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
            return both, np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64)

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["run", "n"])

        for batch in batches:
            for text in batch.column(0):
                own = runs(lower_words(text.as_py()), depth)
                held.append(own)
                size += len(own)
                if size > CHARS:
                    keys, counts = merge()
                    held, size = [], 0
                    if len(keys) > 3 * FLUSH:
                        yield rows()
                        keys, counts = keys[:0], counts[:0]
        if held:
            keys, counts = merge()
        yield rows()

    return texts.select("_text").mapInArrow(run, "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))


def _context(run: Column, n_bytes: int) -> Column:
    """The bytes before a run's last one."""
    return run.bitwiseAND(F.lit(mask(n_bytes)))


def _shorter(run: Column, n_bytes: int = 1) -> Column:
    return F.shiftrightunsigned(run, 8 * n_bytes)


def grow(counted: DataFrame, depth: int, least: int = 2, cost: float = 0.3, trust: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """counted (run, n) -> (level, run, log_p) of every run seen after a retained context, the empty one (level 0) among them, and (level, context, log_back) of these contexts."""
    levels = [counted]
    for _ in range(depth):
        # each written once, as the next shorter one and its own join read it
        levels.insert(0, cut(levels[0].groupBy(_shorter(F.col("run")).alias("run")).agg(F.sum("n").alias("n"))))
    total = F.coalesce(F.sum("n"), F.lit(0))
    root = levels[0].withColumn("total", levels[0].agg(total).scalar())
    done = cut(root.select("run", ((F.col("n") + 0.5) / (F.col("total") + 128)).alias("p")))
    found, contexts = done.select(F.lit(0).alias("level"), "run", F.log10("p").alias("log_p")), None
    for d in range(1, depth + 1):
        grams = levels[d].select("run", "n", _context(F.col("run"), d).alias("context"), _shorter(F.col("run")).alias("up"))
        # the longer contexts of one too rare to keep are as rare, so its runs are done with
        grams = grams.join(done.select(F.col("run").alias("up"), F.col("p").alias("q")), "up")
        inside = Window.partitionBy("context")  # at most 256 rows
        grams = grams.withColumns({"total": F.sum("n").over(inside), "kinds": F.count("*").over(inside)}).where(F.col("total") >= least)
        gain = F.sum(F.col("n") * F.log(F.col("n") / F.col("total") / F.col("q"))).over(inside)
        grams = grams.withColumn("kept", gain > cost * F.col("kinds") * F.log("total"))
        pull = trust * F.col("kinds")
        smooth = (F.col("n") + pull * F.col("q")) / (F.col("total") + pull)
        level = cut(grams.select("run", "context", "kept", (pull / (F.col("total") + pull)).alias("back"), F.when(F.col("kept"), smooth).otherwise(F.col("q")).alias("p")))
        kept = level.where("kept")
        back = kept.groupBy("context").agg(F.first("back").alias("back"))
        back = back.select(F.lit(d).alias("level"), "context", F.log10("back").alias("log_back"))
        found = found.unionByName(kept.select(F.lit(d).alias("level"), "run", F.log10("p").alias("log_p")))
        contexts = back if contexts is None else contexts.unionByName(back)
        done = level.select("run", "p")
    return found, contexts


class Tree:
    """The tables of `grow` in memory, sorted, by level."""

    def __init__(self, found: pa.Table, contexts: pa.Table, depth: int, nothing: float):
        def by_level(table: pa.Table, key: str, value: str) -> list[tuple[np.ndarray, np.ndarray]]:
            level, keys, values = (table.column(c).to_numpy() for c in ("level", key, value))
            order = np.lexsort((keys.view(np.uint64), level))
            at = np.searchsorted(level[order], np.arange(depth + 2))
            keys, values = keys.view(np.uint64)[order], values[order]
            return [(keys[a:b], values[a:b]) for a, b in zip(at, at[1:], strict=False)]

        self.depth, self.nothing = depth, nothing
        self.runs, self.contexts = by_level(found, "run", "log_p"), by_level(contexts, "context", "log_back")

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = table
        if not len(keys):
            return np.zeros(len(asked), bool), np.zeros(0)
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        hit = keys[at] == asked
        return hit, values[at[hit]]

    def score(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each byte run's last byte after the others; quickest where the runs are sorted."""
        out = np.zeros(len(keys))
        left = np.arange(len(keys))
        for d in range(self.depth, -1, -1):
            here = keys[left] >> np.uint64(8 * (self.depth - d))
            seen, log_p = self._find(self.runs[d], here)
            out[left[seen]] += log_p
            left, here = left[~seen], here[~seen]
            if not len(left):
                return out
            if d:
                known, log_back = self._find(self.contexts[d], here & np.uint64(mask(d)))
                out[left[known]] += log_back
        out[left] += self.nothing
        return out


class TreeScores:
    """Scores texts one after the other, some hundred thousand bytes at a time; with `own`, only bytes behind these pairs."""

    def __init__(self, tree: Tree, own: np.ndarray | None = None):
        self.tree, self.own, self.held, self.size, self.out = tree, own, [], 0, []

    def add(self, tokens: list[bytes]) -> None:
        self.held.append(runs(tokens, self.tree.depth))
        self.size += len(self.held[-1])
        if self.size > CHARS // 4:
            self.flush()

    def flush(self) -> None:
        if self.held:
            starts = np.cumsum([0, *map(len, self.held[:-1])])
            every = np.concatenate(self.held)
            mine = slice(None) if self.own is None else self.own[(every >> np.uint64(8 * (self.tree.depth - 2))) & np.uint64(PAIRS - 1)]
            keys, where = np.unique(every[mine], return_inverse=True)
            scores = np.zeros(len(every))
            scores[mine] = self.tree.score(keys)[where]
            self.out.append(np.add.reduceat(scores, starts))
            self.held, self.size = [], 0

    def done(self) -> np.ndarray:
        self.flush()
        return np.concatenate(self.out) if self.out else np.zeros(0)


PAIRS = 1 << 16


def _pair(key: Column, level: Column) -> Column:
    """The two bytes before the predicted one, of a run or a context of a level: what a tree is dealt out by."""
    return F.call_function("shiftrightunsigned", key, level * 8 - 16).bitwiseAND(F.lit(PAIRS - 1)).cast("int")


def deal(sizes: dict[int, int], blocks: int) -> np.ndarray:
    """For each pair of bytes its block, of which each gets about as many entries: the largest first to the least filled."""
    out, filled = np.zeros(PAIRS, np.int32), [(0, b) for b in range(blocks)]
    for pair, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        held, b = heapq.heappop(filled)
        out[pair] = b
        heapq.heappush(filled, (held + n, b))
    return out


def _score_in_blocks(texts: DataFrame, found: DataFrame, contexts: DataFrame, depth: int, nothing: float, blocks: int) -> DataFrame:
    """texts (_uid, _text) -> _uid, score: one pass over the texts for each block of the tree, which scores the bytes that follow this block's pairs. Levels 0 and 1 are in every block."""
    by_pair = lambda df, key: df.withColumn("pair", F.when(F.col("level") >= 2, _pair(F.col(key), F.col("level"))))
    found, contexts = by_pair(found, "run"), by_pair(contexts, "context")
    both = found.select("pair").unionByName(contexts.select("pair")).where("pair is not null")
    block_of = deal({r["pair"]: r["count"] for r in both.groupBy("pair").count().collect()}, blocks)  # at most 65,536 rows
    passes = []
    for b in range(blocks):
        mine = texts.sparkSession.createDataFrame([(int(x),) for x in np.flatnonzero(block_of == b)], "pair int")
        part = lambda df: df.join(F.broadcast(mine), "pair", "left_semi").drop("pair").unionByName(df.where("pair is null").drop("pair")).toArrow()  # noqa: B023, E731
        sent = texts.sparkSession.sparkContext.broadcast((Tree(part(found), part(contexts), depth, nothing), block_of == b))

        def run(batch: pa.RecordBatch, sent=sent) -> list:
            tree, own = sent.value
            scores = TreeScores(tree, own)
            for text in batch.column(0):
                scores.add(lower_words(text.as_py()))
            return [pa.array(scores.done())]

        # written, so that each block is held by its own pass alone
        passes.append(cut(with_columns_from(texts, run, "part double", {"text": F.col("_text")}, ["_uid"])))
        sent.unpersist()
    return reduce(DataFrame.unionByName, passes).groupBy("_uid").agg(F.sum("part").alias("score"))


def score_texts(
    docs: DataFrame, training: Column, depth: int = 6, least: int = 2, cost: float = 0.3, trust: float = 4.0, head_words: int = 300_000, broadcast_entries: int = 8_000_000
) -> DataFrame:
    """docs (doc_id, text); `training` says which rows are learned from -> doc_id, learned, n_tokens, n_known, train_tokens, base_score, score."""
    if not 1 <= depth <= 7:
        raise ValueError("depth must be from 1 to 7")
    texts = docs.select("doc_id", F.coalesce(training, F.lit(False)).alias("learned"), as_bytes().alias("_text"))
    train = texts.where("learned")
    words = cut(count_words(train))
    sums = words.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.col("word") == F.lit(END), F.col("c")))).first()
    n_all, kinds, ends = (int(x or 0) for x in sums)
    floor = float(np.log10(n_all + 0.5 * (kinds + 1)))
    top = _most_frequent(words, head_words).toArrow()
    counted = cut(count_runs(train, depth))
    found, contexts = grow(counted, depth, least, cost, trust)
    found, contexts = cut(found), cut(contexts)
    n_runs = counted.agg(F.sum("n")).first()[0] or 0
    nothing = float(np.log10(0.5 / (n_runs + 128)))
    blocks = max(1, -(-(found.count() + contexts.count()) // broadcast_entries)) if depth > 2 else 1
    context = docs.sparkSession.sparkContext
    head = context.broadcast((top.column("word").to_pylist(), top.column("c").to_pylist()))
    tree = context.broadcast(Tree(found.toArrow(), contexts.toArrow(), depth, nothing)) if blocks == 1 else None
    made: dict = {}

    def run(batch: pa.RecordBatch) -> list:
        if "head" not in made:
            made["head"] = dict(zip(*head.value, strict=True))
        get = made["head"].get
        scores = TreeScores(tree.value) if tree else None
        n, known, base, offsets, rare = [], [], [], [0], []
        words_held, times_held = [], []

        def close():
            rare.append(pa.StructArray.from_arrays([pa.array(words_held, pa.binary()), pa.array(times_held, pa.int64())], names=["word", "times"]))
            words_held.clear()
            times_held.clear()

        for text in batch.column(0):
            own = lower_words(text.as_py())  # the words of one text at a time
            c = np.fromiter(map(get, own, repeat(-1)), np.int64, len(own))
            here = c[c >= 0]
            n.append(len(own) + 1)
            known.append(len(here) + (ends > 0))
            base.append(float(np.log10(here + 0.5).sum() + np.log10(ends + 0.5) - (len(own) + 1) * floor))
            tail = Counter(own[i] for i in np.flatnonzero(c < 0).tolist())
            words_held += tail.keys()
            times_held += tail.values()
            offsets.append(offsets[-1] + len(tail))
            if len(words_held) > 50_000:
                close()
            if scores:
                scores.add(own)
        close()
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(rare))
        return [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores.done() if scores else np.zeros(len(n))), lists]

    new = "n_tokens long, head_known long, head_base double, tree_score double, rare array<struct<word:binary,times:long>>"
    keep = ["doc_id", "learned", "_uid", *([] if blocks == 1 else ["_text"])]
    # the ids are written with the rows, so they stay the same from here on
    scored = cut(with_columns_from(texts.withColumn("_uid", F.monotonically_increasing_id()), run, new, {"text": F.col("_text")}, keep))
    rare = scored.select("_uid", F.explode("rare").alias("x")).select("_uid", F.col("x.word").alias("word"), F.col("x.times").alias("times"))
    gain = F.col("times") * (F.log10(F.col("c") + 0.5) - F.lit(float(np.log10(0.5))))
    met = rare.join(words, "word").groupBy("_uid").agg(F.sum("times").alias("rare_known"), F.sum(gain).alias("rare_gain"))
    out = scored.join(met, "_uid", "left")
    score = F.col("tree_score")
    if blocks > 1:
        out = out.join(_score_in_blocks(scored.select("_uid", "_text"), found, contexts, depth, nothing, blocks), "_uid")
        score = F.col("score")
    n_rare = F.aggregate("rare", F.lit(0).cast("long"), lambda a, x: a + x["times"])
    return out.select(
        "doc_id",
        "learned",
        "n_tokens",
        (F.col("head_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("head_base") + n_rare * F.lit(float(np.log10(0.5))) + F.coalesce("rare_gain", F.lit(0.0))).alias("base_score"),
        score.alias("score"),
    )
