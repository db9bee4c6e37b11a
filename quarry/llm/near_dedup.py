"""MinHash near-duplicates with sequential Bayesian verification.

Documents with equal shingle sets are one class from the start. Bands of minhash
rows deal the classes into buckets; which pairs of a bucket are looked at, and
how far, keeps the work near the size of the groups:

1. Star: each bucket's members are compared with its hub, the member that meets
   most others. Links make components.
2. Rest: buckets whose members lie in one component are done. In the others only
   members of different components are compared, in blocks of bounded size, so
   a large bucket is many tasks; no pair but a verified link leaves a task.

A comparison looks at the signatures batch by batch and stops as soon as the
posterior probability (uniform prior) that the similarity reaches the threshold
falls under `miss`; survivors are verified exactly on their full shingle sets.
A pair at threshold t shares no band of 5 rows with probability (1 - t**5)**bands;
there are as many bands as bring that to `miss`.

Defined cases: a text with fewer words than a shingle is one shingle; texts
without words, and null texts, have none and are linked with nothing; each row
is a document of its own (ids are integers), so an id that repeats, or is null, links nothing; a
null id counts as the largest. A component has the smallest id in it as
`component_id`, one of rows without ids a negative number made from a hash of
its first text; one row of it is `kept`, the first by id and hash of the text.
If an id repeats, several components can have the same `component_id`.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import RollingHash, as_bytes, components, cut, integer_ids, ints_of, lower_words, mix, with_columns_from, word_hashes

ROLLING = RollingHash()
ROWS = 5
#: A row's key: its id and 128 bits of hash of its text.
KEY = ["_id", "_high", "_low"]
LAST = int(np.iinfo(np.int64).max)
ROW_FACTORS = mix(np.arange(1001, 1001 + ROWS, dtype=np.uint64)) | np.uint64(1)
BATCH = 24


def bands_for(threshold: float, miss: float) -> int:
    """As many as `miss` asks for, however low the threshold: some hundreds at a half, many thousands at a fifth."""
    return max(5, math.ceil(math.log(miss) / math.log1p(-(threshold**ROWS))))


@lru_cache(4)
def _hashing(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and shifts of n hash functions; those of fewer are the first of them."""
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[::2] | np.uint64(1), seeds[1::2]


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of all `size`-word shingles."""
    tokens = lower_words(text)
    if not tokens:
        return np.zeros(0, np.uint64)
    sums = ROLLING.prefix(word_hashes(tokens))
    return np.unique(ROLLING.windows(sums, min(size, len(tokens))))


def signature(items: np.ndarray, bands: int) -> np.ndarray:
    n = bands * ROWS
    factors, shifts = _hashing(n)
    out = np.full(n, 0xFFFFFFFF, np.uint64)
    step = max(1, min(1024, (1 << 20) // n))
    for i in range(0, len(items), step):
        np.minimum(out, ((items[i : i + step, None] * factors + shifts) >> np.uint64(32)).min(0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(-1, ROWS)
    return mix((rows * ROW_FACTORS).sum(1, dtype=np.uint64) + np.arange(len(rows), dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def least_matches(threshold: float, miss: float, length: int) -> list[int]:
    """For each further batch of signature bytes: with fewer matches than this, P(similarity >= threshold) < miss.

    A byte matches with p = j + (1 - j) / 256. With a uniform prior on p the
    posterior after m of n matches is a beta, and its tail from p on equals
    P(Binomial(n + 1, p) <= m).
    """
    p, out = threshold + (1 - threshold) / 256, []
    for n in range(BATCH, length + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
        out.append(m)
    return out


def _features(docs: DataFrame, size: int, n_bands: int) -> DataFrame:
    """The row's key and number, n, key of the set (128 bits, as two longs), bands."""

    def run(batch: pa.RecordBatch) -> list:
        n, high, low, bands = [], [], [], []
        for text in batch.column(0):
            items = shingles(text.as_py(), size)
            digest = np.frombuffer(xxhash.xxh3_128_digest(items.tobytes()), np.int64)
            n.append(len(items))
            high.append(int(digest[0]))
            low.append(int(digest[1]))
            bands.append(band_keys(signature(items, n_bands)).view(np.int64) if len(items) else np.zeros(0, np.int64))
        return [pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]

    return with_columns_from(docs, run, "n long, high long, low long, bands array<long>", {"text": F.col("_text")}, [*KEY, "_uid"])


def _sets(docs: DataFrame, size: int, n_bands: int) -> DataFrame:
    """_id, sig (a byte of each minhash), items (the whole sorted set, 8 bytes each)."""

    def run(batch: pa.RecordBatch) -> list:
        sig, sets = [], []
        for text in batch.column(0):
            items = shingles(text.as_py(), size)
            sig.append((signature(items, n_bands) & np.uint64(255)).astype(np.uint8).tobytes())
            sets.append(items.tobytes())
        return [pa.array(sig, pa.binary()), pa.array(sets, pa.binary())]

    return with_columns_from(docs, run, "sig binary, items binary", {"text": F.col("_text")}, ["_id"])


def _links(ids, root, left, sig, items, least, percent: int):
    """Verified links among the rows of one task, as many as join its components and no more.

    left True rows are compared with left False ones; where it is null, with all.
    """
    sig = np.frombuffer(b"".join(sig), np.uint8).reshape(len(ids), -1)
    sets = [np.frombuffer(x, np.uint64) for x in items]
    sizes = np.array([len(x) for x in sets])
    root = np.array(root)
    open_ = np.array([x is None for x in left])
    first = np.array([x is True for x in left])
    for i in np.flatnonzero(first | open_).tolist():
        others = np.flatnonzero(open_ if open_[i] else ~first)
        others = others[others > i] if open_[i] else others
        others = others[root[others] != root[i]]
        # sizes alone bound the similarity
        small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[100 * small >= percent * large]
        matches = np.zeros(len(others), np.int64)
        for b, enough in enumerate(least):
            if not len(others):
                break
            part = slice(b * BATCH, (b + 1) * BATCH)
            matches = matches + (sig[others, part] == sig[i, part]).sum(1)
            keep = matches >= enough
            others, matches = others[keep], matches[keep]
        for j in others[np.argsort(-matches, kind="stable")].tolist():
            if root[j] == root[i]:
                continue
            a, b = sets[i], sets[j]
            both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum()) if len(a) else 0
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                yield ids[i], ids[j]
                low, high = sorted((root[i], root[j]))
                root[root == high] = low


def _verify(tasks: DataFrame, sets: DataFrame, percent: int, miss: float, n_bands: int) -> DataFrame:
    """tasks (task, _id, root, left) -> verified links (src, dst). Rows come sorted by task; one task is held at a time."""
    least = least_matches(percent / 100, miss, n_bands * ROWS)
    rows = tasks.hint("merge").join(sets, "_id").select("task", "_id", "root", "left", "sig", "items")
    rows = rows.repartition("task").sortWithinPartitions("task")

    def run(batches):
        held: list[list] = [[], [], [], [], []]
        task = None

        def done():
            pairs = list(_links(*held, least, percent)) if len(held[0]) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["src", "dst"])

        for batch in batches:
            keys = ints_of(batch, "task")
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            columns = [batch.column(k).to_pylist() for k in range(1, 6)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if keys[a] != task:
                    if task is not None:
                        yield done()
                    held, task = [[], [], [], [], []], keys[a]
                for h, c in zip(held, columns, strict=True):
                    h += c[a:b]
        if task is not None:
            yield done()

    return rows.mapInArrow(run, "src long, dst long")


def _chunks(n: Column, weight: Column, rows: int, items: int) -> Column:
    return F.greatest(F.ceil(n / rows), F.ceil(weight / items)).cast("int")


def _star_tasks(members: DataFrame, rows: int, items: int) -> DataFrame:
    degree = members.groupBy("_id").agg(F.sum("size").alias("degree"))
    ranked = members.join(degree, "_id")
    # written, as a join with a scan is split at run time where a bucket or hub is hot, and one with an aggregate is not
    hubs = cut(ranked.groupBy("bucket").agg(F.min_by("_id", F.struct(-F.col("degree"), "_id")).alias("hub")))
    pairs = members.join(hubs, "bucket").where("_id <> hub").groupBy("hub", "_id").agg(F.max("n").alias("n"))
    spread = cut(pairs.groupBy("hub").agg(_chunks(F.count("*"), F.sum("n"), rows, items).alias("chunks")))
    dealt = pairs.join(spread, "hub").select("hub", "_id", F.pmod(F.xxhash64("_id"), "chunks").alias("chunk"))
    task = F.xxhash64("hub", "chunk").alias("task")
    of_hub = dealt.select("hub", "chunk").distinct().select(task, F.col("hub").alias("_id"), F.lit(True).alias("left"))
    return dealt.select(task, "_id", F.lit(False).alias("left")).unionByName(of_hub).withColumn("root", F.col("_id"))


def _rest_tasks(members: DataFrame, rows: int, items: int) -> DataFrame:
    """members (bucket, _id, n, root) -> tasks that between them compare all pairs of a bucket with different roots."""
    shares = members.groupBy("bucket", "root").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    buckets = (
        shares.groupBy("bucket")
        .agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.max(F.struct("c", "root", "w")).alias("top"), F.count("*").alias("roots"), F.sum("c").alias("c"), F.sum("w").alias("w"))
        .where("roots > 1")
        .select(
            "bucket",
            "main",
            _chunks(F.col("c"), F.col("w"), rows, items).alias("all_chunks"),
            _chunks(F.col("top.c"), F.col("top.w"), rows, items).alias("main_chunks"),
            _chunks(F.col("c") - F.col("top.c"), F.col("w") - F.col("top.w"), rows, items).alias("rest_chunks"),
        )
    )
    inside = members.join(cut(buckets), "bucket")
    main = F.col("root") == F.col("main")
    own = F.pmod(F.xxhash64("_id"), F.when(main, F.col("main_chunks")).otherwise(F.col("rest_chunks"))).cast("int")
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    task = lambda i, j, kind, left: F.struct(F.xxhash64("bucket", i, j, F.lit(kind)).alias("task"), left.alias("left"))
    no_side = F.lit(None).cast("boolean")
    single = F.array(task(F.lit(0), F.lit(0), 0, no_side))
    of_main = F.transform(upto("rest_chunks"), lambda i: task(i, F.col("own"), 1, F.lit(False)))
    of_rest = F.concat(
        F.transform(upto("main_chunks"), lambda j: task(F.col("own"), j, 1, F.lit(True))),
        F.transform(
            upto("rest_chunks"),
            lambda j: task(F.least(F.col("own"), j), F.greatest(F.col("own"), j), 2, F.when(j == F.col("own"), no_side).otherwise(F.col("own") < j)),
        ),
    )
    tasks = inside.withColumn("own", own).select(
        "_id", "root", F.explode(F.when(F.col("all_chunks") == 1, single).when(main, of_main).otherwise(of_rest)).alias("t")
    )
    return tasks.select(F.col("t.task").alias("task"), "_id", "root", F.col("t.left").alias("left"))


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    text = as_bytes()
    return integer_ids(docs).select(*more, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_id"), F.xxhash64(text).alias("_high"), F.xxhash64(F.lit(1), text).alias("_low"), text.alias("_text"))


def near_duplicates(
    docs: DataFrame, percent: int = 80, shingle: int = 5, miss: float = 1e-6, task_rows: int = 256, task_items: int = 2_000_000
) -> DataFrame:
    """docs (doc_id, text, ...) -> key (`_id`, `_high`, `_low`), n_shingles, component_id (smallest id reachable over links of `percent` or more), kept (of each component one row)."""
    texts = _keyed(docs)
    n_bands = bands_for(percent / 100, miss)
    # the rows' numbers are written with them, so they stay the same from here on
    found = cut(_features(texts.withColumn("_uid", F.monotonically_increasing_id()), shingle, n_bands))
    filled = found.where("n > 0")
    first = F.min(F.struct(*KEY, "_uid")).alias("first")
    # a class is known by the number of its first row
    classes = cut(filled.groupBy("high", "low").agg(first).select("high", "low", "first", F.col("first._uid").alias("_uid")))
    # the nodes below are classes, under the name of _id
    heads = filled.join(classes.select("_uid"), "_uid", "left_semi").select(F.col("_uid").alias("_id"), "n", F.explode("bands").alias("bucket"))
    # buckets with the same members say the same; one of them is kept
    buckets = heads.groupBy("bucket").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("_id")).alias("mark"), F.min("_id").alias("least")).where("size > 1")
    buckets = buckets.groupBy("size", "mark", "least").agg(F.min("bucket").alias("bucket")).select("bucket", "size")
    members = cut(heads.join(buckets, "bucket").select("bucket", "size", "_id", "n"))
    # by shuffle at every size: the ids wanted grow with the documents
    wanted = classes.join(members.select(F.col("_id").alias("_uid")).distinct(), "_uid", "left_semi").select("_uid", *[F.col(f"first.{c}").alias(c) for c in KEY])
    # rows of one key have the same text; the first will do
    met = texts.join(wanted.hint("merge"), KEY).groupBy(*KEY).agg(F.first("_uid").alias("_uid"), F.first("_text").alias("_text"))
    sets = cut(_sets(met.select(F.col("_uid").alias("_id"), "_text"), shingle, n_bands))
    stars = components(_verify(_star_tasks(members, task_rows, task_items), sets, percent, miss, n_bands))
    rooted = cut(members.join(stars.withColumnRenamed("node", "_id"), "_id", "left").select("bucket", "_id", "n", F.coalesce("component", "_id").alias("root")))
    rest = _verify(_rest_tasks(rooted, task_rows, task_items), sets, percent, miss, n_bands)
    links = rest.unionByName(rooted.select(F.col("_id").alias("src"), F.col("root").alias("dst")))
    joined = components(links).withColumnRenamed("node", "_uid")
    placed = cut(classes.join(joined, "_uid", "left").select("high", "low", "first", F.coalesce("component", "_uid").alias("component")))
    firsts = placed.groupBy("component").agg(F.min("first").alias("top"))
    named = placed.join(firsts, "component").select("high", "low", "top")
    rows = found.select(*KEY, "_uid", "n", "high", "low").join(named, ["high", "low"], "left")
    own = F.when(F.col("n") > 0, F.col("top")).otherwise(F.struct(*KEY, "_uid"))
    # a row without an id and without words has no component
    label = F.when(own["_id"] < LAST, own["_id"]).when(F.col("n") > 0, -F.shiftrightunsigned(own["_high"], 1) - 1)
    return rows.select(*KEY, F.col("n").alias("n_shingles"), label.alias("component_id"), (own["_uid"] == F.col("_uid")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Of each component one row, the first by id and hash of the text; texts without words all stay."""
    kept = near_duplicates(docs, percent).where("kept").select(*KEY, "n_shingles").distinct()
    keyed = _keyed(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).drop("_text")
    met = keyed.join(kept, KEY)
    # rows of one key are exact copies: one stays, but of those without words all
    apart = F.when(F.col("n_shingles") == 0, F.monotonically_increasing_id())
    return met.withColumn("_apart", apart).dropDuplicates([*KEY, "_apart"]).select("_row.*")
