"""Collocations by Toivonen's mining: a sample proposes phrases, full passes count them and their negative border.

A phrase is frequent only if all its shorter contiguous parts are. A sample of
the documents, by a hash, proposes what may be frequent at a lowered threshold.
A full pass then counts each word, and each longer phrase whose two parts of one
word less are proposed: these are the proposals and, of those that do not come
up to them, the negative border. Where a border phrase turns out frequent, its
extensions were not counted: it joins the proposals, and a further pass counts
what is new by it, until nothing frequent stands outside the proposals. Counts
are exact, whatever the sample is; a bad sample costs passes.

Proposals go to the tasks as a bit map of at most `most_bits`, a bound that does
not grow with the corpus. A bit set by chance only makes one more phrase counted.
Tasks count phrases of a few million words at a time, exactly, by their places in
the list of words, and send the sums with their texts; Spark adds these up by
language and phrase. No language, word or document is held in one task.

Defined cases: a null language is "und"; null and empty texts have no words; a
repeated row counts as often; an empty table gives an empty result. Texts of any
length are taken whole, in slices that end between two pieces. Only lang, text
and, to draw the sample, doc_id are read of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import LOWER, as_bytes, cut, mix

LONGEST = 4
STOP = b"."
BLANK = pa.scalar(" ", pa.large_string())
#: Lower case, tabs to spaces, and all that ends a piece to one mark, which so is in no word.
PIECES = LOWER.translate(bytes(46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256)))
SLICE = 3_000_000
ROWS = 50_000
STEP = np.uint64(0x9E3779B97F4A7C15)
ALL = ""  # the phrase that stands for all words of a language


class Marks:
    """A set of phrases as bits of their hashes, two for each; may hold some more, never less."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def empty(cls, size: int) -> Marks:
        return cls(np.zeros(size // 64, np.uint64))

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Two bit numbers for each hash, one row each."""
        size = np.uint64(64 * len(self.bits) - 1)
        return np.stack([hashes & size, mix(hashes ^ STEP) & size])

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = self.places(hashes)
        return ((self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(0)

    def joined(self, words: np.ndarray, bits: np.ndarray) -> Marks:
        out = self.bits.copy()
        out[words] |= bits
        return Marks(out)


def seed_of(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode())


def hash_words(words: pa.Array, lang: str) -> np.ndarray:
    seed = seed_of(lang)
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def longer_hash(part: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of all but its last word, and of that word."""
    return mix(part * STEP + word)


def slices(data: bytes, size: int) -> Iterator[bytes]:
    """Parts of about `size` bytes, without the marks that they end at."""
    start = 0
    while len(data) - start > size:
        end = data.rfind(STOP, start, start + size)
        end = data.find(STOP, start + size) if end < 0 else end
        if end < 0:
            break
        yield data[start:end]
        start = end + 1
    yield data[start:]


def _tokens(data: bytes) -> tuple[np.ndarray, pa.Array, int]:
    """(place in the list of words of each token, list of words, place of the mark)."""
    spaced = data.replace(STOP, b" . ") + b" . "
    whole = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(spaced)], np.int64)), pa.py_buffer(spaced)])
    said = pc.ascii_split_whitespace(whole).flatten()
    said = said.filter(pc.not_equal(said, "")).dictionary_encode()
    return said.indices.to_numpy(zero_copy_only=False), said.dictionary, pc.index(said.dictionary, ".").as_py()


def count_slice(data: bytes, lang: str, old: Marks | None, new: Marks | None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(phrases, how often) of one slice of text: with `new` longer phrases only where both parts are in it and so counted themselves, and with `old` none that a pass by `old` has counted. Without both, as of a sample, longer phrases only where both parts occur twice in the slice, for pairs any."""
    at, names, stop = _tokens(data)
    own = np.bincount(at, minlength=len(names))
    own[stop] = 0
    if old is None:
        seen = np.flatnonzero(own)
        yield pa.array([ALL]), np.array([own.sum()])
        yield names.take(pa.array(seen)), own[seen]
    hashes = word_hashes = hash_words(names, lang) if new is not None else np.zeros(len(names), np.uint64)
    words = np.arange(len(names))[None]
    last, place, earlier = words[0], at.astype(np.int64), np.ones(len(names), bool)
    place[at == stop] = -1
    n = np.zeros(0)
    for k in range(1, LONGEST):
        alive = new.has(hashes) if new is not None else np.ones(len(hashes), bool) if k == 1 else n > 1
        place = np.where((place >= 0) & alive[place], place, -1)
        both = np.flatnonzero((place[:-1] >= 0) & (place[1:] >= 0))
        code, inverse, n = np.unique((place[both] << 32) | place[both + 1], return_inverse=True, return_counts=True)
        inverse = inverse.astype(np.int32)
        if not len(code):
            return
        left, right = code >> 32, code & 0xFFFFFFFF
        words, last = np.vstack([words[:, left], last[right]]), last[right]
        told = np.arange(len(code))
        if old is not None:
            # a bit set by chance does not make up for a shorter part that `old` did not have
            earlier = earlier & old.has(hashes)
            earlier = earlier[left] & earlier[right]
            told = told[~earlier]
        for start in range(0, len(told), ROWS):
            some = told[start : start + ROWS]
            yield pc.binary_join_element_wise(*[names.take(pa.array(w[some])) for w in words], BLANK), n[some]
        hashes = longer_hash(hashes[left], word_hashes[last]) if new is not None else np.zeros(len(code), np.uint64)
        further = np.full(len(place), -1, np.int64)
        further[both] = inverse
        place = further


def count_phrases(docs: DataFrame, old: Marks | None = None, new: Marks | None = None, size: int = SLICE) -> DataFrame:
    """docs (lang, text) -> lang, phrase, n, summed over all documents."""
    context = docs.sparkSession.sparkContext
    sent = context.broadcast((old, new)) if new is not None else None

    def run(batches):
        marks = sent.value if sent else (None, None)
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def told(lang: str):
            data = b"\n".join(held.pop(lang)).translate(PIECES)
            del sizes[lang]
            for part in slices(data, size):
                for phrases, n in count_slice(part, lang, *marks):
                    for i in range(0, len(phrases), ROWS):
                        some = phrases.slice(i, ROWS).cast(pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), some, pa.array(n[i : i + ROWS].astype(np.int64))], names=["lang", "phrase", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if text:
                    held.setdefault(lang, []).append(text)
                    sizes[lang] = sizes.get(lang, 0) + len(text) + 1
                    if sizes[lang] > size:
                        yield from told(lang)
                    elif sum(sizes.values()) > 2 * size:
                        yield from told(max(sizes, key=sizes.get))
        for lang in list(held):
            yield from told(lang)

    read = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), as_bytes().alias("text"))
    return read.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def length_of(phrase: Column) -> Column:
    return F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1


def mark(found: DataFrame, marks: Marks) -> Marks | None:
    """`marks` and the phrases of `found` (lang, phrase) that can be extended; None if all of these are marked."""
    sent = found.sparkSession.sparkContext.broadcast(marks)

    def run(batches):
        marks = sent.value
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                parts = pc.split_pattern(batch.column(1).filter(pc.equal(langs.indices, i)), " ")
                said = parts.flatten().dictionary_encode()
                words = hash_words(said.dictionary, lang)[said.indices.to_numpy()]
                first, sizes = parts.offsets.to_numpy()[:-1], pc.list_value_length(parts).to_numpy()
                first = first - (first[0] if len(first) else 0)
                hashes = words[first]
                for k in range(1, LONGEST - 1):
                    more = sizes > k
                    hashes[more] = longer_hash(hashes[more], words[first[more] + k])
                places = marks.places(hashes[~marks.has(hashes)]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array((places >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (places & np.uint64(63))).view(np.int64))], names=["word", "bit"])

    short = found.where((F.col("phrase") != ALL) & (length_of(F.col("phrase")) < LONGEST)).select("lang", "phrase")
    got = short.mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # 16 bytes for each 64 bits of the map at most
    if not got.num_rows:
        return None
    return marks.joined(got.column("word").to_numpy(), got.column("bits").to_numpy().view(np.uint64))


def frequent_phrases(docs: DataFrame, least: int = 30, one_in: int = 8, most_bits: int = 1 << 28, size: int = SLICE) -> DataFrame:
    """docs (doc_id, lang, text) -> lang, phrase, n of all phrases of 1 to 4 words that occur `least` times, and of all words together as the phrase ""."""
    drawn = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(one_in)) == 0)
    lowered = max(1, -(-least // (2 * one_in)))  # half of what `least` comes to in the sample
    proposed = cut(count_phrases(drawn, size=size).where((F.col("n") >= lowered) & (F.col("phrase") != ALL)))
    bits = min(most_bits, 1 << max(16, (16 * proposed.count()).bit_length()))
    none = Marks.empty(bits)
    old, new, found = None, mark(proposed, none) or none, []
    while new is not None:
        counted = cut(count_phrases(docs, old, new, size).where((F.col("n") >= least) | (F.col("phrase") == ALL)))
        found.append(counted)
        old, new = new, mark(counted, new)  # frequent but not proposed: the border failed there
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def score_phrases(found: DataFrame, share: int = 80) -> DataFrame:
    """found (lang, phrase, n), closed under parts -> lang, phrase, a, l, r, score of phrases of two words and more that no longer one covers by `share` %.

    The score is the lowest of floor(2000000 a / (l + r)) over the cuts in two,
    of equal ones the first; products are decimals of 38 digits.
    """
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    counts = found.where(F.col("phrase") != ALL).select("lang", "phrase", F.col("n").alias("a"), length_of(F.col("phrase")).alias("words"))
    long = counts.where("words > 1")
    cuts = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "*",
        F.call_function("substring_index", "phrase", F.lit(" "), F.col("k")).alias("first"),
        F.call_function("substring_index", "phrase", F.lit(" "), F.col("k") - F.col("words")).alias("rest"),
    )
    of = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("a").alias(n))
    met = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    scored = met.withColumn("score", F.expr("(2000000BD * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"))
    worst = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut")).select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.score")
    spans = F.expr("filter(flatten(transform(sequence(0, words - 2), i -> transform(sequence(2, words - i), w -> struct(i, w)))), s -> s.w < words)")
    inner = counts.where("words > 2").select("lang", F.col("a").alias("whole"), F.split("phrase", " ").alias("said"), F.explode(spans).alias("s"))
    inner = inner.select("lang", F.array_join(F.slice("said", F.col("s.i") + 1, F.col("s.w")), " ").alias("phrase"), "whole")
    around = inner.groupBy("lang", "phrase").agg(F.max("whole").alias("whole"))
    return worst.join(around, ["lang", "phrase"], "left").where(F.col("whole").isNull() | (wide("whole") * 100 < wide("a") * share)).drop("whole")


def best_phrases(scored: DataFrame, most: int = 2000, parts: int = 16) -> DataFrame:
    """The first `most` of each language, ranked: first of each of `parts` parts of a language, then of these."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts)).alias("part")
    few = scored.select("*", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most).drop("part")


def mine_phrases(docs: DataFrame, least: int = 30, most: int = 2000) -> DataFrame:
    """docs (doc_id, lang, text) -> lang, rank, phrase, a, l, r, n, score."""
    found = cut(frequent_phrases(docs, least))
    totals = found.where(F.col("phrase") == ALL).groupBy("lang").agg(F.sum("n").alias("n"))
    best = best_phrases(score_phrases(found), most).join(totals, "lang")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])
