"""Each operator against a plain version of what it has to compute, with nulls, empties, ties, repeats and empty tables."""

import collections
import hashlib
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import chat, decontamination, media, near_dedup, packing, substring_dedup, suffix_tree, url_reputation
from quarry.llm.common import components

DOCS = "doc_id long, text string, source string, n_words string, _text int"  # two names clash with new columns


def make(spark, texts):
    return spark.createDataFrame([(i, t, "s", "old", 1) for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def corpus():
    """Random prose with copies, near copies, shared passages, nulls, empties and one long text."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["Ünder", "Naïve", "x"]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    passage = say(70)
    texts = []
    for i in range(90):
        w = say(rng.choice([3, 20, 60, 120, 200]))
        if i % 4 == 0:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[: rng.choice([49, 50, 70])]
        texts.append(" ".join(w))
    for i in range(40):
        w = texts[i % 12].split()
        for _ in range(rng.choice([0, 1, 2, 8])):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append("\n".join(w) if i % 3 else " ".join(w).upper())
    texts += [None, "", " \t\n", "one", "one", "ab " * 400, "ab " * 300, " ".join(say(6000)), "tail\u00a0word \x1c x"]
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


def split(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def low(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_substring_dedup(spark, corpus):
    first, expected = {}, {}
    for i, t in corpus:
        w = split(t)
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), i)
    for i, t in corpus:
        w = split(t)
        hit = {k for j in range(len(w) - 49) if first[tuple(w[j : j + 50])] < i for k in range(j, j + 50)}
        expected[i] = (len(w), len(hit), " ".join(x for k, x in enumerate(w) if k not in hit))
    assert sum(e[1] for e in expected.values()) > 500
    docs = make(spark, corpus).repartition(3)
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs, digest=True).collect()}
    for i, (n, gone, kept) in expected.items():
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())
    texts = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(docs).collect()}
    assert texts[corpus[0][0]] == corpus[0][1] and all(split(texts[i]) == expected[i][2].split(" ") for i in texts if expected[i][1] and expected[i][2])
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_substring_dedup_knows_rows_without_an_id_and_of_equal_ids_apart(spark):
    say = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    clean, other = say("clean", 80), say("other", 80)
    rows = [(1, say("p", 60)), (7, say("x", 5) + " " + say("p", 60)), (7, clean), (None, say("p", 60) + " tail"), (None, other), (None, None)]
    rows += [(None, say("both", 55) + " a"), (None, "b " + say("both", 55)), (None, say("same", 51)), (None, say("same", 51)), (None, "short"), (None, "short")]
    got = substring_dedup.remove_repeats(make(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows) and all(r["n_removed"] <= r["n_words"] for r in got)
    left = collections.Counter((r["doc_id"], r["text"], r["n_removed"]) for r in got)
    assert left[7, say("x", 5), 60] == left[7, clean, 0] == left[None, "tail", 60] == left[None, other, 0] == left[None, None, 0] == 1
    assert left[None, say("same", 51), 0] == left[None, "", 51] == 1 and left[None, "short", 0] == 2
    assert left[None, "a", 55] + left[None, "b", 55] == 1


def test_near_duplicates(spark, corpus):
    sets = {}
    for i, t in corpus:
        w = split(low(t))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    for percent in (85, 60):
        root = {i: i for i in sets}

        def find(x):
            return x if root[x] == x else find(root[x])

        ids = sorted(sets)
        for a in ids:
            for b in ids:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
        assert len({find(i) for i in ids}) < len(ids) - 10
        found = near_dedup.near_duplicates(make(spark, corpus), percent=percent, task_rows=4)  # small tasks: all kinds of them run
        got = {r["_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()}
        assert got == {i: (len(sets[i]), find(i)) for i in ids}
    assert near_dedup.drop_near_duplicates(make(spark, corpus)).columns == make(spark, corpus).columns
    assert near_dedup.near_duplicates(make(spark, [])).count() == 0
    twice = near_dedup.near_duplicates(make(spark, [(1, "a b c d e f"), (1, "u v w x y z"), (2, "u v w x y z"), (None, "a b c d e f")]))
    assert {r["component_id"] for r in twice.collect()} == {1}


def test_near_duplicates_of_rows_without_an_id_and_of_equal_ids(spark):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(12)) for x in "abcde")
    rows = [(5, a), (9, b), (None, a), (None, b), (None, c), (None, c), (None, d), (3, e), (3, e), (3, "x y z"), (4, "x y z"), (None, None), (None, ""), (8, ""), (8, "")]
    found = near_dedup.near_duplicates(make(spark, rows).repartition(3)).collect()
    assert len(found) == len(rows)
    groups = collections.Counter(r["component_id"] for r in found)
    assert groups[5] == groups[9] == 2 and groups[3] == 4 and groups[8] == 2 and groups[None] == 2
    assert sorted(n for i, n in groups.items() if i is not None and i < 0) == [1, 2]
    left = collections.Counter((r["doc_id"], r["text"]) for r in near_dedup.drop_near_duplicates(make(spark, rows)).collect())
    assert left == {(5, a): 1, (9, b): 1, (None, c): 1, (None, d): 1, (3, e): 1, (3, "x y z"): 1, (None, None): 1, (None, ""): 1, (8, ""): 2}
    assert sum(r["kept"] for r in found) == sum(left.values())


def test_decontamination_by_broadcast_and_by_shuffle(spark, corpus):
    texts = dict(corpus)
    w = texts[1].split()
    items = [(1, " ".join(w[5:25])), (2, "Ünder, NAÏVE"), (3, None), (4, "--"), (1, "one"), (7, " ".join(texts[4].split()[:9])), (None, "ab ab ab")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = collections.defaultdict(set)
    for name, t in items:
        v = pattern.findall(low(t))
        for j in range(len(v) - min(10, len(v)) + 1 if v else 0):
            windows[tuple(v[j : j + min(10, len(v))])].add(name)
    for limit in (1 << 20, 0):
        found = decontamination.find_contamination(make(spark, corpus), bench, broadcast_bytes=limit)
        assert "n_words" in found.columns and "source" in found.columns
        got = {r["doc_id"]: r for r in found.collect()}
        for i, t in corpus:
            v = pattern.findall(low(t))
            hit, names = set(), set()
            for m in {len(k) for k in windows}:
                for j in range(len(v) - m + 1):
                    if tuple(v[j : j + m]) in windows:
                        hit |= set(range(j, j + m))
                        names |= windows[tuple(v[j : j + m])]
            r = got[i]
            assert (r["n_words"], r["n_hit"], r["items"]) == (len(v), len(hit), sorted(str(x) for x in names if x is not None))
            assert sum(s["end"] - s["start"] for s in r["spans"]) == len(hit)
    assert decontamination.find_contamination(make(spark, corpus), bench.limit(0)).where("n_hit > 0").count() == 0


def byte_tokens():
    """Made inside the function, as executors cannot import this file."""

    class Bytes:
        def encode(self, text):
            return np.frombuffer(text.encode(), np.uint8).astype("<u4").tobytes()

    return lambda: Bytes()


def test_packing(spark, corpus):
    cap = 64
    got = packing.pack_documents(make(spark, [*corpus, corpus[0]]), byte_tokens(), capacity=cap).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    ids = {i: np.array([*(t or "").encode(), 0], "<u4") for i, t in corpus}
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"] and (r["piece"] == 0 or r["length"] == cap)
    rows = collections.defaultdict(list)
    for r in got:
        rows[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in rows.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)])]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= cap
    assert len(rows) <= -(-sum(r["length"] for r in got) // cap) + 2
    assert packing.pack_documents(make(spark, []), byte_tokens(), capacity=cap).count() == 0


def test_packing_plan_uses_every_piece_once():
    rng = random.Random(2)
    for cap in (16, 100):
        counts = collections.Counter(rng.randrange(1, cap + 1) for _ in range(3000))
        plan = packing.plan(counts, cap)
        used = collections.Counter()
        for lengths, n in plan:
            assert sum(lengths) <= cap
            for x in lengths:
                used[x] += n
        assert used == counts
        tight = max(-(-sum(k * n for k, n in counts.items()) // cap), sum(n for k, n in counts.items() if 2 * k > cap))
        assert sum(n for _, n in plan) <= tight * 1.03 + 2
        assert sum(n for _, n in plan) <= best_fit_decreasing(counts, cap)


def best_fit_decreasing(counts, cap):
    """Number of sequences, piece by piece."""
    rooms = collections.Counter()
    for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        room = min((r for r, n in rooms.items() if n and r >= length), default=None)
        if room is None:
            room = cap
        else:
            rooms[room] -= 1
        rooms[room - length] += 1
    return sum(rooms.values())


@pytest.mark.parametrize("sf,most", [("sf0.001", None), ("sf0.01", 481), ("sf0.1", 4936)])
def test_packing_is_never_above_best_fit_decreasing(spark, sf, most):
    documents = Path(f"/root/testdata/{sf}/documents.parquet")
    if not documents.exists():
        pytest.skip("no test tables")
    parts = packing.pieces(spark.read.parquet(str(documents)), packing.public_tokens())
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    used = sum(n for _, n in packing.plan(counts, 2048))
    assert used <= best_fit_decreasing(counts, 2048) and (most is None or used <= most)


def test_public_tokens_equal_the_whole_encoding(corpus):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    ours = packing.public_tokens()()
    odd = ["", " a", "a ", "a  b", "a \nb", "x\n y", "don't 12 34!!", "a\u00a0b c", "<|endoftext|> x", "\t a", "é ü  ", "a\u2003 b", " ", "\n"]
    for text in [*odd, *(t for _, t in corpus if t)]:
        assert ours.encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_suffix_tree(spark, corpus):
    docs = make(spark, corpus)
    train = F.col("doc_id") % 5 != 1
    runs = [suffix_tree.score_texts(docs, train, depth=3, broadcast_entries=limit, head_words=head) for limit, head in ((1 << 20, 20), (8000, 1000))]
    a, b = ({r["doc_id"]: r for r in df.collect()} for df in runs)
    counts = collections.Counter()
    for i, t in corpus:
        if i % 5 != 1:
            counts.update([*split(low(t)), "\n"])
    n, kinds = sum(counts.values()), len(counts)
    for i, t in corpus:
        tokens = [*split(low(t)), "\n"]
        base = sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (kinds + 1))) for w in tokens)
        r = a[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(w in counts for w in tokens), n)
        assert abs(r["base_score"] - base) < 1e-6 and r["score"] < 0
        assert abs(b[i]["score"] - r["score"]) < 1e-8 and abs(b[i]["base_score"] - base) < 1e-6
    held = [r for r in a.values() if not r["learned"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) * 1.2
    empty = suffix_tree.score_texts(docs, F.lit(False)).where("doc_id = 1").first()
    assert empty["train_tokens"] == 0 and abs(empty["score"] + np.log10(256) * len(" ".join(split(corpus[0][1])).encode() + b"\n")) < 1e-6


def plain_tree(texts, depth, least, cost, trust):
    """log10 probability of a text under a suffix tree grown from `texts`, by its definition: dicts of counts, contexts kept by recursion from the shortest."""
    counts = collections.defaultdict(collections.Counter)

    def steps(text):
        data = b"\n" * depth + b" ".join(low(text).encode().split()) + b"\n"
        return [(data[i - depth : i], data[i]) for i in range(depth, len(data))]

    for t in texts:
        for before, byte in steps(t):
            for d in range(depth + 1):
                counts[before[depth - d :]][byte] += 1
    all_ = sum(counts[b""].values())
    kept = {}

    def p(context, byte):
        if not context:
            return (counts[b""][byte] + 0.5) / (all_ + 128)
        q = p(context[1:], byte)
        if not keeps(context):
            return q
        total, kinds = sum(counts[context].values()), len(counts[context])
        return (counts[context][byte] + trust * kinds * q) / (total + trust * kinds)

    def keeps(context):
        if context not in kept:
            seen = counts.get(context)
            total = sum(seen.values()) if seen else 0
            kept[context] = total >= least and sum(n * np.log(n / total / p(context[1:], c)) for c, n in seen.items()) > cost * len(seen) * np.log(total)
        return kept[context]

    return lambda text: sum(np.log10(p(before, byte)) for before, byte in steps(text))


def test_suffix_tree_scores_are_those_of_a_plain_one(spark):
    rng = random.Random(6)
    words = ["ab", "abc", "the", "there", "b\u00fc", "\u6f22"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for i in range(60)] + [(60, None), (61, ""), (62, "Zq"), (62, "Zq"), (None, "the AB")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("score", F.lit("old"))
    for depth in (6, 7):
        plain = plain_tree([t or "" for i, t in texts if i is not None and i % 3], depth, 2, 0.3, 4.0)
        for limit in (1 << 20, 120):
            found = suffix_tree.score_texts(docs, F.col("doc_id") % 3 != 0, depth=depth, broadcast_entries=limit).collect()
            got = collections.defaultdict(list)
            for r in found:
                got[r["doc_id"]].append(r["score"])
            assert len(found) == len(texts)
            for i, t in texts:
                assert got[i] == pytest.approx([plain(t or "")] * len(got[i]), abs=1e-8)
    assert suffix_tree.score_texts(docs.limit(0), F.lit(True)).count() == 0
    with pytest.raises(ValueError):
        suffix_tree.score_texts(docs, F.lit(True), depth=8)


def test_suffix_tree_probabilities_sum_to_one(spark, corpus):
    texts = make(spark, corpus).select(F.coalesce("text", F.lit("")).cast("binary").alias("_text"))
    counted = suffix_tree.count_runs(texts, 3).persist()
    found, contexts = suffix_tree.grow(counted, 3)
    total = counted.agg(F.sum("n")).first()[0]
    tree = suffix_tree.Tree(found.toArrow(), contexts.toArrow(), 3, float(np.log10(0.5 / (total + 128))))
    assert sum(len(keys) for keys, _ in tree.contexts) > 20
    for before in (b"w12", b"\n\n\n", b"zzz", b" w1"):
        keys = np.array([int.from_bytes(before + bytes([c]), "little") for c in range(256)], np.uint64)
        assert abs((10 ** tree.score(keys)).sum() - 1) < 1e-6


PNG = bytes.fromhex("89504e470d0a1a0a0000000d4948445200000001000000010802000000907753de0000000c4944415408d763f8cfc000000301010018dd8db00000000049454e44ae426082")
GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff\x2c\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02\x44\x01\x00\x3b"


def wave(samples):
    pad = b"\0" * (len(samples) % 2)
    return b"RIFF" + (36 + len(samples) + len(pad)).to_bytes(4, "little") + b"WAVEfmt " + bytes.fromhex("1000000001000100401f0000401f000001000800") + b"data" + len(samples).to_bytes(4, "little") + samples + pad


def test_media(spark):
    import gzip
    import io
    import zipfile

    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a", "b" * 50)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02\x12\xff\x00\x34\xff\xd9"
    page = b"<p>" + PNG + b"BM no" + GIF + jpeg + gzip.compress(b"x" * 99) + packed.getvalue() + wave(b"abc") + pdf()
    values = [("a", "image/gif", PNG), ("b", "text/html", page), ("c", "image/png", PNG[:-5]), ("d", "x", b""), ("e", None, None), ("f", "text/plain", wave(b"..." + GIF))]
    df = spark.createDataFrame(values, "id string, declared string, media binary")
    found = media.sniff(df, "media", "declared")
    got = {r["id"]: r for r in found.collect()}
    assert (got["a"]["corrected_type"], got["a"]["sniffed"]["length"]) == ("image/png", len(PNG))
    assert got["b"]["corrected_type"] == "text/html"
    kinds = ["image/png", "image/gif", "image/jpeg", "application/gzip", "application/zip", "audio/wav", "application/pdf"]
    assert [s["type"] for s in got["b"]["sniffed"]["embedded"]] == kinds
    assert not got["c"]["sniffed"]["valid"] and got["c"]["corrected_type"] == "image/png" and not got["d"]["sniffed"]["valid"] and got["e"]["corrected_type"] is None
    carved = {(r["id"], r["carved_type"]): bytes(r["carved"]) for r in media.carve(found, "media").collect()}
    assert carved["b", "image/png"] == PNG and carved["b", "image/gif"] == GIF and carved["b", "image/jpeg"] == jpeg and carved["f", "image/gif"] == GIF
    built = spark.createDataFrame([(b"abc",), (b"",), (b"x" * 300,)], "d binary").select("d", media.as_wave(F.col("d")).alias("w"), media.padded(F.col("d")).alias("p"))
    for r in built.collect():
        assert bytes(r["w"]) == wave(bytes(r["d"])) and len(r["p"]) % 64 == 0 and len(r["p"]) >= 64 and bytes(r["p"]).startswith(bytes(r["d"]))


def pdf(body=b"", revisions=1):
    out = b"%PDF-1.4\n" + body
    for i in range(revisions):
        at = len(out)
        out += b"xref\n0 1\ntrailer <<>>\nstartxref\n%d\n%%%%EOF\n" % at + (PNG if i + 1 < revisions else b"")
    return out[:-1]


def test_media_to_the_last_end_mark():
    import io
    import zipfile

    def spans(data):
        found = media.sniff_bytes(data)
        return found["valid"] * found["length"], [(s["start"], s["length"]) for s in found["embedded"]]

    saved = pdf(revisions=3)
    assert spans(saved) == (len(saved), [])
    linear = b"%PDF-1.5\n1 0 obj\nstartxref\n0\n%%EOF\n" + PNG + b"xref\nstartxref\n9\n%%EOF"
    assert spans(linear) == (len(linear), [])
    # one behind the other, and one attached to the other
    assert spans(saved + saved) == (len(saved), [(len(saved), len(saved))])
    assert spans(saved + PNG + pdf()) == (len(saved), [(len(saved), len(PNG)), (len(saved) + len(PNG), len(pdf()))])
    first = pdf()
    attached = first + b"\nstream " + pdf(b"% inner\n") + b"\nendstream "
    attached += b"xref\nstartxref\n%d\n%%%%EOF" % len(attached)
    assert spans(attached) == (len(attached), [])

    def packed(name, data):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(name, data)
        return out.getvalue()

    outer = packed("outer", packed("inner", packed("a", b"b" * 50)))
    assert spans(outer) == (len(outer), [])
    assert spans(b"." + outer + outer) == (0, [(1, len(outer)), (1 + len(outer), len(outer))])
    assert spans(outer[:-30])[0] == 0


def test_prose_about_pdf_is_no_pdf():
    said = b"%PDF-1.4 is followed by startxref and %%EOF at the end."
    for data in (said, b"x" + said, b"%PDF-1.4 startxref 3 %%EOF", b"%PDF-1.4 startxref 99999 %%EOF xref"):
        found = media.sniff_bytes(data)
        assert not found["valid"] and not found["embedded"]
    assert media.sniff_bytes(said + pdf())["embedded"] == [{"start": len(said), "length": len(pdf()), "type": "application/pdf"}]


def test_many_pdfs_take_no_square_of_time():
    import time

    took = []
    for n in (1000, 8000):
        began = time.perf_counter()
        found = media.sniff_bytes(pdf() * n)
        took.append(time.perf_counter() - began)
        assert found["length"] == len(pdf()) and len(found["embedded"]) == n - 1
    assert took[1] < 8 * took[0] * 3 + 0.5


def test_media_of_an_empty_table(spark):
    none = spark.createDataFrame([], "data binary, kind string")
    found = media.sniff(none, "data", "kind")
    assert found.collect() == [] and media.carve(found, "data").collect() == []


def test_media_of_many_marks_takes_no_square_of_time():
    import time

    text = b"%PDF-1.4 PK\x03\x04 startxref x PK\x05\x06 " * 20_000
    began = time.time()
    assert media.sniff_bytes(text)["embedded"] == []
    assert time.time() - began < 10


def test_ids_of_other_types_are_refused(spark):
    docs = spark.createDataFrame([("a", "some words")], "doc_id string, text string")
    for run in (near_dedup.near_duplicates, near_dedup.drop_near_duplicates, substring_dedup.remove_repeats):
        with pytest.raises(TypeError):
            run(docs)


def test_media_at_block_edges():
    for at in (media.BLOCK - 3, media.BLOCK, media.BLOCK + 1):
        found = media.sniff_bytes(b"." * at + PNG)
        assert [(s["start"], s["length"]) for s in found["embedded"]] == [(at, len(PNG))]


def test_chat(spark):
    said = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|end|>"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, None, "?"), (2, 0, "system", "alone"), (None, 0, "ann", "x"), (3, None, "ann", "first"), (3, 300, "bob", "late")]
    views = chat.rotate_perspectives(spark.createDataFrame(said, "conv_id long, turn long, role string, text string"))
    got = {(r["conv_id"], r["speaker"], r["part"]): r for r in views.collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (1, "unknown", 0), (None, "ann", 0), (3, "ann", -1), (3, "bob", -1), (3, "ann", 1), (3, "bob", 1)}
    ann = got[1, "ann", 0]
    assert ann["rendered"] == "<|system|>\nBe kind.<|end|>\n<|assistant|>\nHi < |end|><|end|>\n<|user:bob|>\n<|end|>\n<|user:unknown|>\n?<|end|>\n"
    assert [ann["rendered"][s["start"] : s["end"]] for s in ann["train_spans"]] == ["Hi < |end|><|end|>"]
    assert (ann["n_turns"], ann["n_trained"], got[1, "bob", 0]["n_trained"], got[3, "ann", 1]["n_trained"]) == (4, 1, 1, 0)
    alike = [(1, 0, "a|b", "x"), (1, 1, "a_b", "y"), (1, 2, "a%7Cb", "z"), (1, 3, "<\n>", "w " * 200_000)]
    odd = chat.rotate_perspectives(spark.createDataFrame(alike, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("old"))).collect()
    assert {r["speaker"]: r["n_trained"] for r in odd} == {"a%7Cb": 1, "a_b": 1, "a%257Cb": 1, "%3C%0A%3E": 1}
    assert all(len(r["rendered"]) > 400_000 for r in odd)
    assert chat.rotate_perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_urls(spark):
    urls = [(1, "HTTP://A.Bad.COM/de/x?y"), (2, "https://bad.com/fr/#z"), (3, "http://good.com"), (4, None), (5, "nothing"), (6, "x://a.org/://b.com/q"), (7, "http://bad.com?de/")]
    urls += [(100 + i, f"http://s{i % 5}.bad.com/p{i}") for i in range(50)] + [(200 + i, f"http://good.com/{i}") for i in range(50)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    outcomes = spark.createDataFrame([(i, 1) for i in range(100, 145)] + [(i, 0) for i in range(200, 245)] + [(9999, 1), (3, None)], "page_id long, bad int")
    rules = [("block", "com/de/"), ("allow", "bad.com/d"), ("allow", "com/fr/"), ("block", "org/")]
    got = {r["page_id"]: r for r in url_reputation.judge_urls(pages, outcomes, rules).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.bad.com", "/de/x", "bad.com/d", "allow")
    assert (got[2]["rule"], got[7]["path"], got[7]["rule"], got[3]["path"]) == ("com/fr/", "", None, "")
    assert (got[6]["host"], got[6]["path"], got[6]["verdict"]) == ("a.org", "/://b.com/q", "block")
    assert (got[4]["host"], got[5]["host"]) == ("", "")
    assert got[7]["verdict"] == "block" and got[149]["verdict"] == "block" and got[249]["verdict"] == "allow" and len(got) == len(urls)
    none = url_reputation.judge_urls(pages, outcomes.limit(0), []).select("verdict").distinct().collect()
    assert [r["verdict"] for r in none] == ["allow"]
    assert url_reputation.judge_urls(pages.limit(0), None, rules).count() == 0
