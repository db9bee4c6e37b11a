"""Phrase mining, mixing and whitening against plain versions of their definitions."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import collocation, mixing, whitening

SOME = "alpha beta gamma delta".split()


# ---- phrases


def plain_phrases(rows, least, most):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        scored = []
        for phrase, a in counts.items():
            if len(phrase) < 2 or a < least:
                continue
            cuts = [(2_000_000 * a // (counts[phrase[:k]] + counts[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            inside = any(
                len(long) > len(phrase) and b >= least and 100 * b >= 80 * a and any(long[i : i + len(phrase)] == phrase for i in range(len(long) - len(phrase) + 1))
                for long, b in counts.items()
            )
            if not inside:
                scored.append((-score, -a, " ".join(phrase).encode(), counts[phrase[:k]], counts[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def made_texts(seed, n=120):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words = [SOME[min(3, int(x))] for x in rng.exponential(1.2, rng.integers(0, 40))]
        marks = [str(rng.choice(["", "", "", ".", ",", "\n", "\t", " \x1c"])) for _ in words]
        out.append((i, ["en", "de", None][i % 3], " ".join(w.upper() * (j % 7 == 0) or w + m for j, (w, m) in enumerate(zip(words, marks, strict=True)))))
    return out + [(None, None, None), (7, "en", ""), (7, "en", "alpha beta " * 40), (8, "fr", "x"), (9, "en", "alpha\x1cbeta ünï . ünï " * 6)]


@pytest.mark.parametrize("one_in,bits,size", [(8, 1 << 28, 16_000_000), (3, 64, 200), (1000, 128, 50)])
def test_phrases_equal_the_definition(spark, one_in, bits, size):
    """Also with so small a map that most bits are set by chance, with a sample of next to nothing, and in slices of a few words."""
    rows = made_texts(one_in)
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, lang string, text string, phrase int, n string").repartition(3)
    found = collocation.frequent_phrases(docs, 5, one_in, bits, size)
    counted = Counter()
    for r in found.collect():
        assert (r["lang"], r["phrase"]) not in counted  # each phrase by one pass
        counted[r["lang"], r["phrase"]] = r["n"]
    best = collocation.best_phrases(collocation.score_phrases(found), 10, parts=3)
    got = sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], counted[r["lang"], ""], r["score"]) for r in best.collect())
    assert got == plain_phrases([r[1:] for r in rows], 5, 10) and len(got) > 15


def test_phrases_of_whole_operator_and_of_nothing(spark):
    rows = made_texts(5)
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = collocation.mine_phrases(docs, least=6, most=4)
    assert sorted(map(tuple, got.collect())) == plain_phrases([r[1:] for r in rows], 6, 4)
    assert dict(got.dtypes) == {c: "string" if c in ("lang", "phrase") else "bigint" for c in got.columns}
    assert collocation.mine_phrases(docs.limit(0)).collect() == []
    assert collocation.mine_phrases(docs.withColumn("text", docs["lang"])).collect() == []


def test_scores_beyond_64_bits(spark):
    """2000000 * a and 100 * f pass a long."""
    a = 6 * 10**16
    rows = [("en", "x", 10**17), ("en", "y", 9 * 10**16), ("en", "x y", a), ("en", "x y x", 8 * a // 10), ("en", "y x", 8 * a // 10 + 1)]
    scored = collocation.score_phrases(spark.createDataFrame(rows, "lang string, phrase string, n long"))
    got = {r["phrase"]: (r["score"], r["l"], r["r"]) for r in scored.collect()}
    assert set(got) == {"x y x"}  # both pairs are covered by just 80 %
    b = 8 * a // 10
    assert got["x y x"] == min((2_000_000 * b // (10**17 + b + 1), 10**17, b + 1), (2_000_000 * b // (a + 10**17), a, 10**17))


@given(st.lists(st.sampled_from(["ab", ".", "c", " ", ",", "\n"]), max_size=60), st.integers(1, 12))
@settings(max_examples=60, deadline=None)
def test_slices_lose_no_phrase(parts, size):
    data = "".join(parts).encode().translate(collocation.PIECES)
    whole, cut, every = Counter(), Counter(), collocation.Marks(np.full(4, 2**64 - 1, np.uint64))
    for into, texts in ((whole, [data]), (cut, list(collocation.slices(data, size)))):
        for text in texts:
            for phrases, n in collocation.count_slice(text, "en", None, every):
                into.update(dict(zip(phrases.to_pylist(), n.tolist(), strict=True)))
    assert whole == cut


# ---- mixing


def plain_targets(sizes, most=3):
    keys = sorted((k for k in sizes if k is not None), key=str.encode) + [None] * (None in sizes)
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(keys)}
    total, full = sum(sizes.values()), set()
    while True:
        left, weights = total - sum(most * sizes[k] for k in full), sum(w for k, w in weight.items() if k not in full)
        found = {k: most * sizes[k] if k in full else left * weight[k] / weights for k in keys}
        above = {k for k in keys if found[k] > most * sizes[k] * (1 + 1e-12)}
        if not above:
            return found
        full |= above


def made_documents(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(900):
        source = ["a", "b", "Z", "é", "\U0001f600", None, "tiny", "￮"][min(7, int(rng.exponential(1.6)))]
        size = int(rng.pareto(1.2) * 8) % 900
        rows.append((int(i), source, " \t".join(["w"] * size)))
    return [*rows, *[(5, "a", "one two three")] * 300, (None, "b", None), (None, None, ""), (3, "empty", ""), (3, "solo", "x y")]


def test_mixing_meets_targets_by_tilted_rates(spark):
    rows = made_documents(3)
    docs = spark.createDataFrame([(*r, -1, -2, -3) for r in rows], "doc_id long, source string, text string, size int, copies int, key int").repartition(5)
    got = mixing.mix_sources(docs, group_rows=50).collect()
    assert len(got) == len(rows)
    sizes, texts = Counter(), defaultdict(list)
    for i, source, text in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] += n
        texts[source].append(n)
    wanted = plain_targets(sizes)
    by_target = defaultdict(list)
    for r in got:
        by_target[(r["source_size"], round(r["target"], 3))].append(r)
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] and r["copies"] >= 0
    assert {(sizes[k], round(float(wanted[k]), 3)) for k in sizes} == set(by_target)
    for k in sizes:
        own = by_target[(sizes[k], round(float(wanted[k]), 3))]
        if sum(sizes[j] == sizes[k] for j in sizes) > 1:
            continue
        assert sorted(r["size"] for r in own) == sorted(texts[k])
        assert abs(sum(r["taken"] for r in own) - wanted[k]) <= max(1, min((n for n in texts[k] if n), default=1)) / 2 + 1e-6
        tilted = [(r["size"], math.log(r["rate"])) for r in own if r["size"] and r["rate"] < 3]
        assert len({round(log / size, 9) for size, log in tilted}) <= 1  # one tilt a source
        assert abs(sum(r["rate"] * r["size"] for r in own) - wanted[k]) <= 2e-7 * wanted[k]
    again = mixing.mix_sources(docs.repartition(2), group_rows=50).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixing_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix_sources(docs).collect() == []
    blank = spark.createDataFrame([(1, "a", None), (2, None, " \t\n")], "doc_id long, source string, text string")
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mix_sources(blank).collect()] == [(0, 0.0, 0)] * 2


def test_targets_reshare_until_none_is_above(spark):
    sizes = {"a": 1, "b": 1000, "c": 3, "d": 10, "e": 5000, "f": 2}
    got = mixing.targets(spark.createDataFrame([("s" + k, v) for k, v in sizes.items()], "key string, source_size long")).collect()
    assert {r["key"][1:]: pytest.approx(r["target"]) for r in got} == plain_targets(sizes)


# ---- whitening


def plain_whitening(vectors, most=16):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1][:most]
    deviation = [sum(int(v) ** 2 for v in row) for row in n * x - sums]
    return n, deviation, (x - sums / n) @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening_equals_the_eigenvectors(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 20)) * np.linspace(3, 0.5, 20)
    vectors = [*base.tolist(), *base[:40].tolist(), *[base[0].tolist()] * 100]
    rows = [(i if i % 9 else None, v, "x", 1) for i, v in enumerate(vectors)]
    odd = [(900, None), (901, [*base[0][:-1].tolist(), None]), (902, [float("nan")] * 20), (903, [float("inf")] * 20), (904, []), (905, [1.0] * 19), (906, [1e300] * 20)]
    table = spark.createDataFrame([*rows, *[(*o, "y", 2) for o in odd]], "vec_id long, embedding array<double>, component string, n int").repartition(4)
    got = whitening.whiten(table).collect()
    n, deviation, whitened, explained = plain_whitening(vectors)
    assert len(got) == len(vectors) * 16 and {r["n"] for r in got} == {n}
    assert Counter((r["vec_id"], r["deviation"]) for r in got) == Counter({k: 16 * c for k, c in Counter((r[0], d) for r, d in zip(rows, deviation, strict=True)).items()})
    place = {i: v for i, v in enumerate(whitened) if i % 9}
    seen = {(r["vec_id"], r["component"]): r["whitened"] for r in got if r["vec_id"] is not None}
    for c in range(1, 17):
        mine, theirs = np.array([seen[i, c] for i in place]), np.array([place[i][c - 1] for i in place])
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-9
    assert {r["component"]: r["explained"] for r in got} == {i + 1: pytest.approx(e, rel=1e-9) for i, e in enumerate(explained)}
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-10


def test_whitening_of_little(spark):
    kind = "vec_id string, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([("a", [1.0, 2.0])] * 5, kind)).collect() == []  # no variance
    got = whitening.whiten(spark.createDataFrame([("a", [0.0, 1.0]), ("b", [2.0, 1.0]), ("b", [2.0, 1.0])], kind)).collect()
    assert sorted((r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in got) == [
        ("a", 1, 2, 128**2, 1.0, 1.0), ("b", 1, 2, 128**2, 1.0, 1.0), ("b", 1, 2, 128**2, 1.0, 1.0)
    ]


def test_triangles_are_merged_in_levels(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2000, (500, 6))
    fit = spark.createDataFrame([(r,) for r in x.tolist()], "x array<bigint>").repartition(9)
    centre = whitening.centre_of(fit)
    assert (centre.n, [int(m) * 500 + int(r) for m, r in zip(centre.middle, centre.rest, strict=True)]) == (500, x.sum(0).tolist())
    r = whitening.triangle(fit, centre, fan=2)
    centred = x - x.mean(0)
    assert np.allclose(r.T @ r, centred.T @ centred) and np.allclose(r, np.triu(r))


def test_deviation_beyond_a_long():
    centre = whitening.Centre(10**9, [0, 10**9])
    assert centre.deviations(np.array([[3, 1], [4 * 10**9, 1]])).to_pylist() == [9 * 10**18, None]
    assert centre(np.array([[3, 2]])).tolist() == [[3.0, 1.0]]


@given(st.integers(1, 24), st.integers(0, 2**32 - 1), st.sampled_from(["even", "graded", "ties", "low", "zeros"]))
@settings(max_examples=60, deadline=None)
def test_singular_values_and_vectors(n, seed, kind):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((n + 3, n))
    if kind == "graded":
        a = a * 10.0 ** rng.uniform(-6, 6, n)
    elif kind == "ties":
        a = np.linalg.qr(a)[0] * np.array([1.0, 2.0])[rng.integers(0, 2, n)]
    elif kind == "low":
        a = rng.standard_normal((n + 3, 2)) @ rng.standard_normal((2, n))
    elif kind == "zeros":
        a = a * rng.integers(0, 2, n)
    squares, axes = whitening.directions(np.linalg.qr(a, mode="r"), n)
    want = np.linalg.svd(a, compute_uv=False)
    k = axes.shape[1]
    assert (want[k:] <= 1e-10 * max(want[0], 1e-300)).all()
    assert np.allclose(np.sqrt(squares[:k]), want[:k], rtol=1e-9 if kind == "graded" else 1e-12, atol=1e-14 * want[0])
    assert np.abs(axes.T @ axes - np.eye(k)).max(initial=0) < 1e-9
    strong = want[:k] > 1e-5 * want[0]
    white = (a @ axes / np.sqrt(squares[:k]))[:, strong]
    assert np.abs(white.T @ white - np.eye(strong.sum())).max(initial=0) < 1e-8
