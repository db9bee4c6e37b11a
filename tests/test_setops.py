import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import docorder, match, report, retrieve, setops

SCHEMA = "corpus string, location string, score double, chunk string"


def rows(spark, *items):
    """(file:range, score[, vector]) in corpus "orchard"."""
    return spark.createDataFrame([("orchard", loc, score, f"text of {loc}") for loc, score in items], SCHEMA)


def scores(df):
    return {r["location"]: r["score"] for r in df.collect()}


def test_union_keeps_highest_score(spark):
    a, b = rows(spark, ("pear:3-8", 0.41), ("pear:9-14", 0.33)), rows(spark, ("pear:3-8", 0.62))
    assert scores(setops.union([a, b])) == {"pear:3-8": 0.62, "pear:9-14": 0.33}
    assert setops.union_all([a, b]).count() == 3


def test_union_of_disjoint_sets_and_ties(spark):
    a, b = rows(spark, ("a:1-2", 0.5)), rows(spark, ("b:1-2", 0.5))
    assert setops.union([a, b]).count() == 2
    first = rows(spark, ("a:1-2", 0.5)).withColumn("chunk", F.lit("first"))
    assert setops.union([first, a]).first()["chunk"] == "first"


def test_difference(spark):
    a, b = rows(spark, ("x:1-1", 0.9), ("x:2-2", 0.8), ("x:3-3", 0.7)), rows(spark, ("x:2-2", 0.1))
    assert set(scores(setops.difference(a, b))) == {"x:1-1", "x:3-3"}
    assert setops.difference(a, rows(spark, ("y:1-1", 0.9))).count() == 3
    assert setops.difference(a, a).count() == 0


def test_intersect(spark):
    a, b = rows(spark, ("x:1-1", 0.52), ("x:2-2", 0.4)), rows(spark, ("x:1-1", 0.47), ("x:9-9", 0.3))
    assert scores(setops.intersect(a, b)) == {"x:1-1": 0.52}
    assert setops.intersect(a, rows(spark, ("z:1-1", 1.0))).count() == 0
    assert scores(setops.intersect_all([a, b, a])) == {"x:1-1": 0.52}


def test_nested_union_minus(spark):
    a, b, c = rows(spark, ("x:1-1", 0.9), ("x:2-2", 0.8)), rows(spark, ("x:3-3", 0.7)), rows(spark, ("x:4-4", 0.6))
    both = setops.union([a, b, c])
    assert both.count() == 4
    assert setops.difference(both, rows(spark, ("x:3-3", 0.2))).count() == 3


def test_semantic_difference_keeps_rows_without_vectors_and_below_threshold(spark):
    schema = SCHEMA + ", embedding array<float>"
    a = spark.createDataFrame(
        [("c", "x:1-1", 0.9, "", [1.0, 0.0]), ("c", "x:2-2", 0.8, "", [0.0, 1.0]), ("c", "x:3-3", 0.7, "", None), ("c", "x:4-4", 0.6, "", [0.6, 0.8])], schema
    )
    b = spark.createDataFrame([("c", "y:1-1", 0.9, "", [1.0, 0.0]), ("c", "y:2-2", 0.9, "", [1.0, 0.0])], schema)
    assert set(scores(setops.semantic_difference(a, b, 0.7))) == {"x:2-2", "x:3-3", "x:4-4"}
    assert set(scores(setops.semantic_difference(a, b, 0.5))) == {"x:2-2", "x:3-3"}
    assert set(scores(setops.semantic_difference(a, b, 0.5, block=1))) == {"x:2-2", "x:3-3"}
    assert setops.semantic_difference(a, b.limit(0), 0.5).count() == 4


PLACES = "corpus string, source string, chunk_index int, line_start int, line_end int, score double, chunk string"


def places(spark, *items):
    return spark.createDataFrame([(c, s, i, a, b, score, f"t{a}") for i, (c, s, a, b, score) in enumerate(items)], PLACES)


def merged(df):
    return sorted((r["corpus"], r["source"], r["line_start"], r["line_end"], r["score"], r["chunk"]) for r in docorder.merge_adjacent(df).collect())


def test_merge_touching_and_overlapping(spark):
    assert merged(places(spark, ("c", "f", 1, 10, 0.9), ("c", "f", 11, 20, 0.8))) == [("c", "f", 1, 20, 0.9, "t1\nt11")]
    assert merged(places(spark, ("c", "f", 1, 15, 0.9), ("c", "f", 10, 20, 0.8))) == [("c", "f", 1, 20, 0.9, "t1\nt10")]
    assert len(merged(places(spark, ("c", "f", 1, 10, 0.9), ("c", "f", 15, 20, 0.8)))) == 2
    assert len(merged(places(spark, ("c", "f", 1, 10, 0.9), ("c", "g", 11, 20, 0.8), ("d", "f", 11, 20, 0.8)))) == 3
    several = places(spark, ("c", "a", 1, 10, 0.5), ("c", "a", 11, 20, 0.5), ("c", "a", 30, 40, 0.5), ("c", "b", 1, 10, 0.5), ("c", "b", 11, 20, 0.5))
    assert [m[1:4] for m in merged(several)] == [("a", 1, 20), ("a", 30, 40), ("b", 1, 20)]
    nested = places(spark, ("c", "a", 1, 50, 0.5), ("c", "a", 10, 20, 0.6), ("c", "a", 51, 60, 0.5))
    assert [m[2:4] for m in merged(nested)] == [(1, 60)]
    assert merged(places(spark, ("c", "f", 1, 10, 0.9)).limit(0)) == []


def test_document_order(spark):
    df = places(spark, ("c", "f", 100, 200, 0.1), ("c", "f", 10, 50, 0.9), ("b", "z", 7, 8, 0.3), ("c", "f", 51, 99, 0.2))
    assert [r["line_start"] for r in docorder.document_order(df).collect()] == [7, 10, 51, 100]


def test_rebuild_text(spark):
    lines = spark.createDataFrame([(c, "f", i, f"{c} line {i}") for c in "cd" for i in range(1, 11)], "corpus string, source string, line_no int, text string")
    ranges = docorder.interval_union(places(spark, ("c", "f", 2, 3, 0.9), ("c", "f", 3, 4, 0.9), ("c", "f", 8, 8, 0.9), ("d", "f", 10, 12, 0.9)))
    content = {r["corpus"]: r["content"] for r in docorder.rebuild_text(lines, ranges).collect()}
    assert content == {"c": "c line 2\nc line 3\nc line 4\n\nc line 8\n", "d": "d line 10\n"}


def test_numbered_over_bands_of_score(spark):
    scores = [0.5, 0.50001, 0.50002, 0.9, -0.3, 0.5, None, 0.49999]
    df = spark.createDataFrame([(x, "c", i) for i, x in enumerate(scores)], "score double, corpus string, chunk_index int").repartition(3)
    got = {r["chunk_index"]: r["i"] for r in report.numbered(df).collect()}
    order = sorted(range(len(scores)), key=lambda i: (scores[i] is None, -(scores[i] or 0), i))
    assert got == {i: n for n, i in enumerate(order, 1)}


@pytest.mark.parametrize("block", [10_000, 3])
def test_matches_in_blocks(spark, block):
    rng = np.random.default_rng(2)
    left, right = rng.normal(size=(40, 4)).astype(np.float32), rng.normal(size=(13, 4)).astype(np.float32)
    a = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(left)] + [(99, None)], "doc_id long, embedding array<float>")
    b = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(right)], "item_id string, embedding array<float>")
    scores = left.astype(float) @ right.astype(float).T
    pairs = {(r["item_id"], r["doc_id"]): r["score"] for r in match.close_pairs(a.where("doc_id < 99"), b, 1.0, block).collect()}
    assert pairs == pytest.approx({(str(j), i): scores[i, j] for i, j in zip(*np.nonzero(scores >= 1.0), strict=True)})
    best = a.join(match.best_match(a, b, block), "embedding").collect()
    assert {r["doc_id"]: r["similarity"] for r in best} == pytest.approx(dict(enumerate(scores.max(1))))
    assert match.best_match(a, b.limit(0), block).count() == match.close_pairs(a, b.limit(0), 0.0, block).count() == 0
    assert match.best_match(a.limit(0), b, block).count() == match.close_pairs(a.limit(0), b, 0.0, block).count() == 0


def test_search_many_is_each_search_by_itself(spark):
    rng = np.random.default_rng(3)
    vectors = [v / np.linalg.norm(v) for v in rng.normal(size=(60, 4))]
    schema = "corpus string, source string, chunk_index int, line_start int, line_end int, chunk string, embedding array<double>"
    chunks = spark.createDataFrame([("ab"[i % 2], "f", i, i, i, f"t{i}", v.tolist()) for i, v in enumerate(vectors)] + [("a", "f", 99, 99, 99, "none", None)], schema).repartition(3)
    asked = [v.tolist() for v in vectors[:3]]
    for corpora, least, most in ((None, 0.2, None), (["b"], 0.2, 3), (None, 0.5, 4), (["a"], -1.0, None)):
        rows = retrieve.search_many(chunks, asked, corpora, least, most).collect()
        for i, v in enumerate(asked):
            alone = retrieve.search_rows(chunks, v, corpora, least, most).collect()
            key = lambda r: (r["corpus"], r["chunk_index"], r["location"], round(r["score"], 9))
            assert sorted(key(r) for r in rows if r["_ord"] == i) == sorted(map(key, alone))


@pytest.mark.parametrize("lines", [3, 40, 1_000_000])
def test_islands_in_blocks(spark, lines):
    """Ranges that span blocks, lie within earlier ones, touch at edges, and files with null names."""
    rng = np.random.default_rng(11)
    rows = []
    for corpus, source in (("c", "f"), ("c", "g"), ("d", None), (None, "f")):
        for i in range(60):
            a = int(rng.integers(1, 300))
            rows.append((corpus, source, i, a, a + int(rng.choice([0, 1, 2, 5, 40])), f"{source}:{i}", float(i) / 60, f"t{i}"))
    df = spark.createDataFrame(rows, "corpus string, source string, chunk_index int, line_start int, line_end int, location string, score double, chunk string").repartition(5)
    want = []
    for key in {r[:2] for r in rows}:
        end = None
        for r in sorted([r for r in rows if r[:2] == key], key=lambda r: (r[3], r[4], r[2])):
            if end is None or r[3] > end + 1:
                want.append([*key, r[3], r[4], r[6], [r[7]]])
            else:
                want[-1][3], want[-1][4] = max(want[-1][3], r[4]), max(want[-1][4], r[6])
                want[-1][5].append(r[7])
            end = want[-1][3]
    got = docorder.merge_adjacent(df, lines).collect()
    assert sorted([[r["corpus"], r["source"], r["line_start"], r["line_end"], r["score"], r["chunk"].split("\n")] for r in got], key=str) == sorted(want, key=str)
    joined = docorder.interval_union(df, lines).collect()
    assert sorted([list(r[:4]) for r in joined], key=str) == sorted([w[:4] for w in want], key=str)


def test_one_large_file_goes_to_many_tasks(spark):
    """A file of a million chunks, two islands in all: no window gets more than a block of it."""
    n = 1_000_000
    df = spark.range(n).selectExpr("'c' corpus", "'f' source", "cast(id as int) chunk_index", "cast(id * 10 + if(id >= 500000, 100, 0) as int) line_start", "cast(id * 10 + 9 + if(id >= 500000, 100, 0) as int) line_end")
    got = docorder.interval_union(df.repartition(4)).collect()
    assert sorted((r["line_start"], r["line_end"]) for r in got) == [(0, n * 5 - 1), (n * 5 + 100, n * 10 + 99)]
    blocks = df.groupBy((df["line_start"] / docorder.BLOCK_LINES).cast("int")).count()
    assert blocks.count() > 90 and blocks.agg({"count": "max"}).first()[0] <= docorder.BLOCK_LINES / 10


def test_rebuild_by_bins(spark):
    lines = spark.range(1, 5001).selectExpr("'c' corpus", "'f' source", "cast(id as int) line_no", "concat('l', id) text")
    ranges = spark.createDataFrame([("c", "f", 1, 1_000_000_000), ("c", "g", 1, 5), ("c", "f", 0, -1)], "corpus string, source string, line_start long, line_end long").where("line_start = 1")
    got = docorder.rebuild_text(lines, ranges, bin_lines=1_000_000).collect()
    assert [(r["source"], r["content"]) for r in got] == [("f", "".join(f"l{i}\n" for i in range(1, 5001)))]
    few = spark.createDataFrame([("c", "f", 15, 17), ("c", "f", 4999, 7000)], "corpus string, source string, line_start long, line_end long")
    assert docorder.rebuild_text(lines, few, bin_lines=8).first()["content"] == "l15\nl16\nl17\n\nl4999\nl5000\n"
