"""Searches and joins by cells: the results of all pairs, from fewer cells and pairs of blocks."""

import numpy as np
import pytest

from quarry.operators import cells, match, retrieve, setops

SCHEMA = "corpus string, source string, chunk_index int, line_start int, line_end int, chunk string, embedding array<double>"


def grouped(rng, groups, each, dim=16, spread=0.05, lengths=False):
    middle = rng.normal(size=(groups, dim))
    x = (middle / np.linalg.norm(middle, axis=1, keepdims=True))[:, None] + spread * rng.normal(size=(groups, each, dim))
    x = x.reshape(-1, dim)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x * rng.uniform(0.2, 3, (len(x), 1)) if lengths else x


def chunks_of(spark, x):
    rows = [(["a", "b", "007"][i % 3], "f", i, i, i, f"t{i}", v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame([*rows, ("a", "f", -7, 0, 0, "none", None)], SCHEMA).repartition(3)


@pytest.mark.parametrize("lengths", [False, True])
def test_index_finds_what_a_scan_finds(spark, tmp_path, lengths):
    x = grouped(np.random.default_rng(4), 30, 20, lengths=lengths)
    chunks = chunks_of(spark, x)
    index = cells.VectorIndex.build(chunks, f"{tmp_path}/index", most=40)
    every = index.reachable(x[0].tolist())
    assert sum(r["n"] for r in every) == len(x)
    key = lambda rows: sorted((r["corpus"], r["chunk_index"], round(r["score"], 9)) for r in rows.collect())
    for i, corpora, least in ((0, None, 0.9), (3, ["b", "007"], 0.5), (5, None, -5.0)):
        asked = x[i].tolist()
        assert key(index.search(asked, least, corpora)) == key(retrieve.search_rows(chunks.where("embedding is not null"), asked, corpora, least))
        scan = retrieve.score_chunks(chunks.where("embedding is not null"), asked, corpora)
        assert key(index.top_k_per_corpus(asked, 4, corpora)) == key(retrieve.top_k_per_corpus(scan, 4))
    if not lengths:
        reached = [r for r in every if r["bound"] >= 0.9]
        assert len(reached) < len(every) / 4
        assert len(index.cells_for_top_k(x[0].tolist(), 4)) < len(every) / 4


def test_index_keeps_names_of_corpora_and_refuses_none(spark, tmp_path):
    x = grouped(np.random.default_rng(5), 3, 5)
    index = cells.VectorIndex.build(chunks_of(spark, x), f"{tmp_path}/index")
    assert {r["corpus"] for r in index.chunks().select("corpus").distinct().collect()} == {"a", "b", "007"}
    again = cells.VectorIndex(spark, f"{tmp_path}/index")
    assert again.search(x[0].tolist(), 0.9, ["no such"]).collect() == []
    with pytest.raises(ValueError, match="no vectors"):
        cells.VectorIndex.build(chunks_of(spark, x).limit(0), f"{tmp_path}/none")


def test_a_pruned_search_reads_fewer_partitions(spark, tmp_path):
    x = grouped(np.random.default_rng(6), 30, 20)
    index = cells.VectorIndex.build(chunks_of(spark, x), f"{tmp_path}/index", most=40)
    found = index.search(x[0].tolist(), 0.9)
    found.collect()

    def partitions(plan):
        out = []
        if "scan" in plan.nodeName().lower():
            read = plan.metrics().get("numPartitions")
            out.append(read.get().value() if read.isDefined() else -1)
        for i in range(plan.children().size()):
            out += partitions(plan.children().apply(i))
        return out

    every = index.chunks()
    every.collect()
    few, all_of_them = (partitions(df._jdf.queryExecution().executedPlan()) for df in (found, every))
    assert 0 < few[0] < all_of_them[0] / 4


@pytest.mark.parametrize("lengths", [False, True])
def test_joins_by_cells_are_all_pairs(spark, lengths):
    rng = np.random.default_rng(7)
    left = grouped(rng, 12, 25, lengths=lengths)
    right = np.vstack([left[::7] + 0.01 * rng.normal(size=left[::7].shape), grouped(rng, 9, 20, lengths=lengths), np.repeat(left[:1], 30, 0)])
    scores = left @ right.T
    a = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(left)] + [(9999, None)], "doc_id long, embedding array<double>").repartition(3)
    b = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(right)] + [("none", None)], "item_id string, embedding array<double>").repartition(2)
    for least in (0.95, 0.2, -9.0):
        got = {(r["item_id"], r["doc_id"]): r["score"] for r in match.close_pairs_by_cells(a, b, least, 16).collect()}
        assert got == pytest.approx({(str(j), i): scores[i, j] for i, j in zip(*np.nonzero(scores >= least), strict=True)})
    best = {r["doc_id"]: r["similarity"] for r in a.join(match.best_match(a, b, 16), "embedding").collect()}
    assert best == pytest.approx(dict(enumerate(scores.max(1))))
    above = {r["doc_id"] for r in a.join(match.best_above(a, b, 0.95, 16), "embedding").collect()}
    assert above == set(np.flatnonzero(scores.max(1) >= 0.95).tolist())


def test_pairs_of_blocks_are_pruned(spark):
    rng = np.random.default_rng(8)
    x = grouped(rng, 20, 50)
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "embedding array<double>")
    bundles = match.deal(rows, 50)
    assert bundles.n.sum() == len(x) and bundles.n.max() <= 50 * bundles.parts.max()
    _, made, every = match.pairs_of_blocks(rows, bundles, 0.9, 50)
    assert made < every / 3
    _, made, _ = match.pairs_of_blocks(rows, bundles, None, 50)  # best match, bounded by the pivots
    assert made < every


def test_semantic_difference_by_cells(spark):
    rng = np.random.default_rng(9)
    x = grouped(rng, 10, 12)
    rows = [("c", "s", i, i, i, f"s:{i}-{i}", 0.5, f"t{i}", v.tolist()) for i, v in enumerate(x)]
    schema = "corpus string, source string, chunk_index int, line_start int, line_end int, location string, score double, chunk string, embedding array<double>"
    a = spark.createDataFrame([*rows[:90], ("c", "s", 500, 500, 500, "s:500-500", 0.5, "t", None)], schema)
    b = spark.createDataFrame(rows[60:], schema)
    near = (x @ x[60:].T).max(1) >= 0.8
    want = sorted([i for i in range(60) if not near[i]] + [500])
    for block in (10_000, 8):
        assert sorted(r["chunk_index"] for r in setops.semantic_difference(a, b, 0.8, block).collect()) == want


def test_few_vectors_by_bytes(spark):
    rows = spark.range(50).selectExpr("transform(sequence(1, 100), i -> double(i * id)) as embedding")
    assert match.few_vectors(rows, 100).shape == (50, 100)
    assert match.few_vectors(rows, 100, most_bytes=39_000) is None and match.few_vectors(rows, 49) is None


def test_blocks_grow_with_the_sides(spark):
    x = grouped(np.random.default_rng(10), 1, 3000, spread=1.0)
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "embedding array<double>").repartition(4)
    bundles = match.deal(rows, 2)
    cut, made, _ = match.pairs_of_blocks(rows, bundles, -1.0, 2)
    assert cut.max() <= match.PARTS and made <= 4 * match.PARTS**2  # was over two million pairs of blocks


def test_semantic_difference_leaves_few_rows_to_the_cells(spark, monkeypatch):
    x = grouped(np.random.default_rng(11), 1, 1600, dim=8, spread=5.0)
    rows = [("c", "s", i, i, i, f"s:{i}-{i}", 0.5, f"t{i}", v.tolist()) for i, v in enumerate(x)]
    schema = "corpus string, source string, chunk_index int, line_start int, line_end int, location string, score double, chunk string, embedding array<double>"
    a, b = (spark.createDataFrame(r, schema).repartition(4) for r in (rows[:800], rows[800:]))
    met, whole = [], setops.best_above
    monkeypatch.setattr(setops, "best_above", lambda left, *rest: met.append(left.count()) or whole(left, *rest))
    near = (x[:800] @ x[800:].T).max(1) >= 0.6
    assert sorted(r["chunk_index"] for r in setops.semantic_difference(a, b, 0.6, 8).collect()) == np.flatnonzero(~near).tolist()
    assert len(met) == 1 and met[0] < 400
