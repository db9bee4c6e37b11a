import numpy as np
import pytest

from quarry.operators import tablefunction

SCHEMA = "corpus string, chunk_index int, extra string, rank int, embedding array<float>"


@pytest.fixture
def table(spark):
    x = np.random.default_rng(1).normal(size=(90, 4)).astype(np.float32)
    rows = [("ab"[i % 2], i, f"e{i}", -1, v.tolist()) for i, v in enumerate(x)] + [("a", 900 + i, "same", -1, x[0].tolist()) for i in range(9)]
    spark.createDataFrame([*rows, ("c", 1, "none", 0, None)], SCHEMA).repartition(4).createOrReplaceTempView("tf_chunks")
    tablefunction.register_top_k(spark, "tf_top_k", lambda text: x[int(text)].tolist())
    return x, rows


def wanted(x, rows, corpus, q, k):
    own = sorted((-float(np.array(r[4], float) @ x[q].astype(float)), r[1]) for r in rows if r[0] == corpus)
    return [(corpus, i, n) for n, (_, i) in enumerate(own[:k], 1)]


def test_top_k_by_partition(spark, table):
    x, rows = table
    every = wanted(x, rows, "a", 0, 12) + wanted(x, rows, "b", 0, 12)
    for statement in (
        "SELECT * FROM tf_top_k(TABLE(SELECT * FROM tf_chunks) PARTITION BY (corpus), '0', 12)",
        tablefunction.top_k_statement("tf_top_k", "tf_chunks", "0", 12, parts=3),
    ):
        got = spark.sql(statement)
        assert got.columns == ["corpus", "chunk_index", "extra", "score", "rank"]
        assert sorted((r["corpus"], r["chunk_index"], r["rank"]) for r in got.collect()) == sorted(every)


def test_schema_and_errors_come_from_analyze(spark, table):
    got = spark.sql("SELECT * FROM tf_top_k(TABLE(SELECT corpus, embedding, 1.5D AS weight FROM tf_chunks) PARTITION BY (corpus), '3', 1)")
    assert dict(got.dtypes) == {"corpus": "string", "weight": "double", "score": "double", "rank": "int"} and got.count() == 2
    with pytest.raises(Exception, match="column embedding"):
        spark.sql("SELECT * FROM tf_top_k(TABLE(SELECT corpus FROM tf_chunks) PARTITION BY (corpus), '3', 1)")
    with pytest.raises(Exception, match="number of rows"):
        spark.sql("SELECT * FROM tf_top_k(TABLE(SELECT * FROM tf_chunks) PARTITION BY (corpus), '3', 0)")
