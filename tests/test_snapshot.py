"""The data source: what counts is what the last commit named."""

import json

import numpy as np
import pyarrow as pa
import pytest

from quarry.sources import snapshot


def rows_of(spark, n, corpora=("a", "b", None), seed=1):
    x = np.random.default_rng(seed).normal(size=(n, 4))
    data = [(corpora[i % len(corpora)], "f", i, i, i + 1, f"t{i}", v.tolist()) for i, v in enumerate(x)]
    return x, spark.createDataFrame([*data, ("a", "f", 900, 0, 0, "none", None), ("a", "f", 901, 0, 0, "short", [1.0])], snapshot.SCHEMA).repartition(3)


@pytest.fixture
def root(spark, tmp_path):
    snapshot.register(spark)
    return str(tmp_path / "table")


def read(spark, root, **options):
    return spark.read.format("quarry").options(**options).load(root)


def test_written_is_read(spark, root):
    _, df = rows_of(spark, 30)
    df.write.format("quarry").mode("append").save(root)
    assert sorted(read(spark, root).collect(), key=str) == sorted(df.collect(), key=str)
    df.where("corpus = 'b'").write.format("quarry").mode("append").save(root)
    assert read(spark, root).count() == 42
    df.where("corpus = 'b'").write.format("quarry").mode("overwrite").save(root)
    assert read(spark, root).count() == 10
    assert len(snapshot.vacuum(root)) == 2 and read(spark, root).count() == 10
    df.limit(0).write.format("quarry").mode("overwrite").save(root)
    assert read(spark, root).collect() == []


def test_conditions_are_decided_in_the_reader(spark, root):
    x, df = rows_of(spark, 60)
    df.write.format("quarry").mode("append").save(f"file://{root}")
    vector = [1.0, -0.5, 0.25, 2.0]
    scores = x @ np.array(vector)
    found = read(spark, root, vector=json.dumps(vector)).where("corpus in ('a', 'b', 'zz') and corpus <> 'b' and score >= 0.5 and score > 0.6 and chunk_index < 50")
    want = {i: s for i, s in enumerate(scores) if i % 3 == 0 and s > 0.6 and i < 50}
    assert {r["chunk_index"]: r["score"] for r in found.collect()} == pytest.approx(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "score" not in "".join(line for line in plan.split("\n") if "Filter" in line and "Batch" not in line)
    assert {f["corpus"] for f in snapshot.live_files(root, ["a"])} == {"a"}
    assert sum(f["rows"] for f in snapshot.live_files(root)) == 62
    assert read(spark, root).where("corpus is null").count() == 20


def test_filters_that_are_pushed():
    from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan
    from pyspark.sql.types import StructType

    reader = snapshot.Reader("x", StructType(), [1.0])
    other = [LessThan(("score",), 1.0), EqualTo(("source",), "f"), IsNotNull(("corpus",))]
    assert list(reader.pushFilters([In(("corpus",), ("a", "b")), EqualTo(("corpus",), "b"), GreaterThan(("score",), 0.1), GreaterThanOrEqual(("score",), 0.2), IsNotNull(("score",)), *other])) == other
    assert (reader.corpora, reader.least, reader.above) == (["b"], 0.2, 0.1)


def batches(n):
    yield pa.RecordBatch.from_pylist([{"corpus": "new", "source": "f", "chunk_index": i, "line_start": i, "line_end": i, "chunk": "x", "embedding": [1.0]} for i in range(n)], schema=snapshot.FIELDS)


def test_a_writer_that_dies_leaves_the_old_state(spark, root):
    _, df = rows_of(spark, 12)
    df.write.format("quarry").mode("append").save(root)
    before = sorted(read(spark, root).collect(), key=str)
    for overwrite in (True, False):
        dead = snapshot.Writer(root, overwrite)
        dead.write(batches(5))  # one task is done, the driver dies before the commit
        assert sorted(read(spark, root).collect(), key=str) == before
    failing = snapshot.Writer(root, True)
    failing.abort([failing.write(batches(5))])
    bad = df.selectExpr("corpus", "source", "chunk_index", "line_start", "if(chunk_index = 5, cast(raise_error('no') as long), line_end) line_end", "chunk", "embedding")
    with pytest.raises(Exception, match="no"):
        bad.write.format("quarry").mode("overwrite").save(root)
    assert sorted(read(spark, root).collect(), key=str) == before
    assert len(snapshot.vacuum(root)) >= 2
    assert sorted(read(spark, root).collect(), key=str) == before


def test_many_corpora_and_large_files(spark, root, monkeypatch):
    monkeypatch.setattr(snapshot, "FILE_BYTES", 200)
    monkeypatch.setattr(snapshot, "OPEN_FILES", 2)
    writer = snapshot.Writer(root, False)
    table = pa.concat_tables([pa.Table.from_batches([b]).set_column(0, "corpus", pa.array([f"c{k % 5}"] * 7)) for k in range(9) for b in batches(7)])
    message = writer.write(iter(table.to_batches()))
    writer.commit([message, None])
    assert read(spark, root).count() == 63 and len(message.files) > 5
    assert {r["corpus"]: r["count"] for r in read(spark, root).groupBy("corpus").count().collect()} == {"c0": 14, "c1": 14, "c2": 14, "c3": 14, "c4": 7}
