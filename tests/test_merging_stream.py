"""Merging in a stream gives what merging all rows at once gives, however they are split into batches."""

import random
from datetime import datetime, timedelta

import pytest

from quarry.operators import docorder
from quarry.streaming import merging

COLUMNS = "corpus string, source string, chunk_index int, line_start int, line_end int, score double, chunk string, seen timestamp"


@pytest.mark.parametrize("batches", [1, 4])
def test_any_split_gives_the_batch_result(spark, tmp_path, batches):
    rng, began = random.Random(batches), datetime(2026, 1, 1)
    rows = [("c", f, i, a := rng.randrange(1, 150), a + rng.choice([0, 2, 6]), round(rng.random(), 3), f"{f}{i}", began + timedelta(seconds=rng.randrange(60))) for f in "fg" for i in range(25)]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    merging.use_rocks(spark)
    try:
        for i in range(batches):
            spark.createDataFrame(rows[i::batches], COLUMNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        # a later row of another file moves the watermark on
        spark.createDataFrame([("c", "later", 0, 1, 1, 0.5, "x", began + timedelta(hours=2))], COLUMNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = merging.merge_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert query.awaitTermination(100)
        got = spark.read.schema(merging.MERGED).parquet(str(tmp_path / "out")).where("source <> 'later'").collect()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    whole = spark.createDataFrame([r[:5] + (f"{r[1]}:{r[3]}-{r[4]}",) + r[5:7] for r in rows], "corpus string, source string, chunk_index int, line_start int, line_end int, location string, score double, chunk string")
    want = docorder.merge_adjacent(whole).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 10


def test_islands_that_a_row_joins():
    a, b = (1, 3, 5, 0.5, [(1, 3, 5, "a")]), (8, 9, 2, 0.9, [(8, 9, 2, "b")])
    assert merging.join_islands([b, a]) == [a, b]
    assert merging.join_islands([b, a, (4, 7, 9, 0.1, [(4, 7, 9, "c")])]) == [(1, 9, 2, 0.9, [(1, 3, 5, "a"), (4, 7, 9, "c"), (8, 9, 2, "b")])]
