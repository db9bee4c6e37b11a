"""Files in many splits give the chunks of the whole."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.operators.chunk import chunk_lines
from quarry.sources import splits


def fold(tokens, size, start, held):
    for i, t in enumerate(tokens, 1):
        if t > size:
            start, held = -1, 0
        elif start >= 0 and held + t > size:
            start, held = i, t
        else:
            start, held = (i if start < 0 else start), held + t
    return start, held


@given(st.lists(st.integers(0, 14), max_size=25), st.integers(3, 12))
@settings(max_examples=300, deadline=None)
def test_a_block_is_a_function_of_what_comes_in(tokens, size):
    steps = splits.steps_of(tokens, size)
    assert [m for m, _, _ in steps] == sorted({m for m, _, _ in steps}) and steps[-1][0] == size
    for held in range(size + 1):
        start, out = fold(tokens, size, 0, held)  # 0: the chunk that came in
        at, said = next((s, t) for m, s, t in steps if held <= m)
        assert (at, held + said if at == 0 else max(said, 0)) == (start, out)
    assert splits._from_nothing(tokens, size) == fold(tokens, size, -1, 0)


def made_text(seed, n):
    rng = random.Random(seed)
    lines = []
    for _ in range(n):
        words = rng.choice([0, 0, 1, 2, 3, 8, 8, 20, 70])
        lines.append(rng.choice(["", " "]) + " ".join(rng.choice(["ab", "é", "cde　f", "x"]) for _ in range(words)) + rng.choice(["", "", " ", "\r"]))
    return "\n".join(lines)


@pytest.mark.parametrize("split_bytes,block_bytes", [(500, 100), (400, 1 << 20), (1 << 27, 90)])
def test_files_in_splits_are_chunked_as_whole(spark, tmp_path, split_bytes, block_bytes):
    texts = {"a.txt": made_text(1, 900), "b.txt": made_text(2, 60) + "\n", "c.txt": "\n\n\n", "d.txt": "one line", "e.txt": "\n" * 40 + "x " * 200 + "\n" + "\n" * 900 + "y", "f.txt": "x\n" * 70}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        blocks = splits.read_blocks(spark, [str(tmp_path)], block_bytes).persist()
        if split_bytes < 1000:
            assert blocks.where("path like '%a.txt'").select("split").distinct().count() >= 40
        got = splits.chunk_blocks(blocks, 60, band=50).collect()
        blocks.unpersist()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    found = {name: [] for name in texts}
    for r in sorted(got, key=lambda r: (r["path"], r["chunk_index"])):
        own = found[r["path"].rsplit("/", 1)[-1]]
        assert r["chunk_index"] == len(own)
        own.append((r["chunk"], r["line_start"], r["line_end"]))
    assert found == {name: chunk_lines(text, 60) for name, text in texts.items()}


def test_the_scan_of_a_file_holds_numbers_only():
    n, size, rng = 3000, 128, random.Random(3)
    tokens = [[rng.choice([0, 3, 7, 21, 60, 200]) for _ in range(12)] for _ in range(40)]
    step = [("start", pa.int64()), ("tokens", pa.int32())]
    known = [splits.steps_of(t, size) for t in tokens]
    steps = pa.array([[{"most": m, "start": s, "tokens": k} for m, s, k in known[i % 40]] for i in range(n)], pa.list_(pa.struct([("most", pa.int32()), *step])))
    none = pa.array([dict(zip(("start", "tokens"), splits._from_nothing(tokens[i % 40], size), strict=True)) for i in range(n)], pa.struct(step))
    blocks = pa.table({"path": ["f"] * n, "file_size": [12 * n] * n, "split": [0] * n, "block": pa.array(range(n), pa.int32()), "n_lines": [12] * n, "n_bytes": [12] * n, "steps": steps, "none": none})
    mixed = blocks.take(pa.array(rng.sample(range(n), n)))
    tracemalloc.start()
    out = splits.scan(mixed, size)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8_000_000
    start, held = -1, 0
    for i, r in enumerate(out.to_pylist()):
        assert (r["block"], r["before"], r["start"], r["held"], r["last_of_ended"]) == (i, 12 * i, start, held, i + 1 == n)
        at, held = fold(tokens[i % 40], size, 0 if start >= 0 else -1, held)
        start = start if at == 0 else -1 if at < 0 else 12 * i + at
