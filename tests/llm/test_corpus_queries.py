"""The registered corpus queries on small tables: against SQL where they have it, and the pipeline stage by stage."""

import hashlib
import io
import re
import wave
import zlib
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")

import corpus_pipeline  # noqa: E402
from quarry.llm import common, media, queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    df = queries.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted([tuple(r[c] for c in columns) for r in df.collect()], key=str)
    assert got == sorted(con.execute(f"select {', '.join(columns)} from ({queries.ORACLE_SQL[name]})").fetchall(), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_one_row_for_each_document(spark, name):
    if name.startswith(("op1_", "op2_", "op3_", "op6_", "op7_", "op8_", "op10_")):
        df = queries.QUERIES[name](spark, str(DATA))
        ids = [r["doc_id"] for r in df.collect()]
        assert sorted(ids) == sorted(r["doc_id"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())


def test_media_query_against_plain_bytes(spark):
    """The stored file is read back by another reader of its format."""
    got = {r["doc_id"]: r for r in queries.op2_media_signatures(spark, str(DATA)).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        said = (r["text"] or "").encode()
        payload = said + bytes((-len(said)) % 64 or (0 if said else 64))
        out = io.BytesIO()
        with wave.open(out, "wb") as f:
            f.setnchannels(1)
            f.setsampwidth(1)
            f.setframerate(8000)
            f.writeframes(payload)
        with wave.open(io.BytesIO(out.getvalue())) as f:
            assert f.readframes(f.getnframes()) == payload
        mine = got[r["doc_id"]]
        digest = lambda b: hashlib.sha256(b).hexdigest()
        assert (mine["n_bytes"], mine["payload_bytes"], mine["payload_sha256"], mine["tail_crc32"]) == (len(said), len(payload), digest(payload), zlib.crc32(payload[-64:]))
        assert (mine["media_bytes"], mine["media_sha256"]) == (len(out.getvalue()), digest(out.getvalue()))
        found = media.sniff_bytes(out.getvalue())
        spans = ",".join(f"{s['type']}:{s['start']}:{s['length']}" for s in found["embedded"])
        sides = [v >= 128 for v in payload]
        bands = ",".join(str(sum(v // 32 == k for v in payload)) for k in range(8))
        level = f"level={sum(payload) // len(payload)};crossings={sum(a != b for a, b in zip(sides, sides[1:], strict=False))};bands={bands}"
        assert mine["feature"] == f"audio/wav;valid=true;embedded={spans};{level}"
    assert len({r["feature"] for r in got.values()}) > len(got) / 2


def test_native_queries_stay_in_the_jvm(spark):
    for name in ("op4_perspective_rotation", "op9_host_reputation"):
        plan = queries.QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan) and "Cartesian" not in plan


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.cut(stage(spark, docs, str(DATA)))
        assert out.columns == docs.columns
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        assert set(after) <= set(before)
        if name == "quality":
            gone = [labels[i] for i in set(before) - set(after) if i in labels]
            kept = [labels[i] for i in after if i in labels]
            assert sum(kept) > 0.9 * len(kept) and gone.count(0) >= gone.count(1)
        elif name == "near_dedup":
            sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in before.items() if (w := t.lower().split())}
            same = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
            assert all(any(same(i, j) for j in before if j != i) for i in set(before) - set(after))
            assert not any(same(i, j) for i in after for j in after if i < j)
        elif name == "substring_dedup":
            assert set(after) == set(before)
            seen: set = set()
            for i in sorted(before):
                w = before[i].split()
                own = {tuple(w[j : j + 50]) for j in range(len(w) - 49)}
                assert (after[i] != before[i]) == bool(own & seen)
                seen |= own
        else:
            assert len(after) > 0.9 * len(before)
        docs, before = out, after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(DATA)).collect()
    assert {r["doc_id"] for r in packed} == set(before)


def test_quality_stage_keeps_all_where_nothing_can_be_learned(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text", "a"), (2, None, "b"), (3, "!!", "c")], "doc_id long, text string, source string")
    for name, rows in (("none", []), ("negative", [(1, 0), (2, 0)]), ("other", [(99, 1)])):
        spark.createDataFrame(rows, "doc_id long, quality int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.keep_good(spark, docs, f"{tmp_path}/{name}")
        assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 2, 3]


def test_decontamination_stage_drops_only_for_ten_words_in_a_row(spark, tmp_path):
    ten = " ".join(f"q{i}" for i in range(10))
    items = [(1, "yes"), (2, ten), (3, "a b c d e f g h i"), (4, "\u00dc-b c d e f g h i [j]"), (5, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [(1, "yes we can"), (2, f"x {ten} y"), (3, "yes " * 30), (4, ten[:-3]), (5, "\u00dc b c d e f g h i j"), (6, "a b c d e f g h i k"), (7, None)]
    out = corpus_pipeline.drop_contaminated(spark, spark.createDataFrame(texts, "doc_id long, text string"), str(tmp_path))
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3, 4, 6, 7]


def odd_rows(spark):
    """Nulls, empties, repeats, ties, a long text, a null id, and a column more than documents have."""
    say = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    rows = [(1, say("a", 60)), (2, say("a", 60)), (2, say("a", 60)), (3, None), (4, ""), (4, ""), (None, say("b", 70)), (None, say("c", 70)), (5, say("b", 70) + " end of it"), (6, "x y " * 30_000), (7, say("q", 10)), (8, " \n")]
    return spark.createDataFrame([(i, t, "la", "s", len(t or ""), "extra", "extra", "extra") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, n_words string, n_hit string")


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(1, 1), (2, 1), (5, 1), (6, 0), (None, 1), (7, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(10))), (2, None), (None, "x y")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_rows(spark, folder, stage):
    name, run = corpus_pipeline.STAGES[stage]
    docs = odd_rows(spark)
    kept = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = run(spark, docs, folder)
    got = [(r["doc_id"], r["text"]) for r in out.collect()] if name != "packing" else []
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    if name != "packing":
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        assert {x for r in out.collect() for x in (r["score"], r["n_words"], r["n_hit"])} <= {"extra"}
    if name == "quality":
        assert set(got) <= set(kept)
    elif name == "near_dedup":
        copies = [(2, kept[0][1]), (2, kept[0][1]), (None, kept[6][1])]
        assert sorted(got, key=key) == sorted([x for x in kept if x not in copies], key=key)
    elif name == "substring_dedup":
        left = {2: "", 5: None}
        assert len(got) == len(kept) and {t for i, t in got if i == 2} == {left[2]}
        assert [t for i, t in got if i == 5] == [kept[8][1]] and (None, "") in got and (None, kept[7][1]) in got  # of the null ids, the text that a document has
    elif name == "decontamination":
        assert sorted(got, key=key) == sorted([x for x in kept if x[0] != 7], key=key)
    else:
        pieces = out.collect()
        assert {r["doc_id"] for r in pieces} == {i for i, _ in kept} and len({(r["sequence_id"], r["offset"]) for r in pieces}) == len(pieces)
        assert sum(r["length"] == 1 for r in pieces) == 3 and len([r for r in pieces if r["doc_id"] == 6]) > 10
    empty = run(spark, docs.limit(0), folder)
    assert empty.count() == 0 and (name == "packing" or empty.columns == docs.columns)


def test_run_drops_what_it_wrote_on_the_way(spark):
    before = len(common.CUTS)
    out = corpus_pipeline.run(spark, str(DATA))
    assert len(common.CUTS) - before <= 2 and out.count() > 100
    common.drop_cuts(spark, before)
    assert len(common.CUTS) == before


def test_runs_in_threads_leave_each_other_alone(spark):
    from concurrent.futures import ThreadPoolExecutor

    before = len(common.CUTS)
    with ThreadPoolExecutor(2) as pool:
        runs = [pool.submit(lambda: corpus_pipeline.run(spark, str(DATA)).count()) for _ in range(2)]
        assert len({r.result() for r in runs}) == 1
    common.drop_cuts(spark, before)


def test_a_failed_stage_leaves_no_folder(spark):
    frame = spark.range(3)
    with pytest.raises(ZeroDivisionError), common.owned_cuts(spark) as made:
        path = made
        common.cut(frame)
        folder = Path(made[0].removeprefix("file://"))
        assert folder.exists()
        1 / 0  # noqa: B018
    assert path and not folder.exists()
    with common.owned_cuts(spark) as made:
        assert common.cut(frame).count() == 3
    common.remove(spark, made)


def test_a_shared_folder_is_asked_for_off_a_local_session():
    class Cluster:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Cluster()
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())
